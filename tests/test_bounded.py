"""Searches that skip blocks give the hits of those that do not, and do skip."""

from __future__ import annotations

import numpy as np
import pytest

from ctxrank.operators import bounded
from ctxrank.operators.bounded import bounded_dense_topk, bounded_sparse_topk, dense_blocks, sparse_blocks
from ctxrank.operators.search import dense_topk, sparse_topk, term_index


def clustered(r, n, centres, dims, spread=0.05):
    return centres[r.integers(0, len(centres), n)] + spread * r.normal(size=(n, dims))


@pytest.mark.parametrize("budget", [1 << 20, 2000])
@pytest.mark.parametrize("k", [3, 60])
def test_dense_hits_are_the_same(spark, budget, k):
    r = np.random.default_rng(1)
    centres = r.normal(size=(9, 8))
    rows = [(f"d{i}", v.tolist()) for i, v in enumerate(clustered(r, 1500, centres, 8))]
    rows += [(f"e{i}", rows[i][1]) for i in range(40)] + [("none", None), ("zero", [0.0] * 8)]
    docs = spark.createDataFrame(rows, "docid string, vec array<double>").repartition(6)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(clustered(r, 25, centres, 8))], "qid int, vec array<double>")
    blocks = dense_blocks(docs, size=32, clusters=12)
    assert sum(len(b.docids) for b in blocks.collect()) == 1541
    got = bounded_dense_topk(queries, blocks, k, budget)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, dense_topk(queries, docs, k).collect()))


@pytest.mark.parametrize("budget", [1 << 20, 300])
def test_sparse_hits_are_the_same(spark, budget):
    r = np.random.default_rng(2)
    rows = []
    for d in range(900):
        topic = d % 15
        terms = {f"t{topic}_{x}" for x in r.integers(0, 6, 4)} | {f"c{x}" for x in r.integers(0, 40, 3)}
        rows += [(d, t, float(r.integers(1, 9)) * (-1 if r.random() < 0.1 else 1)) for t in sorted(terms)]
    index = term_index(spark.createDataFrame(rows, "docid int, term string, weight double").repartition(5))
    asked = [(q, t, float(r.integers(-2, 6))) for q in range(12) for t in {f"t{q}_{x}" for x in range(3)} | {f"c{x}" for x in r.integers(0, 40, 3)}]
    asked += [(20, "nowhere", 1.0), (21, "c1", 0.0), (22, None, 1.0)]
    queries = spark.createDataFrame(asked, "qid int, term string, weight double")
    blocks = sparse_blocks(index, size=16)
    for k in (2, 30):
        got = bounded_sparse_topk(queries, blocks, k, budget)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, sparse_topk(queries, index, k).collect()))


def test_blocks_below_the_floor_are_not_multiplied(spark):
    r = np.random.default_rng(3)
    centres = 3 * r.normal(size=(40, 16))
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(clustered(r, 4000, centres, 16))], "docid int, vec array<double>")
    queries = spark.createDataFrame([(i, (c / 3).tolist()) for i, c in enumerate(centres)], "qid int, vec array<double>")
    blocks = dense_blocks(docs, size=50, clusters=40)
    share = bounded.dense_work(queries, blocks, 10)
    assert 0 < share < 0.2
    assert sorted(map(tuple, bounded_dense_topk(queries, blocks, 10).collect())) == sorted(map(tuple, dense_topk(queries, docs, 10).collect()))


def test_nothing_to_search(spark):
    docs = spark.createDataFrame([], "docid int, vec array<double>")
    queries = spark.createDataFrame([(1, [1.0, 2.0])], "qid int, vec array<double>")
    assert bounded_dense_topk(queries, dense_blocks(docs), 5).count() == 0
    some = dense_blocks(spark.createDataFrame([(7, [1.0, 0.0])], docs.schema))
    assert bounded_dense_topk(queries.limit(0), some, 5).count() == 0
    assert [tuple(x) for x in bounded_dense_topk(queries, some, 5).collect()] == [(1, 7, 1.0, 1)]
    index = term_index(spark.createDataFrame([], "docid int, term string, weight double"))
    asked = spark.createDataFrame([(1, "a", 1.0)], "qid int, term string, weight double")
    assert bounded_sparse_topk(asked, sparse_blocks(index), 5).count() == 0
