"""The index of examples against brute force, the learner on planted words, edge cases."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from .conftest import edge_texts

from ctxrank.llm import neighbours, toxicity
from ctxrank.llm.toxicity import BlockMaxIndex, Rows, weighted

FOLDER = "/root/testdata/sf0.1"


def random_rows(r, n, n_terms, most):
    sizes = r.integers(0, most + 1, n)
    terms = np.concatenate([np.sort(r.choice(n_terms, s, replace=False)) for s in sizes])
    return Rows(np.concatenate([[0], np.cumsum(sizes)]), terms, r.integers(1, 4, len(terms)).astype(float))


@pytest.mark.parametrize("n_terms, most", [(12, 3), (40, 9), (300, 30)])
def test_nearest_is_exact(n_terms, most):
    r = np.random.default_rng(n_terms)
    idf = r.random(n_terms) + 0.1
    examples, queries = (weighted(random_rows(r, n, n_terms, most), idf) for n in (700, 300))
    index = BlockMaxIndex.build(examples, n_terms)
    dense = lambda rows: np.stack([np.bincount(rows.terms[a:b], rows.values[a:b], n_terms) for a, b in zip(rows.starts, rows.starts[1:])])
    # Products are added in the order of the terms, as the index adds them.
    cosines = np.zeros((300, 700))
    for term in range(n_terms):
        cosines += dense(queries)[:, [term]] * dense(examples)[:, term]
    shares_term = (dense(queries) > 0).astype(int) @ (dense(examples) > 0).astype(int).T > 0
    query, number, cosine, searched = index.nearest(queries, 7)
    for q in range(300):
        mine = query == q
        want = np.sort(cosines[q][shares_term[q]])[::-1][:7]
        assert np.allclose(cosine[mine], want, rtol=0, atol=1e-12)
        assert np.allclose(cosines[q][number[mine]], cosine[mine], rtol=0, atol=1e-12)
        assert list(zip(-cosine[mine], number[mine])) == sorted(zip(-cosine[mine], number[mine]))
        best = sorted((-cosines[q][i], i) for i in np.flatnonzero(shares_term[q]))[:7]
        assert [i for _, i in best] == list(number[mine])
    assert searched <= 300 * index.n_blocks
    one = [index.nearest(queries.take(np.array([q])), 7)[1:3] for q in range(40)]
    for q, (n, c) in enumerate(one):
        assert (n == number[query == q]).all() and (c == cosine[query == q]).all()


def test_bounds_skip_blocks():
    r = np.random.default_rng(1)
    sizes = np.full(3000, 2)
    terms = np.stack([r.integers(0, 10, 3000), r.integers(10, 20, 3000)], 1).ravel()
    rows = weighted(Rows(np.concatenate([[0], np.cumsum(sizes)]), terms, np.ones(6000)), np.ones(20))
    index = BlockMaxIndex.build(rows, 20)
    *_, searched = index.nearest(rows, 5)
    assert searched < 0.1 * 3000 * index.n_blocks


def test_held_out_accuracy(spark):
    import __spark_entry__ as entry

    scored = entry.queries()["op13_toxicity"](spark, FOLDER)
    rows = scored.where("held_out").join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id").collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert len(toxic) > 100
    assert np.mean([r.predicted for r in toxic]) > 0.9 and np.mean([r.predicted for r in clean]) < 0.01
    # Calibrated: the mean score is near the share of toxic documents.
    assert abs(np.mean([r.score for r in rows]) - len(toxic) / len(rows)) < 0.02


def test_scores_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where(~neighbours.held_out(F.col("doc_id")))
    seen = []
    for n in (1, 7, 40):
        model, counted = toxicity.fit(docs.repartition(n), labels.repartition(n))
        seen.append(sorted((r.doc_id, r.score, [e.doc_id for e in r.evidence]) for r in toxicity.score(counted, model).collect()))
    assert seen[0] == seen[1] == seen[2]


def test_edges(spark, edges, nothing, no_labels):
    bad = [(100 + i, f"word{i} du bist ein Blödmann und Schuft{i % 3}") for i in range(40)]
    good = [(200 + i, f"word{i} das ist ein schöner Satz ohne Streit") for i in range(120)]
    data = spark.createDataFrame(bad + good, "doc_id long, text string")
    docs = data.unionByName(edges.select("doc_id", "text"))
    docs = docs.unionByName(spark.createDataFrame([(900, "BLÖDMANN! schufte"), (901, "Schuft1, du Blödmann."), (902, "Satz")], data.schema))
    rows = [(d, 1, 1) for d, _ in bad] + [(d, 1, 0) for d, _ in good] + [(None, 1, 1), (20, 1, None), (100, 0, 0)]
    model, counted = toxicity.fit(docs, spark.createDataFrame(rows, no_labels.schema))
    found = {r.doc_id: r for r in toxicity.score(counted, model).collect()}
    assert counted.count() == len(bad) + len(good) + len(edge_texts()) + 3
    assert found[901].score > 0.7 > found[902].score and all(e.toxic for e in found[901].evidence)
    assert found[1].score == found[2].score == found[20].score < 0.3 and found[1].evidence == []
    assert found[900].evidence and all(0 <= r.score <= 1 for r in found.values())
    model, counted = toxicity.fit(edges, no_labels)
    assert {r.score for r in toxicity.score(counted, model).collect()} == {0.5}
    model, counted = toxicity.fit(nothing, no_labels)
    assert toxicity.score(counted, model).count() == 0
