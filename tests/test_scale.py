"""Steps for sides of any size: block joins, deep top-k, bottom draws, moments of draws, sizes of rows."""

from __future__ import annotations

import contextlib
import hashlib
import io
import math
from collections import defaultdict
from itertools import product

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ctxrank.operators import questions as question_steps
from ctxrank.operators.questions import draw_spreads, sample_questions, sampled_scores, sampling_statistics
from ctxrank.operators.ranking import best_first, score_bucket, select_top, top_k
from ctxrank.operators.rerank import all_question_statistics
from ctxrank.operators.similarity import similarities
from ctxrank.operators.search import dense_topk
from ctxrank.session import table_bytes


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("method", [None, "cos"])
@pytest.mark.parametrize("block, block_bytes", [(512, 64 << 20), (7, 64 << 20), (5, 20_000)])
def test_block_join_equals_the_scan(spark, method, block, block_bytes):
    r = np.random.default_rng(3)
    sizes = {0: 300, 1: 1, 2: 17, 3: 40, 4: 5}
    rows = [(f"d{d}", p, r.normal(size=6).tolist()) for d, n in sizes.items() for p in range(n)] + [("d1", 9, None)]
    vectors = spark.createDataFrame(rows, "docid string, pos int, vec array<double>").repartition(5)
    queries = spark.createDataFrame([(q, r.normal(size=6).tolist()) for q in range(60)], "qid int, vec array<double>")
    pairs = [(q, f"d{d}") for q, d in product(range(62), range(6)) if d == 0 or (q + d) % 4 == 0]
    pairs = spark.createDataFrame(pairs, "qid int, docid string")
    want = similarities(pairs, queries, vectors, ("pos",), method)
    got = similarities(pairs, queries, vectors, ("pos",), method, 0, block, block_bytes)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "zip_with" not in plan(got) and "aggregate(" not in plan(got)


def test_block_join_of_nothing(spark):
    vectors = spark.createDataFrame([], "docid int, vec array<double>")
    queries = spark.createDataFrame([(1, [1.0])], "qid int, vec array<double>")
    pairs = spark.createDataFrame([(1, 1)], "qid int, docid int")
    assert similarities(pairs, queries, vectors, (), None, 0).count() == 0
    assert similarities(pairs.limit(0), queries, vectors, (), None, 0).count() == 0


@pytest.mark.parametrize("budget", [1 << 20, 0])
def test_widths_must_agree(spark, budget):
    vectors = spark.createDataFrame([(1, [2.0])], "docid int, vec array<double>")
    queries = spark.createDataFrame([(1, [1.0, 1.0])], "qid int, vec array<double>")
    pairs = spark.createDataFrame([(1, 1)], "qid int, docid int")
    with pytest.raises(Exception, match="1 dimensions, queries of 2 dimensions"):
        similarities(pairs, queries, vectors, (), None, budget).collect()
    for parts in (1, 3):
        docs = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0] * 6)], "docid int, vec array<double>")
        wide = spark.createDataFrame([(1, [1.0] * 4)], "qid int, vec array<double>")
        with pytest.raises(Exception, match="dimensions"):
            dense_topk(wide, docs.repartition(parts), 3).collect()


def test_deep_top_k_equals_the_window(spark):
    rows = spark.range(150_000).select(
        F.when(F.col("id") % 50 < 46, 0).otherwise(F.col("id") % 50).alias("qid"),
        F.col("id").alias("docid"),
        F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.rand(5) - 0.5).alias("score"),
    )
    rows = rows.cache()
    deep = top_k(rows, 100_000)
    window = Window.partitionBy("qid").orderBy(*best_first("score", "docid"))
    want = rows.withColumn("rank", F.row_number().over(window)).where("rank <= 100000")
    assert deep.exceptAll(want).isEmpty() and want.exceptAll(deep).isEmpty()
    assert "Window" in plan(deep) and "WindowGroupLimit" not in plan(deep)
    some = select_top(rows, 7, best_first("score", "docid"), score_bucket(F.col("score")))
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, want.where("rank <= 7").collect()))


def drawn_by_hand(sizes, ratio, draws, seed):
    kept = set()
    for (d, n), i in product(sizes.items(), range(draws)):
        order = sorted(range(n), key=lambda p: (hashlib.md5(f"{seed},{i},{d},{p}".encode()).hexdigest(), p))
        kept |= {(d, p, i) for p in order[: math.ceil(n * ratio)]}
    return kept


@pytest.mark.parametrize("held", [1_000_000, 40])
def test_bottom_draws(spark, monkeypatch, held):
    sizes = {1: 1, 2: 2, 3: 7, 4: 300, 5: 41}
    table = spark.createDataFrame([(d, p) for d, n in sizes.items() for p in range(n)], "docid int, pos int")
    plain = question_steps._bottom_of_draws
    monkeypatch.setattr(question_steps, "_bottom_of_draws", lambda *a: plain(*a, held))
    got = sample_questions(table.repartition(4), 0.1, 3, seed=7)
    assert {tuple(r) for r in got.select("docid", "pos", "draw").collect()} == drawn_by_hand(sizes, 0.1, 3, 7)


def test_bottom_draws_leave_most_rows_before_the_shuffle(spark):
    table = spark.range(20_000).selectExpr("0 as docid", "id as pos").coalesce(1)
    few = question_steps._bottom_of_draws(table.withColumn("_share", F.lit(5)), ["docid"], 10, 0)
    assert few.count() <= 10 * 5 * 3


def test_spreads_of_many_draws(spark):
    r = np.random.default_rng(2)
    vectors = {(d, p): 3 + r.normal(size=5) for d in range(4) for p in range(d * 7 + 1)}
    cells = {k: [int(c) for c in r.choice(6, r.integers(0, 5), replace=False)] for k in vectors}
    table = spark.createDataFrame([(*k, v.tolist()) for k, v in vectors.items()], "docid int, pos int, vec array<double>")
    members = spark.createDataFrame([(*k, c) for k, c in cells.items()], "docid int, pos int, cells array<int>")
    for levels in (1, 3):
        got = {(x.docid, x.cell): x.spread for x in draw_spreads(table.repartition(3), members, ["docid"], "pos", levels).collect()}
        groups = defaultdict(list)
        for (d, p), mine in cells.items():
            for c in mine:
                for at in range(c, (c // levels + 1) * levels):
                    groups[d, at].append(vectors[d, p])
        assert set(got) == set(groups)
        for key, rows in groups.items():
            assert got[key] == pytest.approx(np.var(rows, axis=0).mean(), abs=1e-9)


def test_sampling_of_all_ratios_equals_one_at_a_time(spark):
    r = np.random.default_rng(4)
    rows = [(n, d, p, r.normal(size=4).tolist()) for n in (1, 2) for d in range(3) for p in range(n * (d * 4 + 1))]
    table = spark.createDataFrame(rows, "n int, docid int, pos int, vec array<double>")
    queries = spark.createDataFrame([(q, r.normal(size=4).tolist()) for q in range(3)], "qid int, vec array<double>")
    pairs = spark.createDataFrame([(q, d) for q in range(3) for d in range(3)], "qid int, docid int")
    found = sampling_statistics(pairs, queries, table, (1.0, 0.3, 0.6), 4, 9, ("n",)).collect()
    got = {(x.n, x.downsample, x.qid, x.docid): (x.max_sim - 0.2 * x.spread, x.mean_sim - 0.2 * x.spread) for x in found}
    assert len(got) == len(found) == 2 * 3 * 9
    for n, ratio in product((1, 2), (0.3, 0.6, 1.0)):
        own = table.where(F.col("n") == n).drop("n")
        drawn = sample_questions(own, ratio, 4, 9)
        for i, method in enumerate(("max", "mean")):
            for x in sampled_scores(pairs, queries, drawn, own, method, 0.2).collect():
                assert got[n, ratio, x.qid, x.docid][i] == pytest.approx(x.question_score, abs=1e-9)
    with pytest.raises(ValueError):
        sampling_statistics(pairs, queries, table, (0.0, 1.0))


@pytest.mark.parametrize(
    "kind, value, size",
    [
        ("binary", b"x" * 1000, 1024),
        ("string", "é" * 10, 44),
        ("array<binary>", [b"x" * 100, b"y" * 10], 24 + 2 * 24 + 110),
        ("array<struct<a: long, b: int>>", [(1, 2)] * 5, 24 + 5 * 32),
        ("array<struct<a: string, b: array<int>>>", [("abc", [1, 2])], 24 + 16 + 27 + 40),
        ("map<string, long>", {"ab": 1, "c": 2}, 24 + 2 * 24 + 3 + 24 + 16),
        ("struct<a: binary, b: long>", (b"x" * 7, 1), 16 + 31 + 8),
        ("array<array<double>>", [[1.0, 2.0], []], 24 + 24 + 16 + 24),
        ("decimal(30, 2)", None, 16),
        ("array<string>", None, 24),
    ],
)
def test_sizes_of_values(spark, kind, value, size):
    table = spark.createDataFrame([(value,)] * 3, f"v {kind}")
    assert table_bytes(table) == 3 * size


@pytest.mark.parametrize("budget", [1 << 20, 300])
def test_every_query_meets_every_document_with_questions(spark, budget):
    r = np.random.default_rng(5)
    rows = [(d, p, r.normal(size=4).tolist()) for d, n in enumerate((700, 1, 3, 12)) for p in range(n)]
    rows += [(1, 7, None), (9, 0, None), (None, 0, [1.0] * 4)]
    queries = [(q, r.normal(size=4).tolist()) for q in (*range(40), 5, 5)] + [(77, None)]
    vectors = spark.createDataFrame(rows, "docid int, pos int, vec array<double>").repartition(3)
    asked = spark.createDataFrame(queries, "qid int, vec array<double>")
    got = {(r["qid"], r["docid"]): r for r in all_question_statistics(asked, vectors, budget).collect()}
    sims = defaultdict(list)
    for (q, a), (d, _, b) in product(queries, rows):
        if a and b and d is not None:
            sims[q, d].append(float(np.dot(a, b)))
    assert set(got) == set(sims) and len(got) == 160
    for key, values in sims.items():
        assert got[key]["questions"] == len(values)
        assert got[key]["max_sim"] == pytest.approx(max(values))
        assert got[key]["mean_sim"] == pytest.approx(sum(values) / len(values))


def test_question_similarity_takes_all_pairs(spark, tmp_path):
    from __spark_entry__ import queries

    rows = [(v, v % 3, [float(v % 7)] * 64) for v in range(1500)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    frame.write.parquet(f"{tmp_path}/embeddings.parquet")
    found = queries()["a4_question_similarity"](spark, str(tmp_path))
    # 30 of 300 groups are queries of five rows, the others documents.
    assert found.count() == 150 * 270


def test_all_pairs_take_tasks_by_their_products(spark):
    queries = spark.range(30_000).selectExpr("id as qid", "array(1.0D) as vec")
    vectors = spark.range(30_000).selectExpr("id as docid", "array(1.0D) as vec")
    parts = all_question_statistics(queries, vectors).rdd.getNumPartitions()
    assert parts * (64 << 20) >= 30_000**2 > 8 * (64 << 20)


def test_ids_of_all_pairs_take_little_of_the_result(spark, tmp_path):
    queries = spark.range(20_000).selectExpr("id as qid", "array(double(id)) as vec")
    # Document 0 has 2,001 questions, the others one each.
    vectors = spark.range(2_151).selectExpr("greatest(id - 2000, 0) as docid", "array(double(id)) as vec")
    all_question_statistics(queries, vectors).write.parquet(f"{tmp_path}/found")
    found = spark.read.parquet(f"{tmp_path}/found")
    right = """max_sim = qid * (docid + 2000) and mean_sim = qid * if(docid = 0, 1000, docid + 2000)
        and questions = if(docid = 0, 2001, 1)"""
    assert found.where(right).distinct().count() == found.count() == 20_000 * 151
    size = 0
    for file in (tmp_path / "found").glob("*.parquet"):
        parquet = pq.ParquetFile(file).metadata
        size += sum(parquet.row_group(i).column(0).total_compressed_size for i in range(parquet.num_row_groups))
    assert size < 20_000 * 151
