"""What bounds the memory, the driver and the shuffles of searches, model calls and stores."""

from __future__ import annotations

import contextlib
import io
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

import ctxrank.sources.store as store_module
from ctxrank.operators import bounded, search
from ctxrank.operators.models import encode_texts, generate
from ctxrank.operators.questions import cut_no_content, question_vectors
from ctxrank.operators.search import dense_topk, sparse_topk, term_index
from ctxrank.session import by_bytes, new_folder, stage
from ctxrank.sources.store import generated_store
from workload.fixtures import term_weights


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("kind", ["int", "string"])
def test_large_query_sides_do_not_pass_the_driver(spark, monkeypatch, kind):
    r = np.random.default_rng(1)
    docs = spark.createDataFrame([(i, r.normal(size=8).tolist()) for i in range(900)], "docid int, vec array<double>")
    rows = [(i, r.normal(size=8).tolist()) for i in range(300)] + [(1000, None)]
    queries = spark.createDataFrame(rows, "qid int, vec array<double>")
    docs, queries = (d.withColumn(c, F.col(c).cast(kind)) for d, c in ((docs, "docid"), (queries, "qid")))
    want = sorted(map(tuple, dense_topk(queries, docs, 7).collect()))
    monkeypatch.setattr(DataFrame, "toArrow", None)
    got = dense_topk(queries, docs, 7, broadcast_bytes=500)
    assert sorted(map(tuple, got.collect())) == want and len(want) == 2100
    monkeypatch.undo()
    pieces = search._cogrouped_search(queries.where("vec is not null"), docs, 7, piece_bytes=3000, hits=400)
    assert sorted(map(tuple, search.top_k(pieces, 7).collect())) == want


def test_cogrouped_search_of_nothing(spark):
    docs = spark.createDataFrame([(1, [1.0])], "docid long, vec array<double>")
    queries = spark.createDataFrame([(1, [1.0])], "qid long, vec array<double>")
    assert dense_topk(queries, docs.limit(0), 3, broadcast_bytes=1).count() == 0
    assert dense_topk(queries.limit(0), docs, 3, broadcast_bytes=0).count() == 0


def test_hits_sorted_at_once_are_bounded(monkeypatch):
    sizes, merge = [], search._merge
    monkeypatch.setattr(search, "_merge", lambda kept, floor, k: sizes.append(len(floor) * k) or merge(kept, floor, k))
    r = np.random.default_rng(2)
    queries, docs = r.normal(size=(900, 4)), r.normal(size=(1500, 4))
    found = list(search._running_top_k(1000)(queries, [(np.arange(1500), docs)]))
    assert sum(len(col) for col, _, _ in found) == 900_000
    assert max(sizes) <= 250_000


def test_term_scan_takes_few_documents_at_once(spark):
    """The scan's own arrays follow neither the rows of a batch nor the products of its terms."""
    queries = spark.createDataFrame([(q, f"t{t}", 1) for q in range(50) for t in range(0, 60, 2)], "qid long, term string, weight long")
    scans = []
    schema = T.StructType().add("docid", T.LongType())
    index = SimpleNamespace(
        schema=schema,
        sparkSession=SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda value: SimpleNamespace(value=value))),
        mapInArrow=lambda scan, schema: scans.append(scan),
    )
    search._scan_terms(queries, index, 10)
    rows, each = 10_000, 60
    terms = pa.ListArray.from_arrays(np.arange(0, rows * each + 1, each, dtype=np.int32), pa.array([f"t{t}" for t in range(each)] * rows))
    weights = pa.ListArray.from_arrays(terms.offsets, pa.array(np.tile(np.arange(each, dtype=float), rows)))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(rows)), terms, weights], names=["docid", "terms", "weights"])
    tracemalloc.start()
    found = list(scans[0](iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(b.num_rows for b in found) == 500
    # All documents score the same, so the first ten are the best.
    assert {d for b in found for d in b.column(1).to_pylist()} == set(range(10))
    assert peak < 150e6


def test_terms_are_counted_in_tasks_of_bounded_size(spark):
    texts = spark.createDataFrame([(i % 50, f"a b b w{i % 7}") for i in range(400)] + [(None, "a"), (3, None)], "docid long, text string")
    assert by_bytes(texts, "docid", 1000).rdd.getNumPartitions() > by_bytes(texts, "docid").rdd.getNumPartitions()
    counted = term_weights(texts, "docid", "text")
    weights = {(r["docid"], r["term"]): r["weight"] for r in counted.collect()}
    assert weights[0, "b"] == 16 and weights[None, "a"] == 1
    # Texts are dealt out by document once; neither counting nor gathering needs another shuffle.
    assert plan(term_index(counted)).count("(Exchange)") <= 1 or plan(term_index(counted)).count("Arguments: hashpartitioning") == 1


def test_scan_of_plain_postings_counts_nothing_itself(spark):
    """A task of the scan reads several splits; sums made in it would all be held by that one task."""
    postings = spark.createDataFrame([(d, f"t{t}", 1 + d % 3) for d in range(60) for t in range(d % 5, 9)], "docid long, term string, weight long")
    queries = spark.createDataFrame([(0, "t3", 2), (0, "t7", 1), (1, "t1", 1), (1, None, 1)], "qid long, term string, weight long")
    hits = sparse_topk(queries, postings, 4, scan_tasks=2)
    assert "Aggregate" not in plan(hits)
    assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, sparse_topk(queries, term_index(postings), 4).collect()))


def test_index_is_sorted_in_tasks_of_bounded_size(spark, monkeypatch):
    rows = [(d, f"t{t}", float(1 + (d * t) % 7)) for d in range(300) for t in range(10)]
    index = stage(term_index(spark.createDataFrame(rows, "docid long, term string, weight double")))
    monkeypatch.setattr(bounded, "TASK_ENTRIES", 50)
    asked, kind = [], type(index)
    repartition = kind.repartitionByRange
    monkeypatch.setattr(kind, "repartitionByRange", lambda df, *args: asked.append(args[0]) or repartition(df, *args))
    blocks = bounded.sparse_blocks(index)
    assert asked == [60]
    assert sorted(d for b in blocks.collect() for d in b["docids"]) == list(range(300))


def test_models_get_few_texts_a_call(spark):
    def make_generator():
        return lambda prompts, n, temperature: [[str(len(prompts))] * n for _ in prompts]

    def make_encoder():
        return lambda texts: [[float(len(texts))] for _ in texts]

    rows = spark.range(0, 3000, 1, 1).select(F.col("id").cast("string").alias("prompt_key"), F.lit("p").alias("prompt"))
    written = generate(rows, make_generator, 2).collect()
    assert len(written) == 6000 and max(int(r["text"]) for r in written) <= 512
    assert sorted({r["choice"] for r in written}) == [0, 1]
    texts = rows.select(F.col("prompt_key").alias("text_key"), F.col("prompt").alias("text"))
    vectors = encode_texts(texts, make_encoder).collect()
    assert len(vectors) == 3000 and max(r["vec"][0] for r in vectors) <= 512


def test_cuts_that_fit_leave_questions_in_place(spark):
    rows = [(d, p, "no content" if (d, p) in ((1, 2), (2, 0)) else f"question {p}") for d in range(4) for p in range(4)]
    questions = stage(spark.createDataFrame(rows, "docid int, pos int, question string"))
    cut = cut_no_content(questions)
    assert sorted((r["docid"], r["pos"]) for r in cut.collect()) == [
        *[(0, p) for p in range(4)], (1, 0), (1, 1), (2, 0), *[(3, p) for p in range(4)]
    ]
    assert "Exchange (hash" not in plan(cut) and "SortMergeJoin" not in plan(cut)


def test_question_vectors_by_rows_of_a_table(spark):
    questions = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "a"), (3, 0, "unknown")], "docid int, pos int, question string")
    key = F.sha2(F.col("t"), 256).alias("text_key")
    rows = spark.createDataFrame([("a", 7), ("b", 8), ("c", 7)], "t string, vec_id long").select(key, "vec_id")
    table = spark.createDataFrame([(7, [1.0]), (8, [2.0]), (9, [3.0])], "vec_id long, vec array<float>")
    whole = rows.join(table, "vec_id").select("text_key", "vec")
    want = sorted((r["docid"], r["pos"], r["vec"]) for r in question_vectors(questions, whole).collect())
    got = question_vectors(questions, rows, table)
    assert got.columns == ["docid", "pos", "vec"]
    assert sorted(map(tuple, got.collect())) == want == [(1, 0, [1.0]), (1, 1, [2.0]), (2, 0, [1.0])]


def test_first_append_writes_its_rows_once_before_clustering(spark, monkeypatch):
    staged, original = [], store_module.stage
    monkeypatch.setattr(store_module, "stage", lambda df: staged.append(df) or original(df))
    store = generated_store(new_folder(spark, "store"), "questions", "m", "t")
    rows = spark.createDataFrame([("a", 0, "x"), ("b", 0, "y")], "prompt_key string, pos int, text string")
    store.append(rows)
    assert not staged
    store.append(rows.withColumn("prompt_key", F.lit("a")).limit(1))
    assert store.read(spark).count() == 2 and staged


def test_staged_tables_are_packed_closely(spark):
    files = stage(spark.range(10)).inputFiles()
    assert files and all(f.endswith(".zstd.parquet") or f.endswith(".zst.parquet") for f in files)
