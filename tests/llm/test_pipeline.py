"""The pipeline on a small table: each stage on what the one before kept."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"


def test_stages_narrow_the_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert docs.columns == columns and now <= ids and len(now) == docs.count()
        ids = now
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == ids
    assert pieces.agg(F.max(F.octet_length("ids"))).first()[0] <= 4 * 4096


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0


def test_stages_on_edge_cases(spark, edges):
    """Nulls, empty and long texts, repeated rows and clashing names; each stage on the same rows."""
    stages = dict(corpus_pipeline.STAGES)
    rows = {name: stage(spark, edges, FOLDER) for name, stage in stages.items()}
    for name in list(stages)[:-1]:
        assert rows[name].columns == edges.columns
    n = edges.count()
    kept = {name: [r.doc_id for r in rows[name].select("doc_id").collect()] for name in stages}
    empties = {1, 2, 3}
    assert not empties & set(kept["quality_rules"])
    assert len(kept["line_dedup"]) == n
    # Rows 7 and 8 have the text of a row with a null id, the smallest.
    assert empties <= set(kept["near_duplicates"]) and not {7, 8, 9} & set(kept["near_duplicates"])
    assert len(kept["near_duplicates"]) == len(set(map(str, rows["near_duplicates"].select("doc_id", "text").collect())))
    assert len(kept["benchmark_decontamination"]) == n
    assert set(kept["packing"]) == {r.doc_id for r in edges.select("doc_id").collect()}
