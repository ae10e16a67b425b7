"""Text formats: topics, judgements, run files and raw corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxrank.session import spread

# The constant fields of a run line and the lines kept per query.
RUN_ITERATION = "Q0"
RUN_TAG = "rank"
RUN_DEPTH = 100


def parse_topics(lines: DataFrame) -> DataFrame:
    """``qid<TAB>title`` lines -> ``(qid, title)``."""
    parts = F.split("value", "\t", 2)
    return lines.where(F.trim("value") != "").select(
        parts[0].alias("qid"), F.trim(parts[1]).alias("title")
    )


def parse_qrels(lines: DataFrame) -> DataFrame:
    """``qid iteration docid rel`` lines -> ``(qid, docid, rel)``."""
    parts = F.split(F.trim("value"), r"\s+")
    return lines.where(F.trim("value") != "").select(
        parts[0].alias("qid"), parts[2].alias("docid"), parts[3].cast("int").alias("rel")
    )


def parse_run(lines: DataFrame) -> DataFrame:
    """``qid Q0 docid rank score tag`` lines -> ``(qid, docid, rank, score)``."""
    parts = F.split(F.trim("value"), r"\s+")
    return lines.where(F.trim("value") != "").select(
        parts[0].alias("qid"),
        parts[2].alias("docid"),
        parts[3].cast("int").alias("rank"),
        parts[4].cast("double").alias("score"),
    )


def run_line(qid: Column, docid: Column, rank: Column, score: Column) -> Column:
    """One line of a run file."""
    return F.concat_ws(" ", qid, F.lit(RUN_ITERATION), docid, rank, score, F.lit(RUN_TAG))


def run_lines(hits: DataFrame, depth: int | None = RUN_DEPTH) -> DataFrame:
    """``(qid, rank, line)`` of the first ``depth`` hits of each query."""
    kept = hits if depth is None else hits.where(F.col("rank") <= depth)
    line = run_line(F.col("qid"), F.col("docid"), F.col("rank"), F.col("score"))
    return kept.select("qid", "rank", line.alias("line"))


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    return parse_topics(spark.read.text(path))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    return parse_qrels(spark.read.text(path))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Corpus of JSON lines with an ``id`` or ``_id`` -> ``(docid, raw)``."""
    lines = spark.read.text(path)
    docid = F.coalesce(F.get_json_object("value", "$.id"), F.get_json_object("value", "$._id"))
    return spread(lines.select(docid.alias("docid"), F.col("value").alias("raw")), "docid")


def write_run(hits: DataFrame, path: str, run_id: str, depth: int | None = RUN_DEPTH) -> None:
    """Write a run under ``path/run_id=...``, replacing only that run.

    Lines are in rank order within a query. With a depth, a query's few lines
    are in one file; without one they may go on in the next file.
    """
    lines = run_lines(hits, depth)
    lines = lines.repartitionByRange("qid", "rank") if depth is None else lines.repartition("qid")
    ordered = lines.sortWithinPartitions("qid", "rank").select("line")
    ordered.write.mode("overwrite").text(f"{path}/run_id={run_id}")


def read_run(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """Read one run, or all runs under ``path`` with their ``run_id``."""
    if run_id is not None:
        return parse_run(spark.read.text(f"{path}/run_id={run_id}"))
    # With its type given, a run id such as 007 stays as it is written.
    lines = spark.read.schema("value string, run_id string").text(path)
    parts = parse_run(lines.select("value")).columns
    split = F.split(F.trim("value"), r"\s+")
    return lines.select(
        "run_id",
        split[0].alias(parts[0]),
        split[2].alias(parts[1]),
        split[3].cast("int").alias(parts[2]),
        split[4].cast("double").alias(parts[3]),
    )
