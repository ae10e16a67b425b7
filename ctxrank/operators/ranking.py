"""Ranks within a query: top-k, full ranks, rank movement, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxrank.session import broadcast_within, stage


def best_first(score: str = "score", *ties: str) -> list[Column]:
    """Order by score, best first, and then by the tie columns."""
    return [F.col(score).desc(), *[F.col(t).asc() for t in ties]]


def top_k(
    df: DataFrame,
    k: int,
    keys: list[str] | None = None,
    order: list[Column] | None = None,
    rank: str = "rank",
) -> DataFrame:
    """The k first rows per key, with their 1-based rank.

    Spark limits each task to k rows per key before the shuffle, so a key with
    any number of rows costs the final sort at most k rows per task. It does so
    up to ``spark.sql.optimizer.windowGroupLimitThreshold``, by default 1000; a larger k of
    scores is selected by their counts, without a task that holds a key.
    """
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
    if k > limit and order is None:
        bucket = score_bucket(F.col("score"))
        return select_top(stage(df), k, best_first("score", "docid"), bucket, keys, rank)
    window = Window.partitionBy(*(keys or ["qid"])).orderBy(
        *(order or best_first("score", "docid"))
    )
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def score_bucket(score: Column) -> Column:
    """A coarse integer that never falls as the score falls.

    Logarithmic in the score's size, so it separates small and large scores
    alike and takes a bounded number of values. As in a falling sort, NaN comes
    first, with infinity, and null last.
    """
    end = 1 << 40
    size = F.floor(F.least(F.log2(1 + F.abs(score) * F.lit(2.0**20)) * 1024, F.lit(float(end))))
    known = F.when(score < 0, size + 1).otherwise(-size)
    return F.when(score.isNull(), F.lit(end + 2)).otherwise(known)


def select_top(
    df: DataFrame,
    k: int | None,
    order: list[Column],
    bucket: Column,
    keys: list[str] | None = None,
    rank: str = "rank",
) -> DataFrame:
    """The k first rows per key, or all, with their exact 1-based rank, for k and keys of any size.

    ``bucket`` never falls along ``order`` and is never null. Rows are counted per
    bucket with map-side combining; the counts tell the last bucket that can reach k,
    and rows of later ones are dropped before they are shuffled. A row's rank is the
    count of the lower buckets plus its place in its own, so no task sorts a whole
    key. The rows are read twice, so an order that rests on computed scores wants
    them staged.
    """
    keys = keys or ["qid"]
    binned = df.withColumn("_bucket", bucket)
    lower = (
        Window.partitionBy(*keys)
        .orderBy("_bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        binned.groupBy(*keys, "_bucket")
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(lower), F.lit(0)))
        .drop("_n")
    )
    if k is not None:
        # The bounds of all keys, where they fit, drop rows where they are scanned.
        offsets = stage(offsets.where(F.col("_before") < k))
        offsets = broadcast_within(offsets) or offsets
    place = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order))
    ranked = (
        binned.join(offsets, [*keys, "_bucket"])
        .withColumn(rank, (F.col("_before") + place).cast("int"))
        .drop("_bucket", "_before")
    )
    return ranked if k is None else ranked.where(F.col(rank) <= k)


def rank_all(
    df: DataFrame,
    order: list[Column],
    bucket: Column,
    keys: list[str] | None = None,
    rank: str = "rank",
) -> DataFrame:
    """Exact 1-based rank of every row, for keys of any size; see ``select_top``."""
    return select_top(df, None, order, bucket, keys, rank)


def rank_shift(base: DataFrame, reranked: DataFrame) -> DataFrame:
    """Rank of each candidate before and after, and how far it moved up."""
    before = base.select("qid", "docid", F.col("rank").alias("base_rank"))
    after = reranked.select("qid", "docid", F.col("rank").alias("new_rank"))
    return before.join(after, ["qid", "docid"]).withColumn(
        "moved_up", F.col("base_rank") - F.col("new_rank")
    )


def score_range(hits: DataFrame) -> DataFrame:
    """Lowest and highest score of each query's hits."""
    return hits.groupBy("qid").agg(
        F.min("score").alias("min_score"), F.max("score").alias("max_score")
    )


def fingerprint(hits: DataFrame) -> DataFrame:
    """SHA-256 of each query's candidate ids, joined in the order of their rank.

    A list is as long as the retrieval is deep, so a query's ids are gathered whole.
    """
    ordered = F.array_sort(F.collect_list(F.struct("rank", F.col("docid").cast("string").alias("_id"))))
    joined = F.array_join(F.transform(ordered, lambda place: place["_id"]), "")
    return hits.groupBy("qid").agg(F.sha2(joined, 256).alias("fingerprint"))
