"""Effectiveness: nDCG at a cutoff, per query and averaged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxrank.operators.ranking import top_k

CUT = 10


def _gain_sum(gain: str, rank: str) -> Column:
    return F.sum(F.col(gain) / F.log2(F.col(rank) + F.lit(1.0)))


def ideal_dcg(qrels: DataFrame, cut: int = CUT) -> DataFrame:
    """Largest reachable DCG of each judged query; 0 without a relevant document."""
    gains = qrels.select("qid", F.greatest("rel", F.lit(0)).alias("_gain"))
    best = top_k(gains, cut, order=[F.col("_gain").desc()], rank="_place")
    return best.groupBy("qid").agg(_gain_sum("_gain", "_place").alias("ideal"))


def run_dcg(
    run: DataFrame, qrels: DataFrame, cut: int = CUT, keys: tuple[str, ...] = ()
) -> DataFrame:
    """DCG of each query of a run, as trec_eval orders it.

    By score, ties by descending document id, whatever rank the run states.
    An unjudged document gains nothing. ``keys`` name the columns that tell
    several runs in one table apart.
    """
    order = [F.col("score").desc(), F.col("docid").cast("string").desc()]
    first = top_k(
        run.select(*keys, "qid", "docid", "score"), cut, [*keys, "qid"], order, "_place"
    )
    judged = first.join(qrels.select("qid", "docid", "rel"), ["qid", "docid"], "left")
    gained = judged.withColumn("_gain", F.greatest(F.coalesce("rel", F.lit(0)), F.lit(0)))
    return gained.groupBy(*keys, "qid").agg(_gain_sum("_gain", "_place").alias("dcg"))


def ndcg_per_query(run: DataFrame, qrels: DataFrame, cut: int = CUT) -> DataFrame:
    """nDCG of every judged query; a query the run leaves out scores 0."""
    ideal = ideal_dcg(qrels, cut)
    ratio = F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal"))
    return ideal.join(run_dcg(run, qrels, cut), "qid", "left").select(
        "qid", F.coalesce(ratio, F.lit(0.0)).alias("ndcg")
    )


def mean_ndcg(
    run: DataFrame, qrels: DataFrame, cut: int = CUT, keys: tuple[str, ...] = ("run_id",)
) -> DataFrame:
    """Mean nDCG over all judged queries, per run; a run that answers none of them scores 0."""
    ideal = ideal_dcg(qrels, cut)
    judged = ideal.agg(F.count("*")).scalar()
    ratio = F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0)
    return (
        run_dcg(run, qrels, cut, keys)
        .join(ideal, "qid", "left")
        .groupBy(*keys)
        .agg(F.sum(ratio).alias("_total"))
        .select(*keys, F.try_divide(F.col("_total"), judged).alias("ndcg"))
    )
