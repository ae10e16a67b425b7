"""Re-ranking candidates: by a second embedding and by hypothetical questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxrank.functions.vectors import mean_vector, moments, spread
from ctxrank.operators.ranking import best_first, rank_all, score_bucket, top_k
from ctxrank.operators.similarity import METHODS as SIMILARITY_METHODS
from ctxrank.operators.similarity import every_similarity, similarities
from ctxrank.session import BROADCAST_BYTES, matching, stage

# The defaults of the question rerank.
QUESTION_COEF = 0.4
SPREAD_COEF = 0.0
FIRST_N = 30
TAIL_PENALTY = 1e6

METHODS = ("max", "mean")


def rerank_by_vector(
    hits: DataFrame,
    query_vecs: DataFrame,
    doc_vecs: DataFrame,
    k: int | None = None,
    method: str | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Score candidates again with other vectors and rank them by that score.

    ``hits(qid, docid, rank, score)`` keeps its shape. Without a method the
    score is the dot product, with ``"cos"`` the cosine; any other method, or
    a missing vector, leaves the score as it was. Ties keep the previous
    order. ``k`` keeps the first k. Candidates that fit are broadcast, so the
    document vectors are scanned in place.
    """
    base = hits.select("qid", "docid", F.col("rank").alias("_previous"), "score")
    if method in SIMILARITY_METHODS:
        scores = similarities(
            base, query_vecs, doc_vecs, method=method, broadcast_bytes=broadcast_bytes
        )
        base = base.join(scores, ["qid", "docid"], "left").select(
            "qid", "docid", "_previous", F.coalesce("sim", "score").alias("score")
        )
    order = best_first("score", "_previous")
    if k is None:
        ranked = rank_all(stage(base), order, score_bucket(F.col("score")))
    else:
        ranked = top_k(base, k, order=order)
    return ranked.drop("_previous")


def head(hits: DataFrame, first_n: int = FIRST_N) -> DataFrame:
    """The candidates that are scored by their questions."""
    return hits.where(F.col("rank") <= first_n)


def question_statistics(
    pairs: DataFrame,
    query_vecs: DataFrame,
    questions: DataFrame,
    with_spread: bool = True,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Per candidate: best and mean question similarity, and the questions' spread.

    ``questions(docid, pos, vec)``. All aggregates combine on the map side. A
    document's spread is computed once for all its queries, and not at all
    ``with_spread=False``, for when it has no weight.
    """
    sims = similarities(
        pairs, query_vecs, questions, ("pos",), broadcast_bytes=broadcast_bytes
    )
    stats = sims.groupBy("qid", "docid").agg(
        F.max("sim").alias("max_sim"),
        F.avg("sim").alias("mean_sim"),
        F.count("*").alias("questions"),
    )
    if not with_spread:
        return stats.withColumn("spread", F.lit(0.0))
    wanted = matching(questions, pairs, "docid", broadcast_bytes)
    return stats.join(document_statistics(wanted).select("docid", "spread"), "docid")


def all_question_statistics(
    query_vecs: DataFrame, questions: DataFrame, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """``(qid, docid, max_sim, mean_sim, questions)`` of every query and every document with questions.

    The result has a row per query and document, so it grows with their product; what is
    shuffled are the questions alone, and no pairs are made or kept.
    """
    return every_similarity(query_vecs, questions, broadcast_bytes)


def document_statistics(vectors: DataFrame, keys: tuple[str, ...] = ("docid",)) -> DataFrame:
    """Mean vector and spread of each document's questions, in one aggregate."""
    grouped = vectors.groupBy(*keys).agg(moments(F.col("vec")).alias("_moments"))
    return grouped.select(
        *keys,
        F.col("_moments.count").alias("questions"),
        mean_vector(F.col("_moments")).alias("mean_vec"),
        spread(F.col("_moments")).alias("spread"),
    )


def question_score(method: str | Column, spread_coef: float | Column) -> Column:
    """Best or mean similarity, less the weighted spread."""
    if isinstance(method, str):
        if method not in METHODS:
            raise ValueError(f"method must be one of {METHODS}, got {method!r}")
        method = F.lit(method)
    best = F.when(method == "mean", F.col("mean_sim")).otherwise(F.col("max_sim"))
    return best - spread_coef * F.col("spread")


def score_candidates(
    pairs: DataFrame,
    query_vecs: DataFrame,
    questions: DataFrame,
    method: str = "max",
    spread_coef: float = SPREAD_COEF,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``(qid, docid, question_score)`` of each candidate with questions."""
    stats = question_statistics(
        pairs,
        query_vecs,
        questions,
        with_spread=spread_coef != 0,
        broadcast_bytes=broadcast_bytes,
    )
    score = question_score(method, spread_coef).alias("question_score")
    return stats.select("qid", "docid", score)


def combined_score(coef: float | Column) -> Column:
    """Base score plus the weighted question score; without questions the base score."""
    return F.col("score") + F.coalesce(coef * F.col("question_score"), F.lit(0.0))


def rerank_by_questions(
    hits: DataFrame,
    scores: DataFrame,
    coef: float = QUESTION_COEF,
    first_n: int = FIRST_N,
    tail: str = "penalise",
) -> DataFrame:
    """Rank the first ``first_n`` candidates of each query by the combined score.

    ``hits(qid, docid, rank, score)`` and ``scores(qid, docid,
    question_score)`` give the new rank, the combined score, and the base rank
    and question score. With ``tail="penalise"`` later candidates stay below
    in their order, so only the ``first_n`` rows of a query are sorted;
    ``tail="literal"`` instead takes the penalty, once per later candidate,
    off the last of the first ``first_n``.
    """
    if tail not in ("penalise", "literal"):
        raise ValueError(f"tail must be 'penalise' or 'literal', got {tail!r}")
    base = hits.select("qid", "docid", F.col("rank").alias("base_rank"), "score")
    first = base.where(F.col("base_rank") <= first_n)
    later = base.where(F.col("base_rank") > first_n)
    scored = first.join(scores.select("qid", "docid", "question_score"), ["qid", "docid"], "left")
    scored = scored.withColumn("score", combined_score(coef))
    order = best_first("score", "base_rank")
    if tail == "literal":
        later = later.withColumn("question_score", F.lit(0.0))
        penalty = F.lit(-TAIL_PENALTY)
        sizes = later.groupBy("qid").agg(F.count("*").alias("_later"))
        hit = (F.col("base_rank") == first_n) & F.col("_later").isNotNull()
        scored = (
            scored.join(sizes, "qid", "left")
            .withColumn("score", F.when(hit, F.col("score") + penalty * F.col("_later")).otherwise(F.col("score")))
            .withColumn("question_score", F.when(hit, penalty).otherwise(F.col("question_score")))
            .drop("_later")
        )
        whole = stage(scored.unionByName(later))
        ranked = rank_all(whole, order, score_bucket(F.col("score")))
    else:
        place = F.row_number().over(Window.partitionBy("qid").orderBy(*order))
        scored = scored.withColumn("rank", place)
        later = (
            later.withColumn("score", F.col("score") - TAIL_PENALTY)
            .withColumn("question_score", F.lit(-TAIL_PENALTY))
            .withColumn("rank", F.col("base_rank"))
        )
        ranked = scored.unionByName(later)
    return ranked.select("qid", "docid", "rank", "score", "base_rank", "question_score")
