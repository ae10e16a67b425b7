"""Retrieval with the averaged vector of a query and its hypothetical documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxrank.functions.vectors import mean_vector, moments, text_key
from ctxrank.operators.search import dense_topk


def averaged_queries(query_vecs: DataFrame, passage_vecs: DataFrame) -> DataFrame:
    """Mean of each query's vector and the vectors of its passages.

    ``query_vecs(qid, vec)``, ``passage_vecs(qid, vec)`` -> ``(qid, vec)``.
    """
    own = query_vecs.select("qid", "vec")
    both = own.unionByName(
        passage_vecs.select("qid", "vec").join(own.select("qid"), "qid", "left_semi")
    )
    grouped = both.groupBy("qid").agg(moments(F.col("vec")).alias("_moments"))
    return grouped.select("qid", mean_vector(F.col("_moments")).alias("vec"))


def passage_vectors(prompts: DataFrame, passages: DataFrame, embeddings: DataFrame) -> DataFrame:
    """``prompts(qid, prompt_key)``, ``passages(prompt_key, passage)`` -> ``(qid, vec)``."""
    texts = prompts.select("qid", "prompt_key").join(passages, "prompt_key")
    keyed = texts.select("qid", text_key(F.col("passage")).alias("text_key"))
    return keyed.join(embeddings.select("text_key", "vec"), "text_key").select("qid", "vec")


def search_with_passages(
    query_vecs: DataFrame, passage_vecs: DataFrame, docs: DataFrame, k: int = 10
) -> DataFrame:
    """Dense search with the averaged vectors."""
    return dense_topk(averaged_queries(query_vecs, passage_vecs), docs, k)
