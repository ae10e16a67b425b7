"""Queries over vectors: retrieval, reranking, evaluation, sweep."""

from __future__ import annotations

from pyspark.sql import functions as F

from ctxrank.functions.vectors import cosine, dot, flatten_vector, norm, unit
from ctxrank.operators.bounded import bounded_dense_topk, dense_blocks
from ctxrank.operators.evaluate import mean_ndcg, ndcg_per_query
from ctxrank.operators.hypodocs import averaged_queries, search_with_passages
from ctxrank.operators.questions import sample_questions, sampled_scores, sampling_statistics
from ctxrank.operators.ranking import fingerprint, rank_shift, score_range, top_k
from ctxrank.operators.rerank import (
    all_question_statistics,
    document_statistics,
    head,
    question_statistics,
    rerank_by_questions,
    rerank_by_vector,
    score_candidates,
)
from ctxrank.operators.search import dense_topk, judged
from ctxrank.plans.sweep import compare, encoder_grid, grid, sampling_grid, sweep
from ctxrank.session import stage
from ctxrank.sources.trec import parse_run, run_lines
from workload.fixtures import (
    DOCUMENT_QRELS,
    QUESTION_STATS,
    VECTOR_QRELS,
    VECTORS,
    context_vectors,
    document_qrels,
    document_vectors,
    ndcg_sql,
    query_vectors,
    question_table,
    rerank_sql,
    vector_hits,
    vector_hits_sql,
    vector_qrels,
    vectors,
)
from workload.registry import query

K = 50
HITS = vector_hits_sql(K)
# Hits among all rows of the table.
DOCUMENT_HITS = vector_hits_sql(K, "dv")


def statistics(spark, sf, pairs, with_spread=True):
    queries, questions = query_vectors(spark, sf), question_table(spark, sf)
    return question_statistics(pairs, queries, questions, with_spread)


def reranked_run(spark, sf, coef=0.4, spread_coef=0.0, method="max", first_n=30, tail="penalise"):
    hits = vector_hits(spark, sf, K)
    queries, questions = query_vectors(spark, sf), question_table(spark, sf)
    scores = score_candidates(head(hits, first_n), queries, questions, method, spread_coef)
    return rerank_by_questions(hits, scores, coef, first_n, tail)


def rounded(df, *columns):
    for column in columns:
        df = df.withColumn(column, F.round(column, 6))
    return df


def rounded_vector(column):
    return F.transform(column, lambda x: F.round(x, 6))


# --- expressions ---------------------------------------------------------


@query(
    "f11_dot",
    f"""WITH {VECTORS}
    SELECT h.docid, pos, round(list_dot_product(h.vec, cv.vec), 6) AS sim
    FROM hv h JOIN cv USING (docid)""",
)
def f11_dot(spark, sf):
    contexts = context_vectors(spark, sf).select("docid", F.col("vec").alias("own"))
    both = question_table(spark, sf).join(contexts, "docid")
    return both.select("docid", "pos", F.round(dot(F.col("vec"), F.col("own")), 6).alias("sim"))


@query(
    "f12_unit_vector",
    f"""WITH {VECTORS}, lengths AS (
        SELECT vec_id, vec, sqrt(list_sum(list_transform(vec, lambda x: x * x))) AS len FROM emb)
    SELECT vec_id, round(len, 6) AS length,
           list_transform(vec, lambda x: round(x / len, 6)) AS unit_vec FROM lengths""",
    vector="unit_vec",
)
def f12_unit_vector(spark, sf):
    vec = F.col("vec")
    return vectors(spark, sf).select(
        "vec_id", F.round(norm(vec), 6).alias("length"), rounded_vector(unit(vec)).alias("unit_vec")
    )


@query(
    "f13_cosine",
    f"""WITH {VECTORS}
    SELECT h.docid, pos, round(list_cosine_similarity(h.vec, cv.vec), 6) AS sim
    FROM hv h JOIN cv USING (docid)""",
)
def f13_cosine(spark, sf):
    contexts = context_vectors(spark, sf).select("docid", F.col("vec").alias("own"))
    both = question_table(spark, sf).join(contexts, "docid")
    return both.select("docid", "pos", F.round(cosine(F.col("vec"), F.col("own")), 6).alias("sim"))


@query(
    "f14_flatten_vector",
    "SELECT vec_id, embedding::DOUBLE[] AS vec FROM embeddings",
    vector="vec",
)
def f14_flatten_vector(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    half = F.floor(F.size("embedding") / 2).cast("int")
    nested = F.array(
        F.slice("embedding", F.lit(1), half), F.slice("embedding", half + 1, F.size("embedding") - half)
    )
    return rows.select("vec_id", flatten_vector(nested).alias("vec"))


# --- document statistics -------------------------------------------------


@query(
    "a1_mean_vector",
    f"""WITH {VECTORS}, means AS (
        SELECT docid, i, avg(vec[i]) AS m FROM hv, range(1, 65) r(i) GROUP BY docid, i)
    SELECT docid, list(round(m, 6) ORDER BY i) AS mean_vec FROM means GROUP BY docid""",
    vector="mean_vec",
)
def a1_mean_vector(spark, sf):
    stats = document_statistics(question_table(spark, sf))
    return stats.select("docid", rounded_vector(F.col("mean_vec")).alias("mean_vec"))


@query(
    "a3_spread",
    f"""WITH {VECTORS}, dims AS (
        SELECT docid, i, var_pop(vec[i]) AS v, count(*) AS n
        FROM hv, range(1, 65) r(i) GROUP BY docid, i)
    SELECT docid, max(n) AS questions, round(avg(v), 6) AS spread FROM dims GROUP BY docid""",
)
def a3_spread(spark, sf):
    stats = document_statistics(question_table(spark, sf))
    return rounded(stats.select("docid", "questions", "spread"), "spread")


@query(
    "a7_hypodoc_vector",
    f"""WITH {VECTORS}, own AS (SELECT docid AS qid, vec FROM cv),
    both_vecs AS (SELECT qid, vec FROM own UNION ALL SELECT docid, vec FROM hv),
    means AS (SELECT qid, i, avg(vec[i]) AS m FROM both_vecs, range(1, 65) r(i) GROUP BY qid, i)
    SELECT qid, list(round(m, 6) ORDER BY i) AS vec FROM means GROUP BY qid""",
    vector="vec",
)
def a7_hypodoc_vector(spark, sf):
    own = context_vectors(spark, sf).withColumnRenamed("docid", "qid")
    passages = question_table(spark, sf).withColumnRenamed("docid", "qid")
    mean = averaged_queries(own, passages)
    return mean.select("qid", rounded_vector(F.col("vec")).alias("vec"))


# --- retrieval -----------------------------------------------------------


@query(
    "c2_dense_topk",
    f"""WITH {VECTORS}, {DOCUMENT_HITS}
    SELECT qid, docid, rank, round(score, 6) AS score FROM hits""",
)
def c2_dense_topk(spark, sf):
    hits = dense_topk(query_vectors(spark, sf), document_vectors(spark, sf), K)
    return rounded(hits, "score")


@query(
    "c2_dense_topk_cells",
    f"""WITH {VECTORS}, {DOCUMENT_HITS}
    SELECT qid, docid, rank, round(score, 6) AS score FROM hits""",
)
def c2_dense_topk_cells(spark, sf):
    """The same search in blocks of queries, as for query sides too large to broadcast."""
    queries, docs = query_vectors(spark, sf), document_vectors(spark, sf)
    hits = dense_topk(queries, docs, K, broadcast_bytes=8192)
    return rounded(hits, "score")


@query(
    "c2_dense_topk_bounded",
    f"""WITH {VECTORS}, {DOCUMENT_HITS}
    SELECT qid, docid, rank, round(score, 6) AS score FROM hits""",
)
def c2_dense_topk_bounded(spark, sf):
    """The same hits from blocks with a centroid and a radius, skipping those below the floors."""
    blocks = dense_blocks(document_vectors(spark, sf))
    return rounded(bounded_dense_topk(query_vectors(spark, sf), blocks, K), "score")


@query(
    "p1_judged_topics",
    f"""WITH {VECTORS}, {VECTOR_QRELS}
    SELECT qid, label FROM qv WHERE qid IN (SELECT qid FROM qrels)""",
)
def p1_judged_topics(spark, sf):
    return judged(query_vectors(spark, sf), vector_qrels(spark, sf)).select("qid", "label")


@query(
    "c10_hypodoc_search",
    f"""WITH {VECTORS}, passages AS (
        SELECT qv.qid, emb.vec FROM qv JOIN emb ON g = qid // 5 AND vec_id <> qid),
    both_vecs AS (SELECT qid, vec FROM qv UNION ALL SELECT qid, vec FROM passages),
    means AS (SELECT qid, i, avg(vec[i]) AS m FROM both_vecs, range(1, 65) r(i) GROUP BY qid, i),
    averaged AS (SELECT qid, list(m ORDER BY i) AS vec FROM means GROUP BY qid),
    sims AS (SELECT qid, docid, list_dot_product(averaged.vec, dv.vec) AS score
             FROM averaged, dv)
    SELECT qid, docid, round(score, 6) AS score,
           row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid)::INTEGER AS rank
    FROM sims QUALIFY rank <= 10""",
)
def c10_hypodoc_search(spark, sf):
    """Each query's passages are the other vectors of its group; any row may be found."""
    queries = query_vectors(spark, sf)
    mates = vectors(spark, sf).select("vec_id", "g", "vec")
    group = queries.select("qid", F.floor(F.col("qid") / 5).alias("g"))
    passages = group.join(mates, "g").where("vec_id <> qid").select("qid", "vec")
    return rounded(search_with_passages(queries, passages, document_vectors(spark, sf), 10), "score")


@query(
    "t1_deep_topk",
    """SELECT l_linestatus AS qid, l_orderkey * 8 + l_linenumber AS docid, l_extendedprice::DOUBLE AS score,
              row_number() OVER (PARTITION BY l_linestatus ORDER BY l_extendedprice DESC,
                  l_orderkey * 8 + l_linenumber)::INTEGER AS rank
       FROM lineitem QUALIFY rank <= 20000""",
)
def t1_deep_topk(spark, sf):
    """The 20,000 best rows of two keys, deeper than Spark limits its tasks to."""
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select(
        F.col("l_linestatus").alias("qid"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("docid"),
        F.col("l_extendedprice").cast("double").alias("score"),
    )
    return top_k(rows, 20_000)


# --- runs ----------------------------------------------------------------


@query(
    "s5_run_first100",
    f"""WITH {VECTORS}, {vector_hits_sql(1000, "dv")}
    SELECT qid, rank, qid || ' Q0 ' || docid || ' ' || rank AS head,
           round(score, 6) AS score FROM hits WHERE rank <= 100""",
)
def s5_run_first100(spark, sf):
    """The run lines of deep hits, cut at 100 and parsed again."""
    hits = dense_topk(query_vectors(spark, sf), document_vectors(spark, sf), 1000)
    run = parse_run(run_lines(hits).withColumnRenamed("line", "value"))
    return run.select(
        F.col("qid").cast("bigint").alias("qid"),
        "rank",
        F.concat_ws(" ", "qid", F.lit("Q0"), "docid", "rank").alias("head"),
        F.round("score", 6).alias("score"),
    )


@query(
    "f16_fingerprint",
    f"""WITH {VECTORS}, {DOCUMENT_HITS}
    SELECT qid, sha256(string_agg(docid::VARCHAR, '' ORDER BY rank)) AS fingerprint
    FROM hits GROUP BY qid""",
)
def f16_fingerprint(spark, sf):
    hits = dense_topk(query_vectors(spark, sf), document_vectors(spark, sf), K)
    return fingerprint(hits)


@query(
    "a10_score_range",
    f"""WITH {VECTORS}, {DOCUMENT_HITS}
    SELECT qid, round(min(score), 6) AS min_score, round(max(score), 6) AS max_score
    FROM hits GROUP BY qid""",
)
def a10_score_range(spark, sf):
    hits = dense_topk(query_vectors(spark, sf), document_vectors(spark, sf), K)
    return rounded(score_range(hits), "min_score", "max_score")


# --- reranking -----------------------------------------------------------


OTHER_VECTORS = """
own_dims AS (SELECT docid, i, avg(vec[i]) AS m FROM hv, range(1, 65) r(i) GROUP BY docid, i),
own AS (SELECT docid, list(m ORDER BY i) AS vec FROM own_dims GROUP BY docid)
"""


def other_vectors(spark, sf):
    """A second embedding of each document: the mean of its question vectors."""
    stats = document_statistics(question_table(spark, sf))
    return stage(stats.select("docid", F.col("mean_vec").alias("vec")))


def _other_vector_sql(score: str, cut: str) -> str:
    return f"""WITH {VECTORS}, {HITS}, {OTHER_VECTORS},
    again AS (SELECT qid, docid, rank AS previous, {score} AS score
              FROM hits JOIN qv USING (qid) JOIN own USING (docid))
    SELECT qid, docid, round(score, 6) AS score,
           row_number() OVER (PARTITION BY qid ORDER BY score DESC, previous)::INTEGER AS rank
    FROM again {cut}"""


def _rerank_other(spark, sf, method, k):
    other = other_vectors(spark, sf)
    hits = vector_hits(spark, sf, K)
    return rounded(rerank_by_vector(hits, query_vectors(spark, sf), other, k, method), "score")


@query(
    "c4_rerank_dot",
    _other_vector_sql("list_dot_product(qv.vec, own.vec)", "QUALIFY rank <= 20"),
)
def c4_rerank_dot(spark, sf):
    return _rerank_other(spark, sf, None, 20)


@query("c4_rerank_cos", _other_vector_sql("list_cosine_similarity(qv.vec, own.vec)", ""))
def c4_rerank_cos(spark, sf):
    """Without k every candidate is ranked, by buckets of the score."""
    return _rerank_other(spark, sf, "cos", None)


@query(
    "c4_rerank_other_method",
    f"WITH {VECTORS}, {HITS} SELECT qid, docid, round(score, 6) AS score, rank FROM hits",
)
def c4_rerank_other_method(spark, sf):
    """A method without a formula keeps scores and order."""
    return _rerank_other(spark, sf, "none", None)


@query(
    "a4_question_similarity",
    f"""WITH {VECTORS}, {QUESTION_STATS}
    SELECT qid, docid, questions, round(max_sim, 6) AS max_sim, round(mean_sim, 6) AS mean_sim
    FROM stats""",
)
def a4_question_similarity(spark, sf):
    """Best and mean similarity of every query and every document with questions."""
    stats = all_question_statistics(query_vectors(spark, sf), question_table(spark, sf))
    return rounded(stats, "max_sim", "mean_sim")


def _score_sql(score: str) -> str:
    return f"""WITH {VECTORS}, {HITS}, {QUESTION_STATS}
    SELECT qid, docid, round({score}, 6) AS question_score
    FROM hits JOIN stats USING (qid, docid) WHERE rank <= 30"""


def _scores(spark, sf, method, spread_coef, **options):
    pairs = head(vector_hits(spark, sf, K))
    queries, questions = query_vectors(spark, sf), question_table(spark, sf)
    scores = score_candidates(pairs, queries, questions, method, spread_coef, **options)
    return rounded(scores, "question_score")


@query("c7_score_max", _score_sql("max_sim - 0.1 * spread"))
def c7_score_max(spark, sf):
    return _scores(spark, sf, "max", 0.1)


@query("c7_score_mean", _score_sql("mean_sim - 0.5 * spread"))
def c7_score_mean(spark, sf):
    return _scores(spark, sf, "mean", 0.5)


@query("c7_score_shuffled", _score_sql("max_sim - 0.1 * spread"))
def c7_score_shuffled(spark, sf):
    """The same scores by the joins for sides too large to broadcast."""
    return _scores(spark, sf, "max", 0.1, broadcast_bytes=0)


def _reranked_sql(score: str, coef: float, first_n: int = 30) -> str:
    return f"""WITH {VECTORS}, {HITS}, {QUESTION_STATS}, {rerank_sql(score, coef, first_n)}
    SELECT qid, docid, rank, base_rank, round(score, 6) AS score,
           round(question_score, 6) AS question_score FROM reranked"""


@query("c8_variational_rerank", _reranked_sql("max_sim", 0.4))
def c8_variational_rerank(spark, sf):
    return rounded(reranked_run(spark, sf), "score", "question_score")


@query("c8_rerank_mean_spread", _reranked_sql("mean_sim - 0.1 * spread", 2.0, 20))
def c8_rerank_mean_spread(spark, sf):
    return rounded(reranked_run(spark, sf, 2.0, 0.1, "mean", 20), "score", "question_score")


@query(
    "c8_literal_tail",
    f"""WITH {VECTORS}, {HITS}, {QUESTION_STATS},
    later AS (SELECT qid, count(*) AS n FROM hits WHERE rank > 30 GROUP BY qid),
    scored AS (SELECT h.qid, h.docid, h.rank AS base_rank,
        h.score + CASE WHEN h.rank <= 30 THEN 0.4 * max_sim ELSE 0 END
        + CASE WHEN h.rank = 30 THEN -1e6 * coalesce(n, 0) ELSE 0 END AS score,
        CASE WHEN h.rank > 30 THEN 0 WHEN h.rank = 30 AND n > 0 THEN -1e6 ELSE max_sim END
        AS question_score
        FROM hits h LEFT JOIN stats USING (qid, docid) LEFT JOIN later USING (qid))
    SELECT qid, docid, base_rank, round(score, 6) AS score,
           round(question_score, 6) AS question_score,
           row_number() OVER (PARTITION BY qid ORDER BY score DESC, base_rank)::INTEGER AS rank
    FROM scored""",
)
def c8_literal_tail(spark, sf):
    return rounded(reranked_run(spark, sf, tail="literal"), "score", "question_score")


@query(
    "w6_rank_shift",
    f"""WITH {VECTORS}, {HITS}, {QUESTION_STATS}, {rerank_sql("max_sim", 0.4, 30)}
    SELECT qid, docid, base_rank, rank AS new_rank, base_rank - rank AS moved_up FROM reranked""",
)
def w6_rank_shift(spark, sf):
    hits = vector_hits(spark, sf, K)
    queries, questions = query_vectors(spark, sf), question_table(spark, sf)
    scores = score_candidates(head(hits), queries, questions)
    return rank_shift(hits, rerank_by_questions(hits, scores))


# --- sampling ------------------------------------------------------------

SAMPLES = """
drawn AS (SELECT docid, pos, vec, draw, row_number() OVER (PARTITION BY docid, draw
            ORDER BY md5('7,' || draw || ',' || docid || ',' || pos), pos) AS place,
            count(*) OVER (PARTITION BY docid, draw) AS n
          FROM hv, range(10) r(draw)),
sampled AS (SELECT docid, pos, vec, draw::INTEGER AS draw FROM drawn WHERE place <= ceil(n * 0.5))
"""


@query("w3_downsample", f"WITH {VECTORS}, {SAMPLES} SELECT docid, pos, draw FROM sampled")
def w3_downsample(spark, sf):
    return sample_questions(question_table(spark, sf), 0.5, seed=7).select("docid", "pos", "draw")


@query(
    "a6_sampled_score",
    f"""WITH {VECTORS}, {HITS}, {SAMPLES},
    draw_dims AS (SELECT docid, draw, i, var_pop(vec[i]) AS v
                  FROM sampled, range(1, 65) r(i) GROUP BY ALL),
    draw_spreads AS (SELECT docid, draw, avg(v) AS spread FROM draw_dims GROUP BY ALL),
    draw_sims AS (SELECT qid, docid, draw, avg(list_dot_product(qv.vec, s.vec)) AS sim
                  FROM hits JOIN qv USING (qid) JOIN sampled s USING (docid)
                  WHERE rank <= 30 GROUP BY ALL)
    SELECT qid, docid, round(avg(sim - 0.1 * spread), 6) AS question_score
    FROM draw_sims JOIN draw_spreads USING (docid, draw) GROUP BY ALL""",
)
def a6_sampled_score(spark, sf):
    pairs = head(vector_hits(spark, sf, K))
    queries, questions = query_vectors(spark, sf), question_table(spark, sf)
    drawn = sample_questions(questions, 0.5, seed=7)
    scores = sampled_scores(pairs, queries, drawn, questions, "mean", 0.1)
    return rounded(scores, "question_score")


# --- evaluation ----------------------------------------------------------


@query(
    "c11_ndcg10",
    f"""WITH {VECTORS}, {VECTOR_QRELS}, {HITS}, {QUESTION_STATS},
    {rerank_sql("max_sim", 0.4, 30)}, {ndcg_sql("reranked")}
    SELECT qid, round(CASE WHEN ideal > 0 THEN coalesce(dcg, 0) / ideal ELSE 0 END, 6) AS ndcg
    FROM ideal LEFT JOIN dcgs USING (qid)""",
)
def c11_ndcg10(spark, sf):
    run = reranked_run(spark, sf)
    return rounded(ndcg_per_query(run, vector_qrels(spark, sf)), "ndcg")


@query(
    "a12_mean_ndcg",
    f"""WITH {VECTORS}, {DOCUMENT_QRELS}, {DOCUMENT_HITS}, {ndcg_sql("hits")}
    SELECT 'first' AS run_id, round(sum(CASE WHEN ideal > 0 THEN coalesce(dcg, 0) / ideal
           ELSE 0 END) / count(*), 6) AS ndcg
    FROM ideal LEFT JOIN dcgs USING (qid)""",
)
def a12_mean_ndcg(spark, sf):
    hits = dense_topk(query_vectors(spark, sf), document_vectors(spark, sf), K)
    run = hits.withColumn("run_id", F.lit("first"))
    return rounded(mean_ndcg(run, document_qrels(spark, sf)), "ndcg")


@query(
    "c13_compare",
    f"""WITH {VECTORS}, {VECTOR_QRELS}, {HITS}, {QUESTION_STATS},
    {rerank_sql("max_sim", 0.4, 30)},
    {OTHER_VECTORS},
    base AS (SELECT qid, docid, list_dot_product(qv.vec, own.vec) AS score
             FROM hits JOIN qv USING (qid) JOIN own USING (docid)),
    runs AS (SELECT 'first' AS run_id, qid, docid, score FROM hits
             UNION ALL SELECT 'base', qid, docid, score FROM base
             UNION ALL SELECT 'reranked', qid, docid, score FROM reranked),
    {ndcg_sql("runs", "run_id,")}
    SELECT run_id, round(sum(CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END)
                         / (SELECT count(*) FROM ideal), 6) AS ndcg
    FROM dcgs JOIN ideal USING (qid) GROUP BY run_id""",
)
def c13_compare(spark, sf):
    hits = vector_hits(spark, sf, K)
    queries, questions = query_vectors(spark, sf), question_table(spark, sf)
    scores = score_candidates(head(hits), queries, questions)
    runs = {
        "first": hits,
        "base": rerank_by_vector(hits, queries, other_vectors(spark, sf), K),
        "reranked": rerank_by_questions(hits, scores),
    }
    return rounded(compare(runs, vector_qrels(spark, sf)), "ndcg")


SWEEP_CELLS = grid(coefs=(0.03, 0.5, 2.0), spread_coefs=(0.0, 0.1))


@query(
    "c12_sweep",
    f"""WITH {VECTORS}, {VECTOR_QRELS}, {HITS}, {QUESTION_STATS},
    cells AS (SELECT method, first_n, question_coef, spread_coef
              FROM (VALUES ('max'), ('mean')) a(method), (VALUES (30), (20), (10)) b(first_n),
                   (VALUES (0.03::DOUBLE), (0.5), (2.0)) c(question_coef),
                   (VALUES (0.0::DOUBLE), (0.1)) d(spread_coef)),
    runs AS (SELECT cells.*, qid, docid, CASE WHEN rank <= first_n THEN score + question_coef *
                (CASE method WHEN 'mean' THEN mean_sim ELSE max_sim END - spread_coef * spread)
                ELSE score - 1e6 END AS score
             FROM hits JOIN stats USING (qid, docid), cells),
    {ndcg_sql("runs", "method, first_n, question_coef, spread_coef,")}
    SELECT method, first_n, question_coef, spread_coef,
           round(sum(CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END)
                 / (SELECT count(*) FROM ideal), 6) AS ndcg
    FROM dcgs JOIN ideal USING (qid) GROUP BY ALL""",
)
def c12_sweep(spark, sf):
    hits = vector_hits(spark, sf, K)
    stats = statistics(spark, sf, head(hits))
    return rounded(sweep(hits, stats, vector_qrels(spark, sf), SWEEP_CELLS), "ndcg")


@query(
    "c12_encoder_sweep",
    f"""WITH {VECTORS}, {VECTOR_QRELS}, {HITS}, {QUESTION_STATS},
    {OTHER_VECTORS},
    again AS (SELECT qid, docid, rank AS previous, list_dot_product(qv.vec, own.vec) AS score
              FROM hits JOIN qv USING (qid) JOIN own USING (docid)),
    both_hits AS (SELECT 'contriever' AS encoder, 2.0::DOUBLE AS question_coef, qid, docid, score,
                         rank FROM hits
                  UNION ALL SELECT 'bge-base-en-v1.5', 0.03, qid, docid, score, row_number() OVER (
                      PARTITION BY qid ORDER BY score DESC, previous)::INTEGER FROM again),
    runs AS (SELECT encoder, question_coef, method, first_n, qid, docid, CASE WHEN rank <= first_n
                THEN score + question_coef * CASE method WHEN 'mean' THEN mean_sim ELSE max_sim END
                ELSE score - 1e6 END AS score
             FROM both_hits JOIN stats USING (qid, docid), (VALUES ('max'), ('mean')) a(method),
                  (VALUES (30), (20), (10)) b(first_n)),
    {ndcg_sql("runs", "encoder, question_coef, method, first_n,")}
    SELECT encoder, method, first_n, question_coef, 0.0::DOUBLE AS spread_coef,
           round(sum(CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END)
                 / (SELECT count(*) FROM ideal), 6) AS ndcg
    FROM dcgs JOIN ideal USING (qid) GROUP BY ALL""",
)
def c12_encoder_sweep(spark, sf):
    """The sweep over two encoders' base runs, each with its own question weight."""
    hits = vector_hits(spark, sf, K)
    queries, questions = query_vectors(spark, sf), question_table(spark, sf)
    other = rerank_by_vector(hits, queries, other_vectors(spark, sf), K)
    names = ["contriever", "bge-base-en-v1.5"]
    runs = [stage(r.withColumn("encoder", F.lit(n))) for n, r in zip(names, (hits, other))]
    stats = [
        statistics(spark, sf, head(r), False).withColumn("encoder", F.lit(n))
        for n, r in zip(names, runs)
    ]
    found = sweep(
        runs[0].unionByName(runs[1]),
        stats[0].unionByName(stats[1]),
        vector_qrels(spark, sf),
        encoder_grid(names),
        keys=("encoder",),
    )
    return rounded(found, "ndcg")


# Sets of questions by number of completions and temperature: two a document, and all.
ANSWERS = [(1, 0.1), (2, 1.0)]
RATIOS = (0.25, 0.5, 1.0)
SAMPLING_CELLS = sampling_grid(grid((0.4,), first_n=(30, 10), spread_coefs=(0.0, 0.1)), RATIOS, ANSWERS)


@query(
    "c12_sampling_sweep",
    f"""WITH {VECTORS}, {VECTOR_QRELS}, {HITS},
    answers AS (SELECT * FROM (VALUES (1::INTEGER, 0.1::DOUBLE), (2, 1.0)) t(n, temperature)),
    asked AS (SELECT n, temperature, docid, pos, vec FROM hv, answers WHERE n = 2 OR pos < 2),
    ordered AS (SELECT *, row_number() OVER (PARTITION BY n, docid, draw
                  ORDER BY md5('7,' || draw || ',' || docid || ',' || pos), pos) AS place,
                count(*) OVER (PARTITION BY n, docid, draw) AS size FROM asked, range(10) r(draw)),
    kept AS (SELECT n, temperature, downsample, docid, draw, vec
             FROM ordered, (VALUES (0.25::DOUBLE), (0.5), (1.0)) t(downsample)
             WHERE place <= ceil(size * downsample)),
    draw_dims AS (SELECT n, temperature, downsample, docid, draw, i, var_pop(vec[i]) AS v
                  FROM kept, range(1, 65) r(i) GROUP BY ALL),
    draw_spreads AS (SELECT n, temperature, downsample, docid, draw, avg(v) AS spread
                     FROM draw_dims GROUP BY ALL),
    draw_sims AS (SELECT n, temperature, downsample, qid, docid, draw,
                    max(list_dot_product(qv.vec, kept.vec)) AS best,
                    avg(list_dot_product(qv.vec, kept.vec)) AS mean
                  FROM (SELECT * FROM hits WHERE rank <= 30) JOIN qv USING (qid)
                  JOIN kept USING (docid) GROUP BY ALL),
    sampled AS (SELECT n, temperature, downsample, qid, docid, avg(best) AS max_sim,
                  avg(mean) AS mean_sim, avg(spread) AS spread
                FROM draw_sims JOIN draw_spreads USING (n, temperature, downsample, docid, draw)
                GROUP BY ALL),
    cells AS (SELECT method, first_n, 0.4::DOUBLE AS question_coef, spread_coef, n, temperature, downsample
              FROM (VALUES ('max'), ('mean')) a(method), (VALUES (30), (10)) b(first_n),
                   (VALUES (0.0::DOUBLE), (0.1)) c(spread_coef), answers,
                   (VALUES (0.25::DOUBLE), (0.5), (1.0)) d(downsample)),
    runs AS (SELECT cells.*, h.qid, h.docid, CASE WHEN rank <= first_n THEN score + question_coef *
                (CASE method WHEN 'mean' THEN mean_sim ELSE max_sim END - cells.spread_coef * spread)
                ELSE score - 1e6 END AS score
             FROM hits h CROSS JOIN cells JOIN sampled s ON s.qid = h.qid AND s.docid = h.docid
                 AND s.n = cells.n AND s.downsample = cells.downsample),
    {ndcg_sql("runs", "downsample, n, temperature, method, first_n, question_coef, spread_coef,")}
    SELECT downsample, n, temperature, method, first_n, question_coef, spread_coef,
           round(sum(CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END)
                 / (SELECT count(*) FROM ideal), 6) AS ndcg
    FROM dcgs JOIN ideal USING (qid) GROUP BY ALL""",
)
def c12_sampling_sweep(spark, sf):
    """The sweep over shares of drawn questions and over what made the questions, from one pass."""
    hits = vector_hits(spark, sf, K)
    questions = question_table(spark, sf)
    sets = [
        questions.where("pos < 2 or " + str(n == 2).lower()).select(
            F.lit(n).alias("n"), F.lit(temperature).alias("temperature"), "docid", "pos", "vec"
        )
        for n, temperature in ANSWERS
    ]
    stats = sampling_statistics(
        head(hits), query_vectors(spark, sf), sets[0].unionByName(sets[1]), RATIOS, seed=7, keys=("n", "temperature")
    )
    return rounded(sweep(hits, stats, vector_qrels(spark, sf), SAMPLING_CELLS), "ndcg")
