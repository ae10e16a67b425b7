"""Retrieval, reranking and evaluation against brute force on small fixtures."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ctxrank.operators.evaluate import mean_ndcg, ndcg_per_query
from ctxrank.operators.ranking import best_first, fingerprint, rank_all, score_bucket
from ctxrank.operators.rerank import (
    question_score,
    question_statistics,
    rerank_by_questions,
    rerank_by_vector,
    score_candidates,
)
from ctxrank.operators.search import _running_top_k, dense_topk, sparse_topk, term_index
from ctxrank.operators.similarity import similarities
from ctxrank.plans.sweep import grid, sweep

PAIR = "qid INT, docid INT, rank INT, score DOUBLE"


def vectors(spark, key, rows):
    values = [(k, [float(x) for x in v]) for k, v in rows]
    return spark.createDataFrame(values, f"{key}, vec ARRAY<DOUBLE>")


def random_vectors(count, dim, seed):
    return np.random.default_rng(seed).normal(size=(count, dim))


def brute_top_k(queries, docs, k):
    """{qid: [docid, ...]} by score, ties by docid."""
    found = {}
    for q, v in queries:
        scored = sorted((-float((np.asarray(v) * np.asarray(d)).sum()), i) for i, d in docs)
        found[q] = [i for _, i in scored[:k]]
    return found


def as_lists(hits):
    found = {}
    for r in sorted(hits.collect(), key=lambda r: (r["qid"], r["rank"])):
        found.setdefault(r["qid"], []).append(r["docid"])
    return found


@pytest.mark.parametrize("batch, tile, entries", [(500, 1024, 4_000_000), (7, 4, 50), (100, 1, 30)])
def test_kernel_gives_the_same_best_in_any_blocks(batch, tile, entries):
    r = np.random.default_rng(5)
    queries, docs = r.integers(0, 3, (30, 3)).astype(float), r.integers(0, 3, (500, 3)).astype(float)
    ids = np.array([f"d{i:03}" for i in r.permutation(500)], object)
    batches = ((ids[i : i + batch], docs[i : i + batch]) for i in range(0, 500, batch))
    found = [set() for _ in queries]
    for col, score, doc in _running_top_k(10, entries, tile)(queries, batches):
        for c, s, d in zip(col, score, doc):
            found[c].add((-s, d))
    for query, best in zip(queries, found):
        assert sorted(best) == sorted(zip(-(docs @ query), ids))[:10]


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 300}])
@pytest.mark.parametrize("k", [1, 7, 500])
def test_dense_topk_is_exact(spark, options, k):
    queries = list(enumerate(random_vectors(9, 5, 1)))
    docs = list(enumerate(random_vectors(200, 5, 2)))
    hits = dense_topk(
        vectors(spark, "qid INT", queries), vectors(spark, "docid INT", docs).repartition(7), k, **options
    )
    assert as_lists(hits) == brute_top_k(queries, docs, k)


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 150}])
def test_dense_topk_when_a_third_are_copies(spark, options):
    """Copies tie at the top; the ties go by docid, across partitions and blocks."""
    rng = np.random.default_rng(3)
    copy = rng.normal(size=6)
    docs = [(f"d{i:04d}", copy if i % 3 == 0 else rng.normal(size=6) * 0.1) for i in range(300)]
    queries = [("q1", copy), ("q2", rng.normal(size=6))]
    hits = dense_topk(
        vectors(spark, "qid STRING", queries), vectors(spark, "docid STRING", docs).repartition(5), 20, **options
    )
    assert as_lists(hits) == brute_top_k(queries, docs, 20)


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_dense_topk_does_not_depend_on_partitions(spark, parts):
    queries = vectors(spark, "qid INT", enumerate(random_vectors(4, 8, 5)))
    docs = vectors(spark, "docid INT", enumerate(random_vectors(150, 8, 6)))
    one = dense_topk(queries, docs.coalesce(1), 10).orderBy("qid", "rank").collect()
    assert dense_topk(queries, docs.repartition(parts), 10).orderBy("qid", "rank").collect() == one


def test_dense_topk_without_queries_or_documents(spark):
    queries = vectors(spark, "qid INT", enumerate(random_vectors(2, 4, 1)))
    docs = vectors(spark, "docid INT", enumerate(random_vectors(5, 4, 2)))
    assert dense_topk(queries.limit(0), docs, 3).count() == 0
    assert dense_topk(queries, docs.limit(0), 3).count() == 0


@pytest.mark.parametrize("gathered", [False, True])
@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 300}])
def test_sparse_topk_with_a_term_in_most_documents(spark, options, gathered):
    rng = random.Random(4)
    queries = [(q, t, rng.randint(1, 3)) for q in range(6) for t in {"the", f"t{q}", "t0"}]
    postings = [(d, "the", rng.randint(1, 5)) for d in range(200)]
    postings += [(d, f"t{d % 9}", rng.randint(1, 5)) for d in range(300)]
    scores = {}
    for q, t, w in queries:
        for d, u, v in postings:
            if t == u:
                scores[q, d] = scores.get((q, d), 0) + w * v
    expected = {
        q: [d for _, d in sorted((-s, d) for (p, d), s in scores.items() if p == q)[:15]] for q in range(6)
    }
    index = spark.createDataFrame(postings, "docid INT, term STRING, weight INT")
    hits = sparse_topk(
        spark.createDataFrame(queries, "qid INT, term STRING, weight INT"),
        term_index(index) if gathered else index,
        15,
        **options,
    )
    assert as_lists(hits) == expected


def test_sparse_min_idf_needs_the_document_count(spark):
    terms = spark.createDataFrame([(1, "a", 1)], "qid INT, term STRING, weight INT")
    with pytest.raises(ValueError):
        sparse_topk(terms, terms.withColumnRenamed("qid", "docid"), 5, min_idf=0.5)


def test_rank_all_matches_a_sort(spark):
    rng = random.Random(8)
    pool = [0.0, 1e-9, -1e-9, 0.25, -3.0, 1e6, -1e6, 17.0]
    rows = [
        (0 if i % 3 == 0 else i % 7, i, rng.choice(pool) if i % 2 else rng.gauss(0, 1)) for i in range(2000)
    ]
    df = spark.createDataFrame(rows, "qid INT, docid INT, score DOUBLE").repartition(6)
    ranked = rank_all(df, best_first("score", "docid"), score_bucket(F.col("score")))
    expected = {}
    for q in {r[0] for r in rows}:
        own = sorted((-s, d) for p, d, s in rows if p == q)
        expected[q] = [d for _, d in own]
    assert as_lists(ranked) == expected


def test_fingerprint_is_the_same_digest_at_every_size(spark):
    import hashlib

    sizes = [1, 999, 1000, 1001, 1500]
    rows = [(n, d, d + 1, 0.0) for n in sizes for d in range(n)]
    found = {r["qid"]: r["fingerprint"] for r in fingerprint(spark.createDataFrame(rows, PAIR)).collect()}
    plain = lambda n: hashlib.sha256("".join(str(d) for d in range(n)).encode()).hexdigest()
    assert found == {n: plain(n) for n in sizes}


def hits_fixture(spark, queries=3, documents=12):
    rng = random.Random(2)
    rows = []
    for q in range(queries):
        scores = sorted((rng.random() for _ in range(documents)), reverse=True)
        docs = rng.sample(range(documents), documents)
        rows += [(q, d, i + 1, s) for i, (d, s) in enumerate(zip(docs, scores))]
    return spark.createDataFrame(rows, PAIR), rows


@pytest.mark.parametrize("method", [None, "cos", "none"])
@pytest.mark.parametrize("k", [5, None])
@pytest.mark.parametrize("budget", [1 << 20, 0])
def test_rerank_by_vector(spark, method, k, budget):
    hits, rows = hits_fixture(spark)
    queries, docs = random_vectors(3, 4, 1), random_vectors(11, 4, 2)  # document 11 has no vector
    expected = {}
    for q in range(3):
        scored = []
        for _, d, rank, score in (r for r in rows if r[0] == q):
            if d < 11 and method != "none":
                score = float(queries[q] @ docs[d])
                if method == "cos":
                    score /= np.linalg.norm(queries[q]) * np.linalg.norm(docs[d])
            scored.append((-score, rank, d))
        expected[q] = [d for *_, d in sorted(scored)][: k or 12]
    found = rerank_by_vector(
        hits,
        vectors(spark, "qid INT", enumerate(queries)),
        vectors(spark, "docid INT", enumerate(docs)),
        k,
        method,
        budget,
    )
    assert as_lists(found) == expected


def test_similarities_of_a_document_with_many_questions(spark):
    """Both joins give every pair once; one document has most of the questions."""
    rng = np.random.default_rng(5)
    counts = {0: 95, 1: 3, 2: 1, 3: 10}
    rows = [(d, p, [float(x) for x in rng.normal(size=3)]) for d, n in counts.items() for p in range(n)]
    questions = spark.createDataFrame(rows, "docid INT, pos INT, vec ARRAY<DOUBLE>")
    queries = vectors(spark, "qid INT", enumerate(random_vectors(4, 3, 6)))
    pairs = spark.createDataFrame([(q, d) for q in range(4) for d in (0, 1, 3, 9)], "qid INT, docid INT")
    outputs = []
    for budget in (1 << 20, 0):
        found = similarities(pairs, queries, questions, ("pos",), None, budget, block=10)
        outputs.append(sorted((r["qid"], r["docid"], r["pos"], round(r["sim"], 9)) for r in found.collect()))
    assert outputs[0] == outputs[1]
    assert len(outputs[0]) == 4 * (95 + 3 + 10)


def test_question_statistics_by_hand(spark):
    questions = spark.createDataFrame(
        [(1, 0, [1.0, 0.0]), (1, 1, [0.0, 2.0]), (2, 0, [3.0, 3.0])],
        "docid INT, pos INT, vec ARRAY<DOUBLE>",
    )
    queries = vectors(spark, "qid INT", [(0, [1, 1])])
    pairs = spark.createDataFrame([(0, 1), (0, 2), (0, 3)], "qid INT, docid INT")
    rows = {r["docid"]: r for r in question_statistics(pairs, queries, questions).collect()}
    assert set(rows) == {1, 2}
    assert (rows[1]["max_sim"], rows[1]["mean_sim"]) == (2.0, 1.5)
    assert rows[1]["spread"] == pytest.approx((0.25 + 1.0) / 2)
    assert rows[2]["spread"] == 0.0
    scores = score_candidates(pairs, queries, questions, "mean", 0.5).collect()
    found = {r["docid"]: r["question_score"] for r in scores}
    assert found == {1: pytest.approx(1.5 - 0.5 * 0.625), 2: 6.0}


def test_methods():
    with pytest.raises(ValueError):
        question_score("min", 0.0)


def reranked(spark, tail, first_n, rows, scores, coef=1.0):
    hits = spark.createDataFrame(rows, PAIR)
    table = spark.createDataFrame(scores, "qid INT, docid INT, question_score DOUBLE")
    found = rerank_by_questions(hits, table, coef, first_n, tail).collect()
    return {(r["qid"], r["docid"]): (r["rank"], r["score"], r["question_score"]) for r in found}


ROWS = [(0, 10, 1, 0.9), (0, 11, 2, 0.8), (0, 12, 3, 0.7), (0, 13, 4, 0.6), (1, 10, 1, 0.5)]


def test_rerank_tail_stays_below(spark):
    found = reranked(spark, "penalise", 2, ROWS, [(0, 10, 0.1), (0, 11, 0.9), (0, 12, 99.0)])
    assert found[0, 11] == (1, pytest.approx(1.7), 0.9)
    assert found[0, 10] == (2, pytest.approx(1.0), 0.1)
    assert found[0, 12] == (3, pytest.approx(0.7 - 1e6), -1e6)
    assert found[0, 13] == (4, pytest.approx(0.6 - 1e6), -1e6)
    assert found[1, 10] == (1, 0.5, None)


def test_rerank_literal_tail(spark):
    """The last scored candidate takes the penalty once per later one."""
    found = reranked(spark, "literal", 2, ROWS, [(0, 10, 0.1), (0, 11, 0.9)])
    assert found[0, 10] == (1, pytest.approx(1.0), 0.1)
    assert found[0, 12] == (2, 0.7, 0.0)
    assert found[0, 13] == (3, 0.6, 0.0)
    assert found[0, 11] == (4, pytest.approx(1.7 - 2e6), -1e6)
    assert found[1, 10] == (1, 0.5, None)


def test_rerank_first_n_zero_keeps_all_as_tail(spark):
    found = reranked(spark, "penalise", 0, ROWS, [(0, 10, 0.1)])
    assert [found[0, d][0] for d in (10, 11, 12, 13)] == [1, 2, 3, 4]


def test_rerank_properties(spark):
    hits, rows = hits_fixture(spark)
    scores = [(q, d, random.Random(q * 100 + d).random()) for q, d, *_ in rows]
    plain = reranked(spark, "penalise", 12, rows, scores)
    lifted = reranked(spark, "penalise", 12, [(q, d, r, s + 64.0) for q, d, r, s in rows], scores)
    assert {k: v[0] for k, v in plain.items()} == {k: v[0] for k, v in lifted.items()}
    unweighted = reranked(spark, "penalise", 12, rows, scores, coef=0.0)
    assert {(q, d): r for q, d, r, _ in rows} == {k: v[0] for k, v in unweighted.items()}
    with pytest.raises(ValueError):
        rerank_by_questions(hits, hits, tail="drop")


def ndcg(gains, ideal, cut=10):
    def dcg(g):
        return sum(x / math.log2(i + 2) for i, x in enumerate(g[:cut]))

    best = dcg(sorted(ideal, reverse=True))
    return dcg(gains) / best if best else 0.0


def test_ndcg_by_hand(spark):
    """Ties go by descending id as text, unjudged gain 0, missing queries score 0."""
    run = spark.createDataFrame(
        [("a", 9, 0.5), ("a", 10, 0.5), ("a", 3, 0.9), ("b", 1, 1.0), ("x", 1, 1.0)],
        "qid STRING, docid INT, score DOUBLE",
    )
    qrels = spark.createDataFrame(
        [("a", 9, 2), ("a", 10, 1), ("a", 77, 3), ("b", 1, -1), ("b", 2, 0), ("c", 5, 1)],
        "qid STRING, docid INT, rel INT",
    )
    found = {r["qid"]: r["ndcg"] for r in ndcg_per_query(run, qrels).collect()}
    assert found == {"a": pytest.approx(ndcg([0, 2, 1], [2, 1, 3])), "b": 0.0, "c": 0.0}
    mean = mean_ndcg(run.withColumn("run_id", F.lit("r")), qrels).first()["ndcg"]
    assert mean == pytest.approx(found["a"] / 3)


def test_ideal_run_scores_one(spark):
    rng = random.Random(1)
    qrels = [(q, d, rng.choice([0, 1, 2])) for q in range(5) for d in range(30)]
    table = spark.createDataFrame(qrels, "qid INT, docid INT, rel INT")
    ideal = table.withColumn("score", F.col("rel").cast("double"))
    assert {round(r["ndcg"], 9) for r in ndcg_per_query(ideal, table).collect()} == {1.0}
    worst = table.withColumn("score", -F.col("rel").cast("double"))
    assert all(0 <= r["ndcg"] < 1 for r in ndcg_per_query(worst, table).collect())


def test_sweep_agrees_with_separate_runs(spark):
    hits, rows = hits_fixture(spark, 4, 20)
    questions = spark.createDataFrame(
        [(d, p, [float(x) for x in random_vectors(1, 3, d * 7 + p)[0]]) for d in range(20) for p in range(3)],
        "docid INT, pos INT, vec ARRAY<DOUBLE>",
    )
    queries = vectors(spark, "qid INT", enumerate(random_vectors(4, 3, 9)))
    qrels = spark.createDataFrame(
        [(q, d, (q + d) % 3) for q in range(4) for d in range(20)], "qid INT, docid INT, rel INT"
    )
    cells = grid((0.1, 2.0), first_n=(15, 5), spread_coefs=(0.0, 0.3))
    stats = question_statistics(hits, queries, questions)
    table = sweep(hits, stats, qrels, cells).collect()
    assert len(table) == len(cells) == 16
    for cell in (cells[0], cells[-1], cells[5]):
        scores = score_candidates(
            hits.where(F.col("rank") <= cell.first_n), queries, questions, cell.method, cell.spread_coef
        )
        run = rerank_by_questions(hits, scores, cell.question_coef, cell.first_n)
        expected = mean_ndcg(run.withColumn("run_id", F.lit("r")), qrels).first()["ndcg"]
        found = next(
            r["ndcg"]
            for r in table
            if (r["method"], r["first_n"], r["question_coef"], r["spread_coef"])
            == (cell.method, cell.first_n, cell.question_coef, cell.spread_coef)
        )
        assert found == pytest.approx(expected)


@pytest.mark.parametrize("budget", [1 << 20, 0])
def test_cosine_of_a_zero_vector_leaves_the_score(spark, budget):
    hits = spark.createDataFrame([(0, 1, 1, 0.9), (0, 2, 2, 0.1)], PAIR)
    queries = vectors(spark, "qid INT", [(0, [1, 1])])
    docs = vectors(spark, "docid INT", [(1, [0, 0]), (2, [2, 2])])
    found = rerank_by_vector(hits, queries, docs, 2, "cos", budget).collect()
    assert {r["docid"]: round(r["score"], 9) for r in found} == {1: 0.9, 2: 1.0}


def test_undefined_scores_keep_their_place(spark):
    scores = [1.0, None, float("nan"), -1.0, float("inf"), float("-inf")]
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate(scores)], "qid int, docid int, score double")
    ranked = rank_all(rows, best_first("score", "docid"), score_bucket(F.col("score")))
    assert [r.docid for r in ranked.orderBy("rank").collect()] == [2, 4, 0, 3, 5, 1]


def test_a_run_without_judged_queries_scores_zero(spark):
    run = spark.createDataFrame(
        [("a", 1, 1, 1.0), ("b", 9, 1, 1.0)], "run_id string, qid int, docid int, score double"
    )
    qrels = spark.createDataFrame([(1, 1, 1), (2, 1, 1)], "qid int, docid int, rel int")
    assert {r.run_id: r.ndcg for r in mean_ndcg(run, qrels).collect()} == {"a": 0.5, "b": 0.0}


def test_vectors_of_different_lengths_are_an_error(spark):
    docs = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0] * 6)], "docid int, vec array<double>")
    queries = spark.createDataFrame([(1, [1.0] * 4)], "qid int, vec array<double>")
    with pytest.raises(Exception, match="dimensions"):
        dense_topk(queries, docs.coalesce(1), 3).collect()
