"""Queries over stores, files and models, and the whole ranking."""

from __future__ import annotations

from dataclasses import replace
from functools import partial

from pyspark.sql import functions as F

from ctxrank.functions.prompts import build_prompt
from ctxrank.functions.vectors import as_vector, text_key
from ctxrank.operators.hypodocs import passage_vectors, search_with_passages
from ctxrank.operators.models import (
    distinct_texts,
    encode_texts,
    generate,
    make_hash_encoder,
    make_test_encoder,
    make_test_generator,
    test_completion,
)
from ctxrank.operators.questions import (
    cut_no_content,
    document_questions,
    parse,
    parse_documents,
    question_vectors,
)
from ctxrank.operators.evaluate import mean_ndcg
from ctxrank.operators.rerank import document_statistics
from ctxrank.operators.search import dense_topk, judged
from ctxrank.plans.end_to_end import Setting, ask, embed, end_to_end, passage_search
from ctxrank.session import new_folder, stage
from ctxrank.sources.catalog import resolve
from ctxrank.sources.experiments import append_experiments, read_experiments
from ctxrank.sources.store import (
    VECTORS as VECTOR_SCHEMA,
    Store,
    generated_store,
    overlay,
    read_precomputed,
    store_sizes,
    vector_store,
)
from ctxrank.sources.trec import read_qrels, read_run, read_topics, write_run
from workload.fixtures import (
    ASKED_QUESTIONS,
    COMPLETIONS,
    CONTEXTS,
    DOCUMENT_QRELS,
    PROMPTS,
    TEXT_QRELS,
    TOPICS,
    VECTORS,
    completions,
    corpus,
    document_contexts,
    document_prompts,
    document_qrels,
    document_vectors,
    documents,
    hash_vector_sql,
    looked_up_rows,
    looked_up_sql,
    looked_up_vectors,
    ndcg_sql,
    query_vectors,
    questions_sql,
    staged_prompts,
    strip_sql,
    table,
    term_weights,
    text_counts_sql,
    text_qrels,
    topics,
    vector_hits_sql,
    vectors,
)
from workload.registry import query
from workload.vector_queries import rounded, rounded_vector

# --- merging and pruning -------------------------------------------------


@query(
    "u1_store_merge",
    """SELECT doc_id AS docid, CASE WHEN doc_id IN (SELECT doc_id FROM labels)
              THEN 'stored' ELSE 'held' END AS origin, md5(text) AS text_md5 FROM documents""",
)
def u1_store_merge(spark, sf):
    """Stored texts win over held ones."""
    rows = documents(spark, sf).select(
        F.col("doc_id").alias("docid"), F.md5(F.col("text").cast("binary")).alias("text_md5")
    )
    labelled = table(spark, sf, "labels").select(F.col("doc_id").alias("docid"))
    stored = rows.join(labelled, "docid", "left_semi").withColumn("origin", F.lit("stored"))
    return overlay(stored, rows.withColumn("origin", F.lit("held")), "docid")


@query(
    "u2_embedding_merge",
    f"""WITH {VECTORS} SELECT vec_id, CASE WHEN label < 5 THEN vec
        ELSE list_transform(vec, lambda x: -x) END AS vec FROM emb""",
    vector="vec",
)
def u2_embedding_merge(spark, sf):
    """Held vectors win; of the stored ones only the missing keys are added."""
    rows = vectors(spark, sf)
    negated = F.transform("vec", lambda x: -x).alias("vec")
    held = rows.where("label < 5").select("vec_id", "vec")
    return overlay(held, rows.select("vec_id", negated), "vec_id")


def _vector_table(spark) -> Store:
    """A store of vectors by row, with their label."""
    schema = "vec_id LONG, label INT, vec ARRAY<DOUBLE>, encoder STRING"
    return Store(new_folder(spark, "vectors"), schema, "vec_id", {"encoder": "test"})


@query(
    "u3_upsert",
    f"""WITH {VECTORS} SELECT vec_id, CASE WHEN label = 0
        THEN list_transform(vec, lambda x: 2 * x) ELSE vec END AS vec FROM emb""",
    vector="vec",
)
def u3_upsert(spark, sf):
    """New vectors replace the stored ones of their keys; the store is read back."""
    rows, store = vectors(spark, sf), _vector_table(spark)
    store.append(rows)
    store.upsert(rows.where("label = 0").withColumn("vec", F.transform("vec", lambda x: 2 * x)))
    return store.read(spark).select("vec_id", "vec")


@query(
    "p9_prune",
    "SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels)",
)
def p9_prune(spark, sf):
    """Vectors whose key is no longer referenced leave the store; it is read back."""
    keys, store = table(spark, sf, "labels").select(F.col("doc_id").alias("vec_id")), _vector_table(spark)
    store.append(vectors(spark, sf))
    store.prune(keys)
    return store.read(spark).select("vec_id", "label")


@query(
    "j4_store_lookup",
    f"WITH {VECTORS} SELECT vec_id, label, vec FROM emb WHERE label = 4",
    vector="vec",
)
def j4_store_lookup(spark, sf):
    """Keys of one of ten fills, looked up through the filters of many small files."""
    rows, store = vectors(spark, sf), replace(_vector_table(spark), rows_per_file=64)
    for label in range(10):
        store.append(rows.where(F.col("label") == label))
    return store.lookup(rows.where("label = 4").select("vec_id"))


# --- stores --------------------------------------------------------------


@query(
    "s7_question_store",
    f"""WITH {CONTEXTS}, {PROMPTS}, {COMPLETIONS}, {questions_sql()}
    SELECT prompt_key, pos, question AS text FROM parsed
    WHERE prompt_key IN (SELECT prompt_key FROM asked)""",
)
def s7_question_store(spark, sf):
    """Store the labelled documents' questions, then fill in and look up all."""
    store = generated_store(new_folder(spark, "questions"), "questions", "test", "documents")
    asked = staged_prompts(spark, sf)
    parsed = stage(parse(completions(asked)).withColumnRenamed("question", "text"))
    labelled = table(spark, sf, "labels").select(F.col("doc_id").alias("docid"))
    known = asked.join(labelled, "docid", "left_semi").select("prompt_key").distinct()
    store.append(parsed.join(known, "prompt_key"))
    wanted = asked.select("prompt_key").distinct()
    return store.fill(wanted, lambda missing: parsed.join(missing, "prompt_key"))


@query(
    "s8_passage_store",
    f"""SELECT DISTINCT sha256(text) AS prompt_key, 0::INTEGER AS pos, {strip_sql("text")} AS text
    FROM benchmark""",
)
def s8_passage_store(spark, sf):
    """Hypothetical documents under their own kind, next to questions."""
    folder = new_folder(spark, "generated")
    passages = generated_store(folder, "passages", "test", "benchmark")
    other = generated_store(folder, "questions", "test", "benchmark")
    key = text_key(F.col("text")).alias("prompt_key")
    rows = table(spark, sf, "benchmark").select(key, F.lit(0).alias("pos"), F.trim("text").alias("text"))
    rows = rows.dropDuplicates(["prompt_key"])
    other.append(rows.withColumn("text", F.lit("a question")))
    passages.append(rows)
    return passages.require(rows)


@query(
    "s9_vector_store",
    f"""WITH {VECTORS} SELECT sha256('v' || vec_id) AS text_key, vec FROM emb WHERE label <> 3""",
    vector="vec",
)
def s9_vector_store(spark, sf):
    """Vectors of one encoder and topic set, looked up by key."""
    store = vector_store(new_folder(spark, "vectors"), "test", "embeddings")
    key = F.sha2(F.concat(F.lit("v"), "vec_id"), 256).alias("text_key")
    rows = vectors(spark, sf).select(key, "label", "vec")
    store.append(rows.where("label < 3").select("text_key", "vec"))
    wanted = rows.where("label <> 3")
    found = rows.select("text_key", "vec")
    return store.fill(wanted.select("text_key"), lambda m: found.join(m, "text_key"))


@query(
    "a15_store_count",
    """SELECT 'test' AS encoder, label::VARCHAR AS topic, count(*) AS items
       FROM embeddings GROUP BY label""",
)
def a15_store_count(spark, sf):
    """Number of vectors in each partition of a store."""
    folder = new_folder(spark, "vectors")
    key = F.sha2(F.col("vec_id").cast("string"), 256).alias("text_key")
    rows = stage(vectors(spark, sf).select(key, "label", "vec"))
    for label in [r["label"] for r in rows.select("label").distinct().collect()]:
        vector_store(folder, "test", str(label)).append(rows.where(F.col("label") == label))
    return store_sizes(spark, folder, VECTOR_SCHEMA, "text_key")


@query(
    "s12_precomputed_questions",
    f"""SELECT sha256(text) AS prompt_key, 0::INTEGER AS pos, lang AS text
    FROM (SELECT DISTINCT ON (text) text, lang FROM documents ORDER BY text, doc_id)
    UNION ALL SELECT sha256(text), 1, text FROM (SELECT DISTINCT text FROM documents)""",
)
def s12_precomputed_questions(spark, sf):
    """Questions written elsewhere, as JSON lines of a prompt and its texts."""
    folder = new_folder(spark, "precomputed")
    first = F.min_by("lang", "doc_id").alias("lang")
    rows = documents(spark, sf).groupBy("text").agg(first)
    lines = rows.select(F.col("text").alias("prompt"), F.array("lang", "text").alias("texts"))
    lines.write.json(folder)
    return read_precomputed(spark, folder)


# --- files ---------------------------------------------------------------


@query(
    "s6_run_file",
    f"""WITH {VECTORS}, {vector_hits_sql(50, "dv")}
    SELECT 'first' AS run_id, qid::VARCHAR AS qid, docid::VARCHAR AS docid, rank,
           round(score, 6) AS score FROM hits""",
)
def s6_run_file(spark, sf):
    """Hits written as a run file, twice, and read back."""
    folder = new_folder(spark, "runs")
    hits = dense_topk(query_vectors(spark, sf), document_vectors(spark, sf), 50)
    for _ in range(2):
        write_run(hits, folder, "first")
    return rounded(read_run(spark, folder), "score")


@query(
    "s10_experiment_log",
    f"""WITH {VECTORS}, {DOCUMENT_QRELS}, {vector_hits_sql(50, "dv")}, {ndcg_sql("hits")},
    result AS (SELECT round(sum(CASE WHEN ideal > 0 THEN coalesce(dcg, 0) / ideal ELSE 0 END)
                            / count(*), 6) AS ndcg FROM ideal LEFT JOIN dcgs USING (qid))
    SELECT 'embeddings' AS topic, 30::INTEGER AS first_n, NULL::DOUBLE AS question_coef,
           0.5::DOUBLE AS second_question_coef, ndcg AS indexer_ndcg,
           NULL::DOUBLE AS second_reranked_ndcg, ndcg / 2 AS third_reranked_ndcg FROM result""",
)
def s10_experiment_log(spark, sf):
    """A result appended to the log by name; what it lacks is null."""
    folder = new_folder(spark, "log")
    hits = dense_topk(query_vectors(spark, sf), document_vectors(spark, sf), 50)
    result = mean_ndcg(hits.withColumn("run_id", F.lit("first")), document_qrels(spark, sf))
    row = result.select(
        F.lit("embeddings").alias("topic"),
        F.lit(30).alias("first_n"),
        F.lit(0.5).alias("second_question_coef"),
        F.round("ndcg", 6).alias("indexer_ndcg"),
        (F.round("ndcg", 6) / 2).alias("third_reranked_ndcg"),
    )
    append_experiments(spark, row, folder)
    return read_experiments(spark, folder).select(
        "topic", "first_n", "question_coef", "second_question_coef", "indexer_ndcg",
        "second_reranked_ndcg", "third_reranked_ndcg",
    )


@query(
    "s11_dataset_tables",
    f"WITH {TOPICS}, {TEXT_QRELS} SELECT qid, title FROM topics WHERE qid IN (SELECT qid FROM qrels)",
)
def s11_dataset_tables(spark, sf):
    """The judged topics of a dataset, read from where the registry says it lies.

    An index that is to be searched with passages is the same index.
    """
    root = new_folder(spark, "datasets")
    dataset = resolve(root, "dl19-passage", "contriever")
    topics(spark, sf).write.parquet(dataset.topics)
    text_qrels(spark, sf).write.parquet(dataset.qrels)
    corpus(spark, sf).write.parquet(dataset.corpus)
    document_vectors(spark, sf).write.parquet(dataset.index)
    tables = resolve(root, "dl19-passage", "hyde_contriever").tables(spark)
    return judged(tables["topics"], tables["qrels"])


@query(
    "s3_judgement_files",
    f"""WITH {TOPICS}, {TEXT_QRELS}
    SELECT qid::VARCHAR AS qid, title, docid::VARCHAR AS docid, rel::INTEGER AS rel FROM qrels
    JOIN (SELECT qid, trim(replace(title, chr(10), ' ')) AS title FROM topics) USING (qid)""",
)
def s3_judgement_files(spark, sf):
    """Topics and judgements written as text files and read back."""
    folder = new_folder(spark, "files")
    title = F.trim(F.replace("title", F.lit("\n"), F.lit(" ")))
    topics(spark, sf).select(F.concat_ws("\t", "qid", title)).write.text(f"{folder}/topics")
    text_qrels(spark, sf).select(F.concat_ws(" ", "qid", F.lit("0"), "docid", "rel")).write.text(
        f"{folder}/qrels"
    )
    return read_qrels(spark, f"{folder}/qrels").join(read_topics(spark, f"{folder}/topics"), "qid")


# --- models --------------------------------------------------------------


@query(
    "m1_encode",
    f"""WITH texts AS (SELECT DISTINCT sha256(text) AS text_key, text FROM documents),
    {text_counts_sql("tv", "texts", "text_key", "text")}
    SELECT text_key, list(coalesce(c, 0)::DOUBLE ORDER BY i) AS vec
    FROM (SELECT text_key, i FROM texts, range(32) r(i))
    LEFT JOIN (SELECT text_key, d AS i, c FROM tv) USING (text_key, i) GROUP BY text_key""",
    vector="vec",
)
def m1_encode(spark, sf):
    """Every distinct text through an encoder callable, once."""
    texts = distinct_texts(documents(spark, sf))
    return encode_texts(texts, make_test_encoder, tasks=8)


@query(
    "m2_generate",
    """SELECT DISTINCT sha256(text) AS prompt_key, choice::INTEGER AS choice,
        'Questions:' || chr(10) || '1. ' || replace(text, '. ', '?' || chr(10) || '2. ')
        || '####tail' AS text FROM benchmark, range(2) r(choice)""",
)
def m2_generate(spark, sf):
    """Every topic text as a prompt, two completions each."""
    rows = distinct_texts(table(spark, sf, "benchmark"))
    prompts = rows.select(F.col("text_key").alias("prompt_key"), F.col("text").alias("prompt"))
    return generate(prompts, make_test_generator, n=2, tasks=8)


M1_SQL = f"""WITH texts AS (SELECT DISTINCT sha256(text) AS text_key, text FROM documents),
    {text_counts_sql("tv", "texts", "text_key", "text")}
    SELECT text_key, list(coalesce(c, 0)::DOUBLE ORDER BY i) AS vec
    FROM (SELECT text_key, i FROM texts, range(32) r(i))
    LEFT JOIN (SELECT text_key, d AS i, c FROM tv) USING (text_key, i) GROUP BY text_key"""


@query("m1_overwrite", M1_SQL, vector="vec")
def m1_overwrite(spark, sf):
    """Texts of which some have a stale vector in the store, all encoded again and replaced."""
    store = vector_store(new_folder(spark, "vectors"), "counts", "documents")
    texts = documents(spark, sf)
    stale = distinct_texts(texts).where("text_key < '8'")
    store.append(stale.select("text_key", F.array(F.lit(-1.0)).alias("vec")))
    return embed(texts, store, make_test_encoder, tasks=8, mode="overwrite")


@query("m1_stored_only", M1_SQL, vector="vec")
def m1_stored_only(spark, sf):
    """Vectors of texts that are all stored; nothing is encoded."""
    store = vector_store(new_folder(spark, "vectors"), "counts", "documents")
    texts = documents(spark, sf)
    embed(texts, store, make_test_encoder, tasks=8)
    return embed(texts, store, None, mode="stored")


def make_unsteady_generator():
    """The stand-in generator; some prompts always fail, some the first time they are asked alone."""
    import hashlib

    inner, asked = make_test_generator(), set()

    def complete(prompts, n, temperature):
        marks = {p: hashlib.md5(p.encode()).hexdigest()[0] for p in prompts}
        if any(m in "01" for m in marks.values()):
            raise RuntimeError("broken prompt")
        if any(m in "2345" for m in marks.values()):
            if len(prompts) > 1 or prompts[0] not in asked:
                asked.update(prompts if len(prompts) == 1 else ())
                raise RuntimeError("busy, please try again")
        return inner(prompts, n, temperature)

    return complete


@query(
    "m3_retry",
    """SELECT sha256(text) AS prompt_key, choice::INTEGER AS choice,
        CASE WHEN substr(md5(text), 1, 1) >= '2' THEN 'Questions:' || chr(10) || '1. '
            || replace(text, '. ', '?' || chr(10) || '2. ') || '####tail' END AS text
       FROM (SELECT DISTINCT text FROM documents), range(2) r(choice)
       WHERE substr(md5(text), 1, 1) >= '2' OR choice = 0""",
)
def m3_retry(spark, sf):
    """Prompts that fail for good get a null, those that fail once are asked again."""
    rows = distinct_texts(documents(spark, sf))
    prompts = rows.select(F.col("text_key").alias("prompt_key"), F.col("text").alias("prompt"))
    return generate(prompts, make_unsteady_generator, n=2, tasks=8, retries=1, wait=0.0, raises=False)


ONE_COMPLETION = """
completions AS (SELECT DISTINCT prompt_key, 0 AS choice, 'Questions:' || chr(10) || '1. '
                || replace(context, '. ', '?' || chr(10) || '2. ') || '####tail' AS text FROM asked)
"""


@query(
    "c5_questions",
    f"""WITH {CONTEXTS}, {PROMPTS}, {ONE_COMPLETION}, {questions_sql()}
    SELECT docid, pos, question FROM asked JOIN parsed USING (prompt_key)""",
)
def c5_questions(spark, sf):
    """Questions of every document, generated where the store has none."""
    store = generated_store(new_folder(spark, "questions"), "questions", "test", "documents")
    return ask(document_prompts(spark, sf), store, make_test_generator, Setting(), tasks=8)


@query(
    "c6_question_statistics",
    f"""WITH {VECTORS}, {CONTEXTS}, {PROMPTS}, {COMPLETIONS}, {questions_sql()}, {ASKED_QUESTIONS},
    placed AS (SELECT docid, {looked_up_sql("sha256(question)")} AS vec_id FROM cut_questions),
    dims AS (SELECT docid, i, avg(vec[i]) AS m, var_pop(vec[i]) AS v, count(*) AS n
             FROM placed JOIN emb USING (vec_id), range(1, 65) r(i) GROUP BY docid, i)
    SELECT docid, max(n) AS questions, list(round(m, 6) ORDER BY i) AS mean_vec,
           round(avg(v), 6) AS spread FROM dims GROUP BY docid""",
    vector="mean_vec",
)
def c6_question_statistics(spark, sf):
    """Mean vector and spread of every document's questions, after the cut."""
    asked = staged_prompts(spark, sf)
    whole = document_questions(asked, parse(completions(asked)))
    questions = stage(cut_no_content(stage(whole)))
    rows = looked_up_rows(spark, sf, questions, "question")
    held = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    # A document's questions lie scattered by their vectors, so that few combine before a shuffle,
    # and the moments of one are several times its vector; dealt out by document they need no other.
    found = question_vectors(questions, rows, held).repartition("docid")
    stats = document_statistics(found.withColumn("vec", as_vector(F.col("vec"))))
    return rounded(stats, "spread").withColumn("mean_vec", rounded_vector(F.col("mean_vec")))


@query(
    "c9_passage_search",
    f"""WITH {VECTORS}, {TOPICS},
    lines AS (SELECT qid, unnest(string_split_regex('Questions:' || chr(10) || '1. ' || replace(title, '. ',
                '?' || chr(10) || '2. '), '\\r\\n|[\\n\\r]')) AS line FROM topics),
    placed AS (SELECT qid, {looked_up_sql("sha256(trim(line))")} AS vec_id FROM lines
               UNION ALL SELECT qid, {looked_up_sql("sha256(title)")} FROM topics),
    means AS (SELECT qid, i, avg(vec[i]) AS m FROM placed JOIN emb USING (vec_id),
              range(1, 65) r(i) GROUP BY qid, i),
    averaged AS (SELECT qid, list(m ORDER BY i) AS vec FROM means GROUP BY qid),
    sims AS (SELECT qid, docid, list_dot_product(averaged.vec, dv.vec) AS score FROM averaged, dv)
    SELECT qid, docid, round(score, 6) AS score,
           row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid)::INTEGER AS rank
    FROM sims QUALIFY rank <= 20""",
)
def c9_passage_search(spark, sf):
    """Search with each topic's vector averaged with its passage lines' vectors."""
    asked = topics(spark, sf).withColumn("prompt", build_prompt(F.col("title"), "web search"))
    asked = asked.withColumn("prompt_key", text_key(F.col("prompt")))
    written = asked.select("prompt_key", F.lit(0).alias("choice"), test_completion(F.col("title")).alias("text"))
    passages = parse_documents(written.dropDuplicates(["prompt_key"]))
    titles = looked_up_vectors(spark, sf, asked, "title")
    own = asked.withColumn("text_key", text_key(F.col("title"))).join(titles, "text_key")
    vecs = passage_vectors(asked, passages, looked_up_vectors(spark, sf, passages, "passage"))
    hits = search_with_passages(own, vecs, document_vectors(spark, sf), 20)
    return rounded(hits, "score")


# --- the whole ranking ---------------------------------------------------

END_TO_END = f"""WITH {TOPICS}, {TEXT_QRELS}, {CONTEXTS}, {PROMPTS}, {ONE_COMPLETION},
    {questions_sql()},
    wanted AS (SELECT * FROM topics WHERE qid IN (SELECT qid FROM qrels)),
    query_terms AS (SELECT qid, term, count(*) AS weight FROM (SELECT qid,
        unnest(regexp_extract_all(lower(title), '\\p{{L}}+')) AS term FROM wanted) GROUP BY ALL),
    postings AS (SELECT docid, term, count(*) AS weight FROM (SELECT docid,
        unnest(regexp_extract_all(lower(context), '\\p{{L}}+')) AS term FROM ctx) GROUP BY ALL),
    sums AS (SELECT qid, docid, sum(q.weight * p.weight)::DOUBLE AS score
             FROM query_terms q JOIN postings p USING (term) GROUP BY qid, docid),
    hits AS (SELECT qid, docid, row_number() OVER (
               PARTITION BY qid ORDER BY score DESC, docid) AS place
             FROM sums QUALIFY place <= 100),
    {text_counts_sql("tv", "wanted", "qid", "title")},
    {text_counts_sql("dv", "(SELECT * FROM ctx WHERE docid IN (SELECT docid FROM hits))",
                     "docid", "context")},
    again AS (SELECT qid, docid, place, coalesce(sum(tv.c * dv.c), 0)::DOUBLE AS score
              FROM hits LEFT JOIN tv USING (qid) LEFT JOIN dv USING (docid, d) GROUP BY ALL),
    base AS (SELECT qid, docid, score, row_number() OVER (
               PARTITION BY qid ORDER BY score DESC, place)::INTEGER AS base_rank FROM again),
    heads AS (SELECT qid, docid, prompt_key FROM base JOIN asked USING (docid)
              WHERE base_rank <= 30),
    {text_counts_sql("hv", '''(SELECT DISTINCT question FROM parsed
        WHERE prompt_key IN (SELECT prompt_key FROM heads))''', "question", "question")},
    dots AS (SELECT qid, docid, pos, coalesce(sum(tv.c * hv.c), 0)::DOUBLE AS sim
             FROM heads JOIN parsed USING (prompt_key) LEFT JOIN tv USING (qid)
             LEFT JOIN hv USING (question, d) GROUP BY ALL),
    best AS (SELECT qid, docid, max(sim) AS question_score FROM dots GROUP BY ALL),
    scored AS (SELECT qid, docid, base_rank,
                 CASE WHEN base_rank <= 30 THEN score + coalesce(0.4::DOUBLE * question_score, 0)
                      ELSE score - 1e6 END AS score
               FROM base LEFT JOIN best USING (qid, docid)),
    reranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY base_rank > 30,
        CASE WHEN base_rank <= 30 THEN score END DESC, base_rank)::INTEGER AS rank FROM scored)
"""


SETTING = Setting(topic="documents", indexer="terms", encoder="counts")


def _whole_ranking(spark, sf):
    wanted = topics(spark, sf)
    texts = document_contexts(spark, sf)
    folder = new_folder(spark, "stores")
    return end_to_end(
        SETTING,
        wanted,
        text_qrels(spark, sf),
        corpus(spark, sf),
        term_weights(wanted, "qid", "title"),
        term_weights(texts, "docid", "context"),
        generated_store(f"{folder}/generated", "questions", "test", "documents"),
        generated_store(f"{folder}/generated", "passages", "test", "documents"),
        vector_store(f"{folder}/vectors", "counts", "documents"),
        make_test_generator,
        make_test_encoder,
        sparse=True,
        tasks=8,
    )


@query(
    "c14_end_to_end",
    END_TO_END + "SELECT qid, docid, rank, base_rank, round(score, 6) AS score FROM reranked",
)
def c14_end_to_end(spark, sf):
    """Term search, rerank by vectors, questions for the first 30, question rerank."""
    run = _whole_ranking(spark, sf).reranked
    return rounded(run.select("qid", "docid", "rank", "base_rank", "score"), "score")


ALL_RUNS = """
    all_runs AS (SELECT 'first' AS run_id, qid, docid, place::INTEGER AS rank, score
                 FROM hits JOIN sums USING (qid, docid)
                 UNION ALL SELECT 'base', qid, docid, base_rank, score FROM base
                 UNION ALL SELECT 'reranked', qid, docid, rank, score FROM reranked)
"""


def _written(spark, sf):
    folder = new_folder(spark, "ranking")
    _whole_ranking(spark, sf).write(text_qrels(spark, sf), SETTING, f"{folder}/runs", f"{folder}/log")
    return folder


@query(
    "c14_run_files",
    f"""{END_TO_END}, {ALL_RUNS} SELECT run_id, qid::VARCHAR AS qid, docid::VARCHAR AS docid, rank,
    round(score, 6) AS score FROM all_runs WHERE rank <= 100""",
)
def c14_run_files(spark, sf):
    """The whole ranking's three runs, read back from their files."""
    return rounded(read_run(spark, f"{_written(spark, sf)}/runs"), "score")


@query(
    "c14_experiment_log",
    f"""{END_TO_END}, {ALL_RUNS}, {ndcg_sql("all_runs", "run_id,")},
    means AS (SELECT run_id, sum(CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END)
                             / (SELECT count(*) FROM ideal) AS ndcg
              FROM dcgs JOIN ideal USING (qid) GROUP BY run_id)
    SELECT 'documents' AS topic, 'terms' AS indexer_name, 'counts' AS encoder_name,
           'max' AS method, 30::INTEGER AS first_n, 0.4::DOUBLE AS question_coef,
           round(max(ndcg) FILTER (run_id = 'first'), 6) AS indexer_ndcg,
           round(max(ndcg) FILTER (run_id = 'base'), 6) AS encoder_ndcg,
           round(max(ndcg) FILTER (run_id = 'reranked'), 6) AS reranked_ndcg FROM means""",
)
def c14_experiment_log(spark, sf):
    """The whole ranking's row of the log, read back from its file."""
    rows = read_experiments(spark, f"{_written(spark, sf)}/log")
    names = ["topic", "indexer_name", "encoder_name", "method", "first_n", "question_coef"]
    scores = ["indexer_ndcg", "encoder_ndcg", "reranked_ndcg"]
    return rows.select(*names, *[F.round(c, 6).alias(c) for c in scores])


# --- the other branches, with an encoder whose scores never tie -----------

PASSAGE_HEAD, PASSAGE_TAIL = (
    "Please write a passage to answer the question.\nQuestion: ",
    "\nEnd your passage with ####\nPassage:",
)


def dense_ranking_sql(base: str) -> str:
    """Tables of a whole dense ranking: ``first``, ``base`` by the given SQL, ``reranked``."""
    return f"""WITH {TOPICS}, {TEXT_QRELS}, {CONTEXTS}, {PROMPTS}, {ONE_COMPLETION},
    {questions_sql()}, {ASKED_QUESTIONS},
    wanted AS (SELECT qid, title, {hash_vector_sql("title")} AS vec, {hash_vector_sql("title", "i")} AS ivec
               FROM topics WHERE qid IN (SELECT qid FROM qrels)),
    held AS (SELECT docid, prompt_key, {hash_vector_sql("context")} AS vec,
                    {hash_vector_sql("context", "i")} AS ivec FROM asked),
    {base},
    heads AS (SELECT qid, docid FROM base WHERE rank <= 30),
    asked_vecs AS (SELECT question, {hash_vector_sql("question")} AS qvec FROM (
        SELECT DISTINCT question FROM cut_questions WHERE docid IN (SELECT docid FROM heads))),
    best AS (SELECT qid, docid, max(list_dot_product(vec, qvec)) AS question_score
             FROM heads JOIN cut_questions USING (docid) JOIN asked_vecs USING (question)
             JOIN wanted USING (qid) GROUP BY ALL),
    scored AS (SELECT qid, docid, rank AS base_rank,
                 CASE WHEN rank <= 30 THEN score + coalesce(0.4::DOUBLE * question_score, 0)
                      ELSE score - 1e6 END AS score
               FROM base LEFT JOIN best USING (qid, docid))
    SELECT qid, docid, row_number() OVER (PARTITION BY qid ORDER BY base_rank > 30,
        CASE WHEN base_rank <= 30 THEN score END DESC, base_rank)::INTEGER AS rank, base_rank,
        round(score, 6) AS score FROM scored"""


def first_sql(name: str, vec: str) -> str:
    return f"""{name} AS (SELECT qid, docid, list_dot_product(wanted.{vec}, held.{vec}) AS score,
        row_number() OVER (PARTITION BY qid ORDER BY list_dot_product(wanted.{vec}, held.{vec}) DESC, docid)::INTEGER
        AS rank FROM wanted, held QUALIFY rank <= 100)"""


def _hash_vectors(df, key, text, salt=""):
    """Vectors of the stand-in encoder of hashes, for an index."""
    keyed = df.select(F.col(key), F.col(text).alias("text"), text_key(F.col(text)).alias("text_key"))
    found = encode_texts(distinct_texts(keyed), partial(make_hash_encoder, 16, salt), tasks=8)
    return keyed.join(found, "text_key").select(key, "vec")


def _dense_ranking(spark, sf, indexer, encoder, salt):
    wanted, texts = topics(spark, sf), document_contexts(spark, sf)
    folder = new_folder(spark, "stores")
    runs = end_to_end(
        Setting(topic="documents", indexer=indexer, encoder=encoder),
        wanted,
        text_qrels(spark, sf),
        corpus(spark, sf),
        _hash_vectors(wanted, "qid", "title", salt),
        stage(_hash_vectors(texts, "docid", "context", salt)),
        generated_store(f"{folder}/generated", "questions", "test", "documents"),
        generated_store(f"{folder}/generated", "passages", "test", "documents", n=8),
        vector_store(f"{folder}/vectors", "hashes", "documents"),
        make_test_generator,
        partial(make_hash_encoder, 16),
        tasks=8,
    )
    return rounded(runs.reranked.select("qid", "docid", "rank", "base_rank", "score"), "score")


@query("c14_dense_first", dense_ranking_sql(first_sql("base", "vec")))
def c14_dense_first(spark, sf):
    """The encoder is that of the index: its hits go to the question rerank as they are."""
    return _dense_ranking(spark, sf, "hashes", "hashes", "")


@query(
    "c14_dense_vectors",
    dense_ranking_sql(
        first_sql("hits", "ivec")
        + """, again AS (SELECT qid, docid, hits.rank AS place, list_dot_product(wanted.vec, held.vec) AS score
               FROM hits JOIN wanted USING (qid) JOIN held USING (docid)),
        base AS (SELECT qid, docid, score, row_number() OVER (
                   PARTITION BY qid ORDER BY score DESC, place)::INTEGER AS rank FROM again)"""
    ),
)
def c14_dense_vectors(spark, sf):
    """Another encoder than that of the index scores its hits again."""
    return _dense_ranking(spark, sf, "index", "hashes", "i")


WRITTEN = f"""
    written AS (SELECT qid, 'Questions:' || chr(10) || '1. ' || replace('{PASSAGE_HEAD}' || title
                  || '{PASSAGE_TAIL}', '. ', '?' || chr(10) || '2. ') || '####tail' AS text FROM wanted)"""
AVERAGED = """
    dims AS (SELECT qid, i, sum(vec[i] * times) / sum(times) AS m FROM parts, range(1, 17) r(i) GROUP BY qid, i),
    averaged AS (SELECT qid, list(m ORDER BY i) AS mean_vec FROM dims GROUP BY qid)"""


@query(
    "c14_passages",
    dense_ranking_sql(
        WRITTEN
        + f""",
        lines AS (SELECT qid, {strip_sql("unnest(string_split_regex(split_part(text, '####', 1), '\\r\\n|[\\n\\r]'))")}
                    AS line FROM written),
        parts AS (SELECT qid, {hash_vector_sql("line")} AS vec, 8 AS times FROM lines
                  UNION ALL SELECT qid, vec, 1 FROM wanted), {AVERAGED},
        base AS (SELECT qid, docid, list_dot_product(mean_vec, held.vec) AS score, row_number() OVER (
                   PARTITION BY qid ORDER BY list_dot_product(mean_vec, held.vec) DESC, docid)::INTEGER AS rank
                 FROM averaged, held QUALIFY rank <= 100)"""
    ),
)
def c14_passages(spark, sf):
    """Hits of each topic's vector averaged with those of the lines of its eight passages."""
    return _dense_ranking(spark, sf, "hashes", "hyde-hashes", "")


@query(
    "c10_whole_completions",
    f"""WITH {TOPICS}, {CONTEXTS},
    wanted AS (SELECT qid, title, {hash_vector_sql("title")} AS vec FROM topics),
    {WRITTEN},
    parts AS (SELECT qid, {hash_vector_sql("text")} AS vec, 8 AS times FROM written
              UNION ALL SELECT qid, vec, 1 FROM wanted), {AVERAGED},
    held AS (SELECT docid, {hash_vector_sql("context")} AS vec FROM ctx)
    SELECT qid, docid, round(list_dot_product(mean_vec, held.vec), 6) AS score, row_number() OVER (
        PARTITION BY qid ORDER BY list_dot_product(mean_vec, held.vec) DESC, docid)::INTEGER AS rank
    FROM averaged, held QUALIFY rank <= 10""",
)
def c10_whole_completions(spark, sf):
    """Prompt, eight completions, their vectors and the title's averaged, and the search with it."""
    wanted, folder = topics(spark, sf), new_folder(spark, "stores")
    hits = passage_search(
        wanted,
        stage(_hash_vectors(wanted, "qid", "title")),
        _hash_vectors(document_contexts(spark, sf), "docid", "context"),
        Setting(topic="documents"),
        generated_store(f"{folder}/generated", "completions", "test", "documents", n=8),
        vector_store(f"{folder}/vectors", "hashes", "documents"),
        make_test_generator,
        partial(make_hash_encoder, 16),
        tasks=8,
        whole=True,
        k=10,
    )
    return rounded(hits, "score")
