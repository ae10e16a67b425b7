"""Queries over texts: documents, prompts, completions, conversations, term search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ctxrank.functions.prompts import (
    ASSISTANT_RULES,
    INSTRUCTION_WRAPPER,
    TASKS,
    build_prompt,
    chat_messages,
    fill,
)
from ctxrank.functions.text import (
    break_before_content,
    chat_line,
    collapse_whitespace,
    cut_completion,
)
from ctxrank.functions.vectors import text_key
from ctxrank.operators.conversation import conversation_prompts
from ctxrank.operators.models import test_vectors
from ctxrank.operators.questions import (
    chunk_documents,
    contexts,
    cut_no_content,
    distinct_prompts,
    document_questions,
    merge_chunk_questions,
    order_completions,
    parse,
    parse_documents,
    prompt_words,
    prompts,
)
from ctxrank.operators.bounded import bounded_sparse_topk, sparse_blocks
from ctxrank.operators.search import dense_topk, frequent_enough, judged, sparse_topk, term_index
from ctxrank.session import stage, table_bytes
from ctxrank.sources.store import missing
from ctxrank.sources.trec import parse_qrels, parse_topics, run_lines
from workload.fixtures import (
    ASKED_QUESTIONS,
    COMPLETIONS,
    CONTEXTS,
    PROMPTS,
    TEXT_QRELS,
    TOPICS,
    collapse_sql,
    completions,
    corpus,
    document_contexts,
    document_prompts,
    documents,
    questions_sql,
    staged_prompts,
    strip_sql,
    table,
    term_weights,
    text_counts_sql,
    text_hits_sql,
    text_qrels,
    topics,
)
from workload.registry import query


def sql_text(text: str) -> str:
    """A Python text as a SQL literal."""
    return "'" + text.replace("'", "''") + "'"


# --- sources -------------------------------------------------------------


@query(
    "s1_corpus_join",
    f"""WITH {CONTEXTS}, wanted AS (SELECT doc_id AS docid FROM labels
        UNION SELECT page_id + 1000000000 FROM pages)
    SELECT docid, coalesce(context, '') AS context FROM wanted LEFT JOIN ctx USING (docid)""",
)
def s1_corpus_join(spark, sf):
    """Texts of the labelled documents and of ids that the corpus lacks."""
    labelled = table(spark, sf, "labels").select(F.col("doc_id").alias("docid"))
    absent = table(spark, sf, "pages").select((F.col("page_id") + 1000000000).alias("docid"))
    return contexts(labelled.unionByName(absent), corpus(spark, sf))


@query(
    "s2_topics_lines",
    f"SELECT item_id::VARCHAR AS qid, {collapse_sql('text')} AS title FROM benchmark",
)
def s2_topics_lines(spark, sf):
    rows = table(spark, sf, "benchmark")
    line = F.concat_ws("\t", "item_id", collapse_whitespace(F.col("text")))
    return parse_topics(rows.select(line.alias("value")))


@query(
    "s3_qrels_lines",
    f"WITH {TOPICS}, {TEXT_QRELS} SELECT qid::VARCHAR AS qid, docid::VARCHAR AS docid, rel::INTEGER AS rel FROM qrels",
)
def s3_qrels_lines(spark, sf):
    line = F.concat_ws(" ", "qid", F.lit("0"), "docid", "rel")
    return parse_qrels(text_qrels(spark, sf).select(line.alias("value")))


@query("f1_doc_content", f"WITH {CONTEXTS} SELECT docid, context FROM ctx")
def f1_doc_content(spark, sf):
    return document_contexts(spark, sf)


@query("f2_collapse_html", f"SELECT page_id, {collapse_sql('html')} AS html FROM pages")
def f2_collapse_html(spark, sf):
    return table(spark, sf, "pages").select("page_id", collapse_whitespace(F.col("html")).alias("html"))


# --- prompts -------------------------------------------------------------

TASK_ROWS = ", ".join(f"({sql_text(t)}, {sql_text(p)})" for t, p in TASKS.items() if t != "mr-tydi")


@query(
    "f3_prompts",
    f"""WITH {CONTEXTS}, tasks(task, template) AS (VALUES {TASK_ROWS}),
    filled AS (SELECT docid, task, split_part(template, '{{}}', 1)
        || CASE task WHEN 'questions2_touche2020'
                THEN regexp_replace(context, '(\\bContent:)', chr(10) || '\\1', 'g') ELSE context END
        || split_part(template, '{{}}', 2) AS prompt FROM ctx, tasks)
    SELECT docid, task, md5(prompt) AS prompt_md5, length(prompt) AS chars FROM filled
    UNION ALL SELECT docid, 'none', md5(context), length(context) FROM ctx""",
)
def f3_prompts(spark, sf):
    """Every task's prompt for every document, and the pass-through."""
    text = F.col("context")
    each = [
        F.struct(F.lit(t or "none").alias("task"), build_prompt(text, t).alias("prompt"))
        for t in [*TASKS, None]
        if t != "mr-tydi"
    ]
    filled = document_contexts(spark, sf).select("docid", F.inline(F.array(*each)))
    return filled.select(
        "docid",
        "task",
        F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"),
        F.char_length("prompt").cast("bigint").alias("chars"),
    )


WRAPPER_PARTS = [sql_text(p) for p in INSTRUCTION_WRAPPER.split("{}")]


@query(
    "f4_wrapped_prompt",
    f"""WITH {CONTEXTS}, {PROMPTS}
    SELECT docid, md5({WRAPPER_PARTS[0]} || prompt || {WRAPPER_PARTS[1]}) AS prompt_md5
    FROM asked""",
)
def f4_wrapped_prompt(spark, sf):
    wrapped = prompts(document_contexts(spark, sf), "questions2", INSTRUCTION_WRAPPER)
    return wrapped.select("docid", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"))


@query(
    "f5_content_break",
    f"""WITH {CONTEXTS}
    SELECT docid, regexp_replace(context, '(\\bContent:)', chr(10) || '\\1', 'g') AS context
    FROM ctx""",
)
def f5_content_break(spark, sf):
    broken = break_before_content(F.col("context"))
    return document_contexts(spark, sf).select("docid", broken.alias("context"))


@query(
    "f6_language_prompt",
    """SELECT doc_id AS docid, md5('Please write a passage in ' || lang
        || ' to answer the question in detail.' || chr(10) || 'Question: ' || text || chr(10)
        || 'End your passage with ####' || chr(10) || 'Passage:') AS prompt_md5 FROM documents""",
)
def f6_language_prompt(spark, sf):
    prompt = fill(TASKS["mr-tydi"], F.col("lang"), F.col("text"))
    return documents(spark, sf).select(
        F.col("doc_id").alias("docid"), F.md5(prompt.cast("binary")).alias("prompt_md5")
    )


@query(
    "f15_text_key",
    "SELECT doc_id AS docid, sha256(text) AS text_key FROM documents",
)
def f15_text_key(spark, sf):
    rows = documents(spark, sf)
    return rows.select(F.col("doc_id").alias("docid"), text_key(F.col("text")).alias("text_key"))


@query(
    "f18_chat_messages",
    f"""WITH {CONTEXTS}, {PROMPTS}
    SELECT docid, 1::INTEGER AS place, 'user' AS role, md5(prompt) AS content_md5 FROM asked
    UNION ALL SELECT docid, 0, 'system', md5({sql_text(ASSISTANT_RULES)}) FROM asked""",
)
def f18_chat_messages(spark, sf):
    messages = F.posexplode(chat_messages(F.col("prompt"))).alias("place", "message")
    return document_prompts(spark, sf).select("docid", messages).select(
        "docid",
        "place",
        "message.role",
        F.md5(F.col("message.content").cast("binary")).alias("content_md5"),
    )


@query(
    "f21_prompt_words",
    f"""WITH {CONTEXTS}, {PROMPTS}
    SELECT docid, len(list_filter(string_split(prompt, ' '), lambda w: w <> ''))::INTEGER AS words
    FROM asked""",
)
def f21_prompt_words(spark, sf):
    return document_prompts(spark, sf).select("docid", prompt_words(F.col("prompt")).alias("words"))


CHUNKS = """
split_words AS (SELECT docid, string_split(context, ' ') AS words FROM ctx),
chunks AS (SELECT docid, i::INTEGER AS chunk,
                  array_to_string(words[i * 100 + 1 : i * 100 + 200], ' ') AS context
           FROM split_words, range(0, 100000) r(i)
           WHERE i <= greatest(ceil((len(words) - 200) / 100.0), 0))
"""


@query("f21_chunks", f"WITH {CONTEXTS}, {CHUNKS} SELECT docid, chunk, context FROM chunks")
def f21_chunks(spark, sf):
    return chunk_documents(document_contexts(spark, sf), 200, 100)


# --- completions ---------------------------------------------------------


@query(
    "f7_truncate",
    f"""WITH {CONTEXTS}, {PROMPTS}, {COMPLETIONS}
    SELECT prompt_key, choice::INTEGER AS choice, split_part(text, '####', 1) AS text
    FROM completions""",
)
def f7_truncate(spark, sf):
    return completions(document_prompts(spark, sf)).withColumn("text", cut_completion(F.col("text")))


@query(
    "f8_parse_questions",
    f"""WITH {CONTEXTS}, {PROMPTS}, {COMPLETIONS}, {questions_sql()}
    SELECT prompt_key, pos, question FROM parsed""",
)
def f8_parse_questions(spark, sf):
    return parse(completions(document_prompts(spark, sf)))


@query(
    "f8_parse_literal_strip",
    f"""WITH {CONTEXTS}, {PROMPTS}, {COMPLETIONS}, {questions_sql(True)}
    SELECT prompt_key, pos, question FROM parsed""",
)
def f8_parse_literal_strip(spark, sf):
    return parse(completions(document_prompts(spark, sf)), literal_strip=True)


@query(
    "f9_passage_lines",
    rf"""WITH texts AS (SELECT DISTINCT sha256(text) AS prompt_key, text FROM documents),
    lines AS (SELECT prompt_key, text, string_split_regex(split_part(text, '####', 1),
                '\r\n|[\n\r\x{{0B}}\x{{0C}}\x{{1C}}-\x{{1E}}\x{{85}}\x{{2028}}\x{{2029}}]') AS parts
              FROM texts),
    kept AS (SELECT prompt_key, CASE WHEN parts[-1] = '' THEN parts[:len(parts) - 1]
                                     ELSE parts END AS parts FROM lines),
    each AS (SELECT prompt_key, unnest(parts) AS line, generate_subscripts(parts, 1) AS i
             FROM kept)
    SELECT prompt_key, (i - 1)::INTEGER AS pos, {strip_sql("line")} AS passage FROM each""",
)
def f9_passage_lines(spark, sf):
    """Each distinct document text read as a completion."""
    texts = documents(spark, sf).select(
        text_key(F.col("text")).alias("prompt_key"), F.lit(0).alias("choice"), "text"
    )
    return parse_documents(texts.dropDuplicates(["prompt_key"]))


@query(
    "f10_empty_guard",
    f"""WITH {CONTEXTS}, {PROMPTS}
    SELECT docid, context = 'Title: ' || split_part(substr(context, 8), ' Content:', 1)
           || ' Content:' AS empty FROM (
        SELECT docid, context FROM asked UNION ALL
        SELECT doc_id + 1000000, {collapse_sql("'Title: ' || source || ' Content: '")}
        FROM documents)""",
)
def f10_empty_guard(spark, sf):
    """Every document, and every document again with a title but no text."""
    bare = documents(spark, sf).select(
        (F.col("doc_id") + 1000000).alias("docid"),
        collapse_whitespace(F.concat(F.lit("Title: "), "source", F.lit(" Content: "))).alias(
            "context"
        ),
    )
    both = document_contexts(spark, sf).unionByName(bare)
    return prompts(both, "questions2").select("docid", "empty")


@query(
    "p5_no_content_cut",
    f"""WITH {CONTEXTS}, {PROMPTS}, {COMPLETIONS}, {questions_sql()}, {ASKED_QUESTIONS}
    SELECT docid, pos, question FROM cut_questions""",
)
def p5_no_content_cut(spark, sf):
    """Questions of every document, cut at the first that says there is no content."""
    asked = staged_prompts(spark, sf)
    questions = document_questions(asked, parse(completions(asked)))
    return cut_no_content(stage(questions))


@query(
    "j4_missing_prompts",
    f"""WITH {CONTEXTS}, {PROMPTS}, held AS (
        SELECT prompt_key FROM asked JOIN labels ON docid = doc_id)
    SELECT prompt_key, max(md5(prompt)) AS prompt_md5 FROM asked
    WHERE prompt_key NOT IN (SELECT prompt_key FROM held) GROUP BY prompt_key""",
)
def j4_missing_prompts(spark, sf):
    """Distinct prompts that the store, here those of labelled documents, lacks."""
    asked = stage(document_prompts(spark, sf).drop("context"))
    labelled = table(spark, sf, "labels").select(F.col("doc_id").alias("docid"))
    held = asked.join(labelled, "docid", "left_semi").select("prompt_key")
    wanted = missing(distinct_prompts(asked), held, "prompt_key")
    return wanted.select("prompt_key", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"))


@query(
    "w4_order_completions",
    """SELECT conv_id::VARCHAR AS prompt_key, turn::INTEGER AS choice,
              round(-sqrt(length(text)) * 0.5 - length(role), 6) AS logprob,
              row_number() OVER (PARTITION BY conv_id
                  ORDER BY -sqrt(length(text)) * 0.5 - length(role) DESC, turn)::INTEGER AS place
       FROM conversations""",
)
def w4_order_completions(spark, sf):
    """Each conversation's turns as completions with log-probabilities."""
    length = F.char_length("text").cast("double")
    logprobs = F.array(F.sqrt(length) * -0.5, -F.char_length("role").cast("double"))
    rows = table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("prompt_key"),
        F.col("turn").cast("int").alias("choice"),
        logprobs.alias("logprobs"),
    )
    ordered = order_completions(rows)
    return ordered.select("prompt_key", "choice", F.round("logprob", 6).alias("logprob"), "place")


@query(
    "a16_distinct_chunk_questions",
    f"""WITH {CONTEXTS}, {CHUNKS},
    completions AS (SELECT docid AS prompt_key, chunk AS choice,
                    '1. ' || replace(context, '. ', '?' || chr(10) || '2. ') AS text FROM chunks),
    {questions_sql()}
    SELECT DISTINCT prompt_key AS docid, question FROM parsed""",
)
def a16_distinct_chunk_questions(spark, sf):
    """Questions of all chunks of a document, each once."""
    chunks = chunk_documents(document_contexts(spark, sf), 200, 100)
    text = F.concat(F.lit("1. "), F.replace("context", F.lit(". "), F.lit("?\n2. ")))
    written = chunks.select(
        F.col("docid").alias("prompt_key"), F.col("chunk").alias("choice"), text.alias("text")
    )
    return merge_chunk_questions(parse(written).withColumnRenamed("prompt_key", "docid"))


# --- conversations -------------------------------------------------------


@query(
    "a13_conversation_prompt",
    """SELECT conv_id, 0::BIGINT AS part,
              string_agg(role || ': ' || text, chr(10) ORDER BY turn) || chr(10) || 'assistant: '
              AS prompt
       FROM conversations GROUP BY conv_id""",
)
def a13_conversation_prompt(spark, sf):
    return conversation_prompts(table(spark, sf, "conversations"))


@query(
    "a13_prompt_parts",
    """WITH lines AS (SELECT conv_id, turn, role || ': ' || text AS line FROM conversations
        UNION ALL SELECT conv_id, max(turn) + 1, 'assistant: ' FROM conversations GROUP BY conv_id)
    SELECT conv_id, turn // 3 AS part, string_agg(line, chr(10) ORDER BY turn) AS prompt
    FROM lines GROUP BY conv_id, turn // 3""",
)
def a13_prompt_parts(spark, sf):
    return conversation_prompts(table(spark, sf, "conversations"), turns_per_part=3)


@query(
    "f19_message_lines",
    """SELECT conv_id, turn, role || ': ' || text || CASE WHEN role = 'system'
              THEN chr(10) || '{"lang":"' || role || '"}' ELSE '' END AS line FROM conversations""",
)
def f19_message_lines(spark, sf):
    extras = F.when(F.col("role") == "system", F.create_map(F.lit("lang"), F.col("role")))
    empty = F.create_map().cast("map<string,string>")
    line = chat_line(F.col("role"), F.col("text"), F.coalesce(extras, empty))
    return table(spark, sf, "conversations").select("conv_id", "turn", line.alias("line"))


# --- search --------------------------------------------------------------

TERMS = """
query_terms AS (SELECT qid, term, count(*) AS weight FROM (
    SELECT item_id AS qid, unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS term
    FROM benchmark) GROUP BY ALL),
postings AS (SELECT docid, term, count(*) AS weight FROM (
    SELECT doc_id AS docid, unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS term
    FROM documents) GROUP BY ALL)
"""


def _sparse_sql(terms: str = "query_terms", rounded: str = "score") -> str:
    return f"""WITH {TERMS}, rare AS (SELECT term FROM postings GROUP BY term
        HAVING ln((SELECT count(*) FROM documents) / count(*)) >= 1.0),
    chosen AS (SELECT * FROM query_terms WHERE term IN (SELECT term FROM rare)),
    sums AS (SELECT qid, docid, sum(q.weight * p.weight)::DOUBLE AS score
             FROM {terms} q JOIN postings p USING (term) GROUP BY qid, docid)
    SELECT qid, docid, {rounded},
           row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid)::INTEGER AS rank
    FROM sums QUALIFY rank <= 100"""


def _sparse(spark, sf, blocks=1, **options):
    """Search over the staged index, by so many blocks of queries."""
    queries = term_weights(topics(spark, sf), "qid", "title")
    texts = table(spark, sf, "documents").withColumnRenamed("doc_id", "docid")
    index = stage(term_index(term_weights(texts, "docid", "text")))
    if blocks > 1:
        options["broadcast_bytes"] = table_bytes(queries) // blocks + 1
    return sparse_topk(queries, index, 100, **options)


@query("c3_sparse_topk", _sparse_sql())
def c3_sparse_topk(spark, sf):
    return _sparse(spark, sf)


@query("c3_sparse_topk_salted", _sparse_sql())
def c3_sparse_topk_salted(spark, sf):
    """The same search in blocks of queries, as for query sides too large to broadcast."""
    return _sparse(spark, sf, blocks=4)


@query("c3_sparse_topk_bounded", _sparse_sql())
def c3_sparse_topk_bounded(spark, sf):
    """The same hits from blocks with each term's extreme weights, skipping those below the floors."""
    texts = table(spark, sf, "documents").withColumnRenamed("doc_id", "docid")
    blocks = sparse_blocks(term_index(term_weights(texts, "docid", "text")))
    return bounded_sparse_topk(term_weights(topics(spark, sf), "qid", "title"), blocks, 100)


@query("c3_sparse_min_idf", _sparse_sql("chosen"))
def c3_sparse_min_idf(spark, sf):
    count = table(spark, sf, "documents").count()
    return _sparse(spark, sf, min_idf=1.0, documents=count)


@query(
    "p8_min_idf",
    f"""WITH {TERMS} SELECT qid, term, weight FROM query_terms WHERE term IN (
        SELECT term FROM postings GROUP BY term
        HAVING ln((SELECT count(*) FROM documents) / count(*)) >= 1.0)""",
)
def p8_min_idf(spark, sf):
    queries = term_weights(topics(spark, sf), "qid", "title")
    texts = table(spark, sf, "documents").withColumnRenamed("doc_id", "docid")
    postings = stage(term_weights(texts, "docid", "text"))
    return frequent_enough(queries, postings, texts.count(), 1.0)


@query(
    "m4_test_vectors",
    f"""WITH {CONTEXTS}, {text_counts_sql("dv", "ctx", "docid", "context")}
    SELECT docid, list(coalesce(c, 0)::DOUBLE ORDER BY i) AS vec
    FROM (SELECT docid, i FROM ctx, range(32) r(i)) LEFT JOIN
         (SELECT docid, d AS i, c FROM dv) USING (docid, i) GROUP BY docid""",
    vector="vec",
)
def m4_test_vectors(spark, sf):
    return test_vectors(document_contexts(spark, sf), "docid", "context")


@query(
    "c1_first_stage",
    f"""WITH {TOPICS}, {TEXT_QRELS}, {CONTEXTS}, {text_hits_sql(100)}
    SELECT qid, docid, rank, score FROM hits""",
)
def c1_first_stage(spark, sf):
    """Top documents of the judged topics, by stand-in vectors of the whole texts."""
    wanted = judged(topics(spark, sf), text_qrels(spark, sf))
    queries = test_vectors(wanted, "qid", "title")
    return dense_topk(queries, test_vectors(document_contexts(spark, sf), "docid", "context"), 100)


@query(
    "s4_run_lines",
    f"""WITH {TOPICS}, {TEXT_QRELS}, {CONTEXTS}, {text_hits_sql(100)}
    SELECT qid, rank, qid || ' Q0 ' || docid || ' ' || rank || ' ' || score || ' rank' AS line
    FROM hits""",
)
def s4_run_lines(spark, sf):
    return run_lines(c1_first_stage(spark, sf))
