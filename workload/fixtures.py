"""Ranking inputs derived from the given tables, in Spark and in SQL.

Every row of a table takes part: ``embeddings`` in groups of five is split by
role into queries, contexts and questions; ``benchmark`` gives the topics and
``documents`` the corpus of the text queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxrank.functions.text import document_text, terms
from ctxrank.functions.vectors import as_vector, text_key
from ctxrank.operators.models import test_completion
from ctxrank.operators.questions import prompts
from ctxrank.operators.search import dense_topk
from ctxrank.session import by_bytes, spread, stage

POOL = 25


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents"), "doc_id")


# --- vectors -------------------------------------------------------------


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    group = F.floor(F.col("vec_id") / 5)
    return table(spark, sf, "embeddings").select(
        "vec_id",
        group.alias("g"),
        (F.col("vec_id") % 5).cast("int").alias("p"),
        "label",
        as_vector(F.col("embedding")).alias("vec"),
    )


def query_vectors(spark: SparkSession, sf: str) -> DataFrame:
    rows = vectors(spark, sf).where("g % 10 = 0")
    return rows.select(F.col("vec_id").alias("qid"), "label", "vec")


def context_vectors(spark: SparkSession, sf: str) -> DataFrame:
    rows = vectors(spark, sf).where("g % 10 <> 0 and p = 0")
    return rows.select(F.col("g").alias("docid"), "label", "vec")


def document_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Every row of ``embeddings`` as a document."""
    return vectors(spark, sf).select(F.col("vec_id").alias("docid"), "label", "vec")


def question_table(spark: SparkSession, sf: str) -> DataFrame:
    rows = vectors(spark, sf).where("g % 10 <> 0 and p > 0")
    return rows.select(F.col("g").alias("docid"), (F.col("p") - 1).alias("pos"), "vec")


def vector_qrels(spark: SparkSession, sf: str) -> DataFrame:
    """Each context is judged for a pool of queries, by distance of labels."""
    queries = query_vectors(spark, sf).select("qid", F.col("label").alias("query_label"))
    count = queries.agg(F.count("*")).scalar()
    pool = (
        context_vectors(spark, sf)
        .select("docid", "label", F.explode(F.sequence(F.lit(0), F.lit(POOL - 1))).alias("j"))
        .withColumn("i", (F.col("docid") * 3 + F.col("j") * 7) % count)
        .withColumn("qid", F.floor(F.col("i") / 5) * 50 + F.col("i") % 5)
    )
    distance = F.abs(F.col("query_label") - F.col("label"))
    rel = F.when(distance == 0, 2).when(distance == 1, 1).otherwise(0)
    return pool.join(queries, "qid").select("qid", "docid", rel.alias("rel"))


def vector_hits(spark: SparkSession, sf: str, k: int = 50) -> DataFrame:
    """First-stage hits, staged because several steps read them."""
    return stage(dense_topk(query_vectors(spark, sf), context_vectors(spark, sf), k))


VECTORS = """
emb AS (SELECT vec_id, vec_id // 5 AS g, vec_id % 5 AS p, label, embedding::DOUBLE[] AS vec
        FROM embeddings),
qv AS (SELECT vec_id AS qid, label, vec FROM emb WHERE g % 10 = 0),
cv AS (SELECT g AS docid, label, vec FROM emb WHERE g % 10 <> 0 AND p = 0),
hv AS (SELECT g AS docid, (p - 1)::INTEGER AS pos, vec FROM emb WHERE g % 10 <> 0 AND p > 0),
dv AS (SELECT vec_id AS docid, label, vec FROM emb)
"""

VECTOR_QRELS = f"""
pool AS (SELECT docid, label, (docid * 3 + j * 7) % (SELECT count(*) FROM qv) AS i
         FROM cv, range({POOL}) r(j)),
qrels AS (SELECT qid, docid,
                 CASE abs(qv.label - pool.label) WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS rel
          FROM pool JOIN qv ON qid = (i // 5) * 50 + i % 5)
"""


def vector_hits_sql(k: int = 50, docs: str = "cv") -> str:
    return f"""
sims AS (SELECT qid, docid, list_dot_product(qv.vec, {docs}.vec) AS score FROM qv, {docs}),
hits AS (SELECT qid, docid, score,
                row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid)::INTEGER AS rank
         FROM sims QUALIFY rank <= {k})
"""


QUESTION_STATS = """
dots AS (SELECT qid, docid, list_dot_product(qv.vec, hv.vec) AS sim FROM hv, qv),
best AS (SELECT qid, docid, max(sim) AS max_sim, avg(sim) AS mean_sim, count(*) AS questions
         FROM dots GROUP BY qid, docid),
dims AS (SELECT docid, i, avg(vec[i]) AS m, var_pop(vec[i]) AS v
         FROM hv, range(1, 65) r(i) GROUP BY docid, i),
spreads AS (SELECT docid, avg(v) AS spread FROM dims GROUP BY docid),
stats AS (SELECT qid, docid, max_sim, mean_sim, questions, spread
          FROM best JOIN spreads USING (docid))
"""


def rerank_sql(score: str, coef: float, first_n: int) -> str:
    """The question rerank with the penalised tail, from ``hits`` and ``stats``."""
    return f"""
scored AS (SELECT h.qid, h.docid, h.rank AS base_rank,
                  CASE WHEN h.rank <= {first_n} THEN h.score + coalesce({coef} * ({score}), 0)
                       ELSE h.score - 1e6 END AS score,
                  CASE WHEN h.rank <= {first_n} THEN {score} ELSE -1e6 END AS question_score
           FROM hits h LEFT JOIN stats USING (qid, docid)),
reranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY (base_rank > {first_n}),
                    CASE WHEN base_rank <= {first_n} THEN score END DESC, base_rank)::INTEGER
                    AS rank FROM scored)
"""


def ndcg_sql(run: str, keys: str = "", cut: int = 10) -> str:
    """Tables ``ideal(qid, ideal)`` and ``dcgs(keys, qid, dcg)``; keys end in a comma."""
    return f"""
ideal AS (SELECT qid, sum(rel / log2(place + 1)) AS ideal FROM
          (SELECT qid, rel, row_number() OVER (PARTITION BY qid ORDER BY rel DESC) AS place
           FROM qrels) WHERE place <= {cut} GROUP BY qid),
placed AS (SELECT {keys} qid, docid, row_number() OVER (
             PARTITION BY {keys} qid ORDER BY score DESC, docid::VARCHAR DESC) AS place FROM {run}),
dcgs AS (SELECT {keys} p.qid, sum(coalesce(rel, 0) / log2(place + 1)) AS dcg
         FROM placed p LEFT JOIN qrels r ON p.qid = r.qid AND p.docid = r.docid
         WHERE place <= {cut} GROUP BY {keys} p.qid)
"""


# The context of group g is row 5 g of the table, where all rows are documents.
DOCUMENT_QRELS = VECTOR_QRELS.replace("qrels AS (SELECT qid, docid,", "qrels AS (SELECT qid, 5 * docid AS docid,")


def document_qrels(spark: SparkSession, sf: str) -> DataFrame:
    return vector_qrels(spark, sf).withColumn("docid", 5 * F.col("docid"))


# --- texts ---------------------------------------------------------------


def topics(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("qid"), F.col("text").alias("title")
    )


def text_qrels(spark: SparkSession, sf: str) -> DataFrame:
    """Each labelled document is judged for five topics; only every other topic is judged."""
    count = topics(spark, sf).agg(F.count("*")).scalar()
    rel = F.when(F.col("quality") == 1, 2 - F.col("toxic")).otherwise(0)
    return (
        table(spark, sf, "labels")
        .select(F.col("doc_id").alias("docid"), rel.alias("rel"),
                F.explode(F.sequence(F.lit(0), F.lit(4))).alias("j"))
        .select(((F.col("docid") * 6 + F.col("j") * 2) % count).alias("qid"), "docid", "rel")
    )


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Raw JSON documents in the three shapes a corpus may have."""
    shape = F.col("doc_id") % 3
    raw = (
        F.when(shape == 0, F.to_json(F.struct(F.col("source").alias("title"), "text")))
        .when(shape == 1, F.to_json(F.struct(F.col("text").alias("contents"))))
        .otherwise(F.to_json(F.struct(F.col("text").alias("passage"))))
    )
    return documents(spark, sf).select(F.col("doc_id").alias("docid"), raw.alias("raw"))


def document_contexts(spark: SparkSession, sf: str) -> DataFrame:
    return corpus(spark, sf).select("docid", document_text(F.col("raw")).alias("context"))


def document_prompts(spark: SparkSession, sf: str) -> DataFrame:
    return prompts(document_contexts(spark, sf), "questions2").select(
        "docid", "context", "prompt", "prompt_key", "empty"
    )


def two_choices(context: Column) -> Column:
    """Two completions and a failed one; for half of the documents one says "No Content"."""
    mark = F.substring(F.md5(context.cast("binary")), 1, 1)
    opening = F.when(mark < "2", "No Content\n").otherwise("")
    second = F.when(mark < "8", "No Content\n- and then?").otherwise(
        "- who asks this?\n- who wants to know"
    )
    return F.array(F.concat(opening, test_completion(context)), second, F.lit(None))


def staged_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """The documents' prompt keys, staged because several steps read them."""
    return stage(document_prompts(spark, sf).drop("prompt"))


def completions(asked: DataFrame) -> DataFrame:
    """``(prompt_key, choice, text)``: three choices per distinct prompt, the last failed."""
    distinct = asked.select("prompt_key", "context").distinct()
    return distinct.select(
        "prompt_key", F.posexplode(two_choices(F.col("context"))).alias("choice", "text")
    )


def term_weights(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, term, weight)``: term counts.

    Texts are dealt out by key in tasks of a bounded size, which count their words without
    another shuffle.
    """
    texts = by_bytes(df.select(key, text), key)
    words = texts.select(key, F.explode(terms(F.col(text))).alias("term"))
    return words.groupBy(key, "term").agg(F.count("*").alias("weight"))


# The characters of both classes, in the syntax of the SQL engine.
WHITESPACE = (
    r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
LINE_END = r"\r\n|[\n\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"


def looked_up_rows(spark: SparkSession, sf: str, texts: DataFrame, text: str) -> DataFrame:
    """``(text_key, vec_id)``: for each distinct text a row of ``embeddings``, by hash."""
    count = table(spark, sf, "embeddings").agg(F.count("*")).scalar()
    keys = texts.select(text_key(F.col(text)).alias("text_key")).distinct()
    place = F.conv(F.substring("text_key", 1, 8), 16, 10).cast("bigint") % count
    return keys.withColumn("vec_id", place)


def looked_up_vectors(spark: SparkSession, sf: str, texts: DataFrame, text: str) -> DataFrame:
    """``(text_key, vec)``: the vector of each distinct text's row."""
    held = vectors(spark, sf).select("vec_id", "vec")
    return looked_up_rows(spark, sf, texts, text).join(held, "vec_id").select("text_key", "vec")


def looked_up_sql(text_key: str) -> str:
    """The ``vec_id`` whose vector a text key stands for."""
    return f"('0x' || substr({text_key}, 1, 8))::BIGINT % (SELECT count(*) FROM embeddings)"


def collapse_sql(text: str) -> str:
    return f"trim(regexp_replace({text}, '{WHITESPACE}+', ' ', 'g'))"


def strip_sql(text: str) -> str:
    return rf"regexp_replace({text}, '\A{WHITESPACE}+|{WHITESPACE}+\z', '', 'g')"


def clean_sql(text: str, literal_strip: bool = False) -> str:
    if literal_strip:
        cleaned = rf"regexp_replace({strip_sql(text)}, '\A\\+|\\+\z', '', 'g')"
        cleaned = rf"regexp_replace({cleaned}, '\A[\\n]+', '')"
    else:
        cleaned = rf"regexp_replace({strip_sql(text)}, '\A(?:\\n|\\)+|\\+\z', '', 'g')"
    return rf"regexp_replace(lower({cleaned}), '\A(?:\p{{Nd}}+\.|-{WHITESPACE})', '')"


TOPICS = "topics AS (SELECT item_id AS qid, text AS title FROM benchmark)"

TEXT_QRELS = """
qrels AS (SELECT (doc_id * 6 + j * 2) % (SELECT count(*) FROM topics) AS qid, doc_id AS docid,
                 CASE WHEN quality = 1 THEN 2 - toxic ELSE 0 END AS rel
          FROM labels, range(5) r(j))
"""

CONTEXTS = f"""
ctx AS (SELECT doc_id AS docid, {collapse_sql(
    "CASE WHEN doc_id % 3 = 0 THEN 'Title: ' || source || ' Content: ' || text ELSE text END"
)} AS context FROM documents)
"""

PROMPT_HEAD = (
    "Which kinds of questions can be answered based on the following passage:\n\n```<passage>"
)
PROMPT_TAIL = (
    "\n</passage>```\nQuestions must be very short, different, and be written on separate"
    " lines.\nIf the passage provides no meaningful content, respond with a ''No Content''.\n\n"
)

PROMPTS = f"""
asked AS (SELECT docid, context, '{PROMPT_HEAD}' || context || '{PROMPT_TAIL}' AS prompt,
                 sha256('{PROMPT_HEAD}' || context || '{PROMPT_TAIL}') AS prompt_key FROM ctx)
"""

COMPLETIONS = """
marked AS (SELECT DISTINCT prompt_key, context, substr(md5(context), 1, 1) AS mark FROM asked),
completions AS (
  SELECT prompt_key, 0 AS choice,
         CASE WHEN mark < '2' THEN 'No Content' || chr(10) ELSE '' END || 'Questions:' || chr(10)
         || '1. ' || replace(context, '. ', '?' || chr(10) || '2. ') || '####tail' AS text
  FROM marked
  UNION ALL
  SELECT prompt_key, 1, CASE WHEN mark < '8' THEN 'No Content' || chr(10) || '- and then?'
         ELSE '- who asks this?' || chr(10) || '- who wants to know' END FROM marked
  UNION ALL SELECT prompt_key, 2, NULL FROM marked)
"""


def questions_sql(literal_strip: bool = False) -> str:
    """Table ``parsed(prompt_key, pos, question)`` from ``completions``."""
    return f"""
pieces AS (SELECT prompt_key, choice, unnest(parts) AS piece, generate_subscripts(parts, 1) AS i
           FROM (SELECT prompt_key, choice,
                        string_split_regex(split_part(text, '####', 1), '{LINE_END}|\\?') AS parts
                 FROM completions WHERE text IS NOT NULL)),
cleaned AS (SELECT prompt_key, choice, i, {clean_sql("piece", literal_strip)} AS question
            FROM pieces WHERE NOT contains(piece, 'Questions:')),
parsed AS (SELECT prompt_key, question, (row_number() OVER (
             PARTITION BY prompt_key ORDER BY choice, i) - 1)::INTEGER AS pos
           FROM cleaned WHERE length(question) > 5)
"""


ASKED_QUESTIONS = f"""
raw_questions AS (SELECT docid, pos, question FROM asked JOIN parsed USING (prompt_key)
                  WHERE NOT contains(prompt, 'Content:' || chr(10) || '</passage>')
                  UNION ALL SELECT docid, 0, 'no content' FROM asked
                  WHERE contains(prompt, 'Content:' || chr(10) || '</passage>')),
cuts AS (SELECT docid, min(pos) FILTER (contains(lower(question), 'no content')) AS cut,
                min(pos) AS first FROM raw_questions GROUP BY docid),
cut_questions AS (SELECT docid, pos, question FROM raw_questions JOIN cuts USING (docid)
                  WHERE cut IS NULL OR pos < cut
                  UNION ALL SELECT docid, cut, 'no content' FROM cuts WHERE cut = first)
"""


def text_counts_sql(name: str, source: str, key: str, text: str) -> str:
    """Table ``name(key, d, c)``: the non-zero entries of the stand-in vectors."""
    return f"""
{name}_words AS (SELECT {key}, unnest(regexp_extract_all(lower({text}), '\\p{{L}}+')) AS term
                 FROM {source}),
{name} AS (SELECT {key}, (('0x' || substr(md5(term), 1, 8))::BIGINT % 32)::INTEGER AS d,
                  count(*) AS c FROM {name}_words GROUP BY ALL)
"""


def hash_vector_sql(text: str, salt: str = "") -> str:
    """The vector of the stand-in encoder of hashes."""
    return f"""list_transform(range(16), lambda d:
        ('0x' || substr(md5('{salt}' || {text} || ':' || d), 1, 8))::BIGINT / 4294967296.0::DOUBLE - 0.5)"""


def text_hits_sql(k: int) -> str:
    """Table ``hits`` of judged topics over the stand-in vectors of the contexts."""
    return f"""
{text_counts_sql("tv", "(SELECT * FROM topics WHERE qid IN (SELECT qid FROM qrels))",
                 "qid", "title")},
{text_counts_sql("dv", "ctx", "docid", "context")},
pairs AS (SELECT qid, docid FROM (SELECT DISTINCT qid FROM topics
          WHERE qid IN (SELECT qid FROM qrels)), ctx),
text_dots AS (SELECT qid, docid, sum(tv.c * dv.c)::DOUBLE AS score
              FROM tv JOIN dv USING (d) GROUP BY qid, docid),
hits AS (SELECT qid, docid, coalesce(score, 0) AS score,
                row_number() OVER (PARTITION BY qid ORDER BY coalesce(score, 0) DESC, docid)::INTEGER
                AS rank FROM pairs LEFT JOIN text_dots USING (qid, docid) QUALIFY rank <= {k})
"""
