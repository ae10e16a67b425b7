"""The registered queries: each operator over its whole table, and its SQL where there is one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxrank.llm import (
    alignment,
    chat,
    decision_list,
    decontamination,
    filter_audit,
    lines,
    neighbours,
    ngram_join,
    packing,
    repeats,
    secrets,
    toxicity,
    urls,
)
from ctxrank.llm.tables import ORACLES, QUERIES, query, table  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query(
    "op5_line_dedup",
    f"""
    WITH line AS (
        SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
        FROM documents),
    keyed AS (
        SELECT *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'),
                            '{UPPER}', '{LOWER}') AS line_key
        FROM line),
    common AS (
        SELECT line_key, max(doc_id) AS top FROM keyed WHERE length(line_key) >= 40
        GROUP BY line_key HAVING count(DISTINCT doc_id) >= 5),
    marked AS (
        SELECT k.*, c.line_key IS NOT NULL AND k.doc_id <> c.top AS dropped
        FROM keyed k LEFT JOIN common c USING (line_key))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
    FROM marked GROUP BY doc_id""",
)
def op5_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    kept = lines.without_lines(docs.select("doc_id", "text"), lines.keep_bitmaps(docs))
    return kept.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_lines",
        "n_dropped",
        F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"),
    )


# The contract's site rules and, for all other urls, words of unwanted sites.
SITE_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
BLOCKED_WORDS = ["casino-win", "cheap-pills", "free-bets", "casino", "pills", "bets"]


@query(
    "op2_url_filter",
    """
    WITH parted AS (
        SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest
        FROM pages),
    placed AS (
        SELECT page_id, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS raw, coalesce(rest, '') AS rest FROM parted),
    cut AS (
        SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
        FROM placed),
    ruled AS (
        SELECT *, CASE
            WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
            WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
            WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
            WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule
        FROM cut)
    SELECT page_id, host, path, rule, CASE
        WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
        WHEN rule IS NOT NULL THEN 'allow'
        WHEN regexp_matches(host || path,
            '(^|[^A-Za-z0-9])(casino-win|cheap-pills|free-bets|casino|pills|bets)($|[^A-Za-z0-9])') THEN 'block'
        ELSE 'allow' END AS verdict
    FROM ruled""",
)
def op2_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    rules = [urls.site_rule(*r) for r in SITE_RULES] + [urls.word_rule(w) for w in BLOCKED_WORDS]
    return urls.judge_urls(table(spark, sf, "pages"), rules).drop("n_tried")


@query(
    "op6_chat_rotations",
    """
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
    speakers AS (SELECT DISTINCT conv_id, role AS speaker FROM turns),
    views AS (
        SELECT t.conv_id, speaker, turn, role, text, role = speaker AS learned,
               CASE WHEN role = speaker THEN '<|assistant|>' ELSE '<|user name=' || role || '|>' END
                   || chr(10) || text || '<|end|>' || chr(10) AS segment
        FROM turns t JOIN speakers s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
    placed AS (
        SELECT *, sum(length(segment)) OVER w AS stop, row_number() OVER w AS nth FROM views
        WINDOW w AS (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, role, text
                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT conv_id, speaker, nth - 1 AS position, segment, CAST(stop - length(segment) AS BIGINT) AS start,
           CAST(stop AS BIGINT) AS "end", learned FROM placed""",
)
def op6_chat_rotations(spark: SparkSession, sf: str) -> DataFrame:
    return chat.perspectives(table(spark, sf, "conversations"))


@query("op10_quality_rules")
def op10_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    rules = decision_list.learn_from(docs, table(spark, sf, "labels"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return decision_list.judged(docs, rules).select(
        "doc_id", *[F.col("counts")[c].alias(c) for c in counts], "base_failed", "kept"
    )


@query("op4_quality_classifier")
def op4_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = neighbours.fit(docs, labels.where(~neighbours.held_out(F.col("doc_id"))))
    return neighbours.score(docs, model).select(
        "doc_id",
        neighbours.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


@query("op7_packing")
def op7_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.digest(packing.pack(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2))


@query("op8_secret_scan")
def op8_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    found = secrets.find_secrets(docs, secrets.train(docs))
    base = F.col("base")
    return found.select(
        "doc_id",
        *[secrets.count_kind(base, k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(secrets.shown(base), 256).alias("base_sha256"),
        secrets.shown(F.concat("base", "added")).alias("spans"),
    )


WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@query(
    "op9_decontamination",
    f"""
    WITH d AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD_PATTERN}') AS w
        FROM documents),
    i AS (
        SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD_PATTERN}') AS w
        FROM benchmark),
    sized AS (SELECT item_id, w, least(len(w), 13) AS n FROM i WHERE len(w) > 0),
    win AS (
        SELECT DISTINCT item_id, n, array_to_string(w[p : p + n - 1], ' ') AS words
        FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS p FROM sized)),
    place AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
    part AS (
        SELECT doc_id, p, n, array_to_string(w[p : p + n - 1], ' ') AS words
        FROM place, (SELECT DISTINCT n FROM win) WHERE p + n - 1 <= len(w)),
    hit AS (SELECT doc_id, p, n, item_id FROM part JOIN win USING (n, words)),
    covered AS (
        SELECT doc_id, count(DISTINCT pos) AS n_hit
        FROM (SELECT doc_id, unnest(range(p, p + n)) AS pos FROM (SELECT DISTINCT doc_id, p, n FROM hit)) GROUP BY doc_id),
    found AS (
        SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(items, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)""",
)
def op9_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    judged = decontamination.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return judged.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        "contaminated",
    )


@query("op3_repeated_bytes")
def op3_repeated_bytes(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    cut = repeats.without_repeats(docs, repeats.repeated_spans(docs), keep_first=False)
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), "kept_sha256")


@query("op1_ngram_join")
def op1_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf, "documents"))


@query(
    "op12_filter_audit",
    """
    WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
    copies AS (SELECT text, min(doc_id) AS first_id FROM d GROUP BY text),
    known AS (
        SELECT doc_id, max(coalesce(CAST(quality = 1 AS INT), 0)) AS good, max(coalesce(CAST(toxic = 1 AS INT), 0)) AS toxic
        FROM labels GROUP BY doc_id),
    sized AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
    judged AS (
        SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [
            len(w) < 200,
            100 * len(list_distinct(w)) < 50 * len(w),
            100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text),
            regexp_matches(text, '[#$%&*|]'),
            coalesce(doc_id > first_id, false)] AS fails
        FROM sized JOIN copies USING (text) LEFT JOIN known USING (doc_id)),
    kinds AS (SELECT part, good, toxic, fails, count(*) AS n FROM judged GROUP BY ALL),
    letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
    permuted AS (
        SELECT a.x || b.x || c.x || d.x || e.x AS o
        FROM letter a, letter b, letter c, letter d, letter e
        WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x),
    placed AS (
        SELECT *, CASE
            WHEN fails[strpos('ABCDE', substr(o, 1, 1))] THEN 1
            WHEN fails[strpos('ABCDE', substr(o, 2, 1))] THEN 2
            WHEN fails[strpos('ABCDE', substr(o, 3, 1))] THEN 3
            WHEN fails[strpos('ABCDE', substr(o, 4, 1))] THEN 4
            WHEN fails[strpos('ABCDE', substr(o, 5, 1))] THEN 5 ELSE 6 END AS gone
        FROM kinds, permuted),
    stepped AS (
        SELECT p.*, step, substr(o, step, 1) AS x, fails[strpos('ABCDE', substr(o, step, 1))] AS failed,
               len(list_filter(fails, lambda f: f)) AS n_fails
        FROM placed p, (SELECT CAST(unnest(range(1, 6)) AS INT) AS step)),
    summed AS (
        SELECT part, o AS filter_order, step, x,
            sum(CASE WHEN gone > step THEN n ELSE 0 END) AS kept,
            sum(CASE WHEN gone = step THEN n ELSE 0 END) AS removed,
            sum(CASE WHEN failed AND gone < step THEN n ELSE 0 END) AS redundant,
            sum(CASE WHEN failed AND n_fails = 1 THEN n ELSE 0 END) AS unique_fails,
            sum(CASE WHEN gone = step THEN n * good ELSE 0 END) AS good_lost,
            sum(CASE WHEN gone = step THEN n * toxic ELSE 0 END) AS toxic_lost
        FROM stepped GROUP BY ALL)
    SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
        CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
        CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
        CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
    FROM summed""",
)
def op12_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op11_token_alignment")
def op11_token_alignment(spark: SparkSession, sf: str) -> DataFrame:
    paths = [public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    groups = F.col("groups")
    aligned = alignment.align(table(spark, sf, "documents"), *paths).withColumn(
        "groups_sha256", F.when(groups == "", "").otherwise(F.sha2(groups, 256))
    )
    return alignment.with_pair_counts(aligned.drop("groups"), alignment.vocabulary_size(paths[1])).drop("row")


@query("op13_toxicity")
def op13_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model, counted = toxicity.fit(docs, labels.where(~neighbours.held_out(F.col("doc_id"))))
    return toxicity.score(counted, model).select(
        "doc_id",
        neighbours.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"),
        F.transform("evidence", lambda e: e["doc_id"]).alias("evidence"),
    )
