"""Secret scans in SQL functions: key patterns, and character models for the rest.

Three patterns find secrets by their form. Two Markov models of characters are
trained on labelled strings: random are strings drawn from the alphabets that keys are
written in, and what the patterns find; ordinary are the other long strings of the corpus,
all its identifiers, numbers and words. A string of key characters outside the patterns'
spans is a secret if the random model explains it better, by the logarithm of the
likelihood ratio.

Null and empty texts have no spans. Rows are scanned one by one, so repeated rows and
null ids are no special case; other columns are not read. Without ordinary strings the
models know nothing and add no spans.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the base rules.
ASSIGN = (
    r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
MIN_VALUE = 6
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SIZE = len(ALPHABET)
STRING = "[A-Za-z0-9+/_=-]"
# Alphabets of keys, and how many strings are drawn from each for the random class.
KEY_ALPHABETS = (
    "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/",
    "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-_",
    "abcdefghijklmnopqrstuvwxyz0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "0123456789abcdef",
    "0123456789ABCDEF",
)
DRAWN = 1000
DRAWN_CHARS = 40
SAMPLE_CHARS = 8
CANDIDATE_CHARS = 16
# A candidate's log-likelihood ratio, in all and per pair of characters.
MIN_RATIO = 12.0
MIN_RATE = 0.5

SPAN = "array<struct<start:int,kind:int,stop:int,value:string>>"


def spans(text: Column, pattern: str, kind: int) -> Column:
    """The pattern's leftmost matches that do not overlap, with their places in code points."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(state: Column, pair: Column) -> Column:
        first = state["at"] + F.length(pair["gap"])
        stop = first + F.length(pair["match"])
        span = F.struct(first.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"), pair["match"].alias("value"))
        return F.struct(stop.alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

    pairs = F.arrays_zip(between.alias("gap"), matches.alias("match"))
    found = F.aggregate(pairs, start, step, lambda state: state["out"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """Spans of the three base rules; an assignment's value must have ``MIN_VALUE`` characters."""
    assigned = F.filter(
        spans(text, ASSIGN, 0), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= MIN_VALUE
    )
    return F.concat(assigned, spans(text, ACCESS, 1), spans(text, HEX, 2))


def drawn_strings(spark: SparkSession) -> DataFrame:
    """(is_random, value): strings of independent characters, ``DRAWN`` of each key alphabet, by hashes."""
    alphabets = F.array(*[F.lit(a) for a in KEY_ALPHABETS])
    drawn = spark.range(DRAWN * len(KEY_ALPHABETS)).select(
        "id", F.element_at(alphabets, (F.col("id") % len(KEY_ALPHABETS) + 1).cast("int")).alias("alphabet")
    )
    place = lambda i: (F.pmod(F.xxhash64(F.col("id"), i), F.length("alphabet")) + 1).cast("int")
    characters = F.transform(
        F.sequence(F.lit(1), F.lit(DRAWN_CHARS)), lambda i: F.substring(F.col("alphabet"), place(i), F.lit(1))
    )
    return drawn.select(F.lit(True).alias("is_random"), F.array_join(characters, "").alias("value"))


def labelled_strings(docs: DataFrame) -> DataFrame:
    """(is_random, value) of every distinct long string of all documents, labelled by the base rules, and the drawn ones."""
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    any_base = "|".join([ASSIGN, ACCESS, HEX])
    secret = F.regexp_extract_all("text", F.lit(any_base), F.lit(0))
    value = F.regexp_extract(F.col("value"), r"([A-Za-z0-9+/_=-]+)[.]*$", 1)
    has_secret = F.col("text").rlike(any_base)
    random = (
        rows.where(has_secret)
        .select(F.explode(secret).alias("value"))
        .select(F.lit(True).alias("is_random"), value.alias("value"))
    )
    clean = F.when(has_secret, F.regexp_replace("text", any_base, " ")).otherwise(F.col("text"))
    ordinary = rows.select(
        F.lit(False).alias("is_random"),
        F.explode(F.regexp_extract_all(clean, F.lit(f"{STRING}{{{SAMPLE_CHARS},}}"), F.lit(0))).alias("value"),
    )
    labelled = random.where(F.length("value") >= CANDIDATE_CHARS).unionByName(ordinary)
    known = labelled.groupBy("is_random", "value").agg(F.count("*").alias("n"))
    # Names join words by a dash, an underscore or a capital, or are all capitals; so are the ordinary words here.
    head, tail = F.substring("value", 1, 4), F.col("value").substr(F.lit(5), F.length("value"))
    joined = F.array(
        "value", F.upper("value"), F.concat_ws("_", head, tail), F.concat_ws("-", head, tail), F.concat(head, F.initcap(tail))
    )
    forms = F.when(~F.col("is_random") & F.col("value").rlike("^[a-z]+$"), joined).otherwise(F.array("value"))
    written = known.select("is_random", F.explode(forms).alias("value"))
    return written.unionByName(drawn_strings(docs.sparkSession))


def train(docs: DataFrame) -> np.ndarray:
    """The log-likelihood ratio, random to ordinary, of each pair of characters (first * SIZE + second).

    Every distinct string counts once, so that copies of a document weigh nothing.
    """
    first = lambda i: F.substring("value", i, F.lit(1))
    pairs = labelled_strings(docs).select(
        "is_random",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.length("value") - 1),
                lambda i: (F.instr(F.lit(ALPHABET), first(i)) - 1) * SIZE + F.instr(F.lit(ALPHABET), first(i + 1)) - 1,
            )
        ).alias("pair"),
    )
    counted = pairs.groupBy("is_random", "pair").agg(F.count("*").alias("n")).collect()
    counts = np.zeros((2, SIZE * SIZE))
    for row in counted:
        counts[int(row["is_random"]), row["pair"]] = row["n"]
    if not counts.sum(1).all():
        return np.full(SIZE * SIZE, -1.0)
    table = counts.reshape(2, SIZE, SIZE) + 0.5
    likely = np.log(table / table.sum(2, keepdims=True))
    return (likely[1] - likely[0]).reshape(-1)


def ratio(value: Column, table: Column) -> Column:
    """The sum of a string's pair ratios."""
    code = lambda at: F.instr(F.lit(ALPHABET), F.substring(value, at, F.lit(1)))
    start = F.struct(F.lit(0.0).alias("sum"), code(F.lit(1)).alias("last"))

    def step(state: Column, i: Column) -> Column:
        now = code(i)
        pair = F.element_at(table, (state["last"] - 1) * SIZE + now)
        return F.struct((state["sum"] + pair).alias("sum"), now.alias("last"))

    return F.aggregate(F.sequence(F.lit(2), F.length(value)), start, step, lambda state: state["sum"])


def find_secrets(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """(doc_id, base, added) per row: sorted spans (start, kind, stop, value) of the rules and of the models."""
    table = F.lit(ratios)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select(
        "doc_id",
        F.array_sort(base_spans(F.col("text"))).alias("base"),
        spans(F.col("text"), f"{STRING}{{{CANDIDATE_CHARS},}}", 3).alias("candidates"),
    )
    apart = F.filter(
        "candidates",
        lambda c: ~F.exists("base", lambda b: (b["start"] < c["stop"]) & (c["start"] < b["stop"])),
    )
    scored = F.transform(
        F.col("apart"), lambda c: F.struct(c.alias("span"), ratio(c["value"], table).alias("ratio"))
    )
    limit = lambda s: F.greatest(F.lit(MIN_RATIO), MIN_RATE * (F.length(s["span"]["value"]) - 1))
    return (
        rows.select("doc_id", "base", apart.alias("apart"))
        .select("doc_id", "base", scored.alias("scored"))
        .select(
            "doc_id",
            "base",
            F.transform(F.filter("scored", lambda s: s["ratio"] >= limit(s)), lambda s: s["span"]).alias("added"),
        )
    )


def shown(found: Column) -> Column:
    """Spans as kind:start:end, by start and then kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    line = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["stop"])
    return F.concat_ws(",", F.transform(F.array_sort(found), line))


def count_kind(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == KINDS.index(kind))).cast("long")
