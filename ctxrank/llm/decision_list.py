"""Quality rules: a decision list learned by sequential covering.

Rules are conjunctions of thresholds on text statistics. Each is grown on two
thirds of the labelled rows, condition by condition with the best information gain,
cut back on the other third, and kept while its precision there is high enough; the
rows it covers are taken out before the next one. The list becomes one ordered
Spark expression ``CASE WHEN rule THEN reject ... ELSE keep``.

Without labelled rows, or without rows of both classes, the list is empty and keeps
everything. Null texts count as empty. Rows with null or repeated ids are judged one
by one; labels that are null are not learned from, and an id with several labels
counts with each. Extra columns are not read, and pass through ``keep_good``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxrank.llm.statistics import COUNTS, text_counts
from ctxrank.llm.tables import free_name

# The learner's sample: at most so many labelled documents, those with the smallest hashes.
SAMPLE_ROWS = 20_000
MIN_PRECISION = 0.95
MAX_RULES = 16
MAX_CONDITIONS = 4
CUTS = 64

# Statistics a condition can be about, from the counts of a text.
RATIOS = {
    "words": ("n_words", None),
    "word_length": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "marks_per_word": ("n_marks", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeated_share": ("n_repeat_words", "n_words"),
    "distinct_share": ("n_distinct_words", "n_words"),
    "same_as_last_share": ("n_same_as_last", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
}


def ratio(name: str, row: str) -> Column:
    """One of ``RATIOS`` from the struct column ``row``; 0 where its divisor is 0."""
    top, bottom = RATIOS[name]
    above = F.col(row)[top].cast("double")
    if bottom is None:
        return above
    return F.when(F.col(row)[bottom] > 0, above / F.col(row)[bottom]).otherwise(0.0)


@dataclass(frozen=True)
class Condition:
    statistic: str
    at_least: bool
    threshold: float

    def holds(self, values: np.ndarray) -> np.ndarray:
        column = values[:, list(RATIOS).index(self.statistic)]
        return column >= self.threshold if self.at_least else column <= self.threshold

    def expression(self, row: str) -> Column:
        value = ratio(self.statistic, row)
        return value >= self.threshold if self.at_least else value <= self.threshold


def _covered(rule: list[Condition], values: np.ndarray) -> np.ndarray:
    covered = np.ones(len(values), bool)
    for condition in rule:
        covered &= condition.holds(values)
    return covered


def _grow(values: np.ndarray, bad: np.ndarray) -> list[Condition]:
    """Add the condition with the best gain until the rule covers no good row."""
    rule: list[Condition] = []
    covered = np.ones(len(values), bool)
    while len(rule) < MAX_CONDITIONS and (~bad & covered).any():
        p0, n0 = int((bad & covered).sum()), int((~bad & covered).sum())
        best = (1e-9, None)
        for name, column in zip(RATIOS, values[covered].T):
            hits = bad[covered]
            cuts = np.unique(np.quantile(column[hits], np.linspace(0, 1, CUTS)))
            for at_least in (True, False):
                for cut in cuts:
                    chosen = column >= cut if at_least else column <= cut
                    p, n = int((hits & chosen).sum()), int((~hits & chosen).sum())
                    if p == 0 or p + n == p0 + n0:
                        continue
                    gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                    if gain > best[0]:
                        best = (gain, Condition(name, at_least, float(cut)))
        if best[1] is None:
            break
        rule.append(best[1])
        covered &= best[1].holds(values)
    return rule


def _prune(rule: list[Condition], values: np.ndarray, bad: np.ndarray) -> list[Condition]:
    """The shortest prefix of the rule with the best balance of bad over good rows."""

    def worth(length: int) -> float:
        covered = _covered(rule[:length], values)
        p, n = int((bad & covered).sum()), int((~bad & covered).sum())
        return (p - n) / (p + n) if p + n else -1.0

    return rule[: max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))] if rule else rule


def learn(values: np.ndarray, bad: np.ndarray, min_precision: float = MIN_PRECISION) -> list[list[Condition]]:
    """An ordered list of rules for bad rows; ``values`` has the ``RATIOS`` as columns."""
    third = np.arange(len(values)) % 3 == 2
    grow, prune = (values[~third], bad[~third]), (values[third], bad[third])
    rules: list[list[Condition]] = []
    while len(rules) < MAX_RULES and grow[1].any():
        rule = _prune(_grow(*grow), *prune)
        if not rule:
            break
        covered = _covered(rule, prune[0])
        hit, miss = int((covered & prune[1]).sum()), int((covered & ~prune[1]).sum())
        if hit < 3 or hit / (hit + miss) < min_precision:
            break
        rules.append(rule)
        grow = tuple(a[~_covered(rule, grow[0])] for a in grow)
        prune = tuple(a[~_covered(rule, prune[0])] for a in prune)
    return rules


def kept_by(rules: list[list[Condition]], row: str) -> Column:
    """The ordered conditional expression of the rules: false from the first that holds, else true."""
    verdict = F.lit(True)
    for rule in reversed(rules):
        holds = rule[0].expression(row)
        for condition in rule[1:]:
            holds = holds & condition.expression(row)
        verdict = F.when(holds, F.lit(False)).otherwise(verdict)
    return verdict


def base_failed(row: str) -> Column:
    """Fewer than 50 words, or more than half of them in repeated 3-word windows."""
    n = F.col(row)["n_words"]
    return (n < 50) | (100 * F.col(row)["n_repeat_words"] > 50 * n)


def learn_from(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[list[Condition]]:
    """The decision list for ``labels.quality`` = 0, from a bounded sample of labelled documents."""
    known = (
        labels.where("doc_id is not null and quality is not null")
        .select("doc_id", "quality")
        .distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality")
        .limit(sample_rows)
    )
    chosen = docs.select("doc_id", "text").join(F.broadcast(known.select("doc_id").distinct()), "doc_id", "left_semi")
    rows = text_counts(chosen).join(F.broadcast(known), "doc_id")
    rows = rows.select(
        "quality", F.xxhash64("doc_id").alias("at"), F.struct(*COUNTS).alias("counts")
    ).select("quality", "at", *[ratio(name, "counts").alias(name) for name in RATIOS])
    # Copies of an id could exceed the sample's bound.
    sample = rows.orderBy("at", "quality", *RATIOS).limit(sample_rows).toPandas()
    return learn(sample[list(RATIOS)].to_numpy(float), sample["quality"].to_numpy() == 0)


def judged(docs: DataFrame, rules: list[list[Condition]], keep: str = "doc_id") -> DataFrame:
    """``keep``, the counts as a struct, base_failed and kept of every row."""
    counted = text_counts(docs, keep)
    counts = free_name(counted, "counts")
    rows = counted.select(keep, F.struct(*COUNTS).alias(counts))
    return rows.select(
        keep,
        F.col(counts).alias("counts"),
        base_failed(counts).alias("base_failed"),
        (~base_failed(counts) & kept_by(rules, counts)).alias("kept"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that neither the base rules nor the learned ones reject."""
    rules = learn_from(docs, labels)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), F.col("text"))
    return judged(whole, rules, "whole").where("kept").select("whole.*")
