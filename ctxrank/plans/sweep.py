"""Parameter sweep and run comparison, each as one job."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace
from functools import reduce
from itertools import product
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxrank.operators.evaluate import CUT, mean_ndcg
from ctxrank.operators.rerank import (
    FIRST_N,
    METHODS,
    QUESTION_COEF,
    SPREAD_COEF,
    TAIL_PENALTY,
    combined_score,
    question_score,
)

# The question weight the sweep uses for each encoder.
ENCODER_COEFS = {
    "bge-base-en-v1.5": 0.03,
    "contriever": 2.0,
    "text-embedding-3-large": 0.3,
    "E5-large-v2": 0.5,
    "SFR-Embedding-Mistral": 0.5,
    "nomic-embed-text-v1.5": 0.5,
}
SWEEP_FIRST_N = (30, 20, 10)

CELL_TYPES = {
    "method": "string",
    "first_n": "int",
    "question_coef": "double",
    "spread_coef": "double",
    "encoder": "string",
    "downsample": "double",
    "n": "int",
    "temperature": "double",
}


@dataclass(frozen=True)
class Cell:
    """One setting of the rerank; with an encoder it applies to that encoder's runs only.

    Share of questions drawn, completions a prompt and temperature choose among the
    statistics, where those tell them apart.
    """

    method: str = "max"
    first_n: int = FIRST_N
    question_coef: float = QUESTION_COEF
    spread_coef: float = SPREAD_COEF
    encoder: str | None = None
    downsample: float | None = None
    n: int | None = None
    temperature: float | None = None


SETTING = ("method", "first_n", "question_coef", "spread_coef")
SAMPLING = ("downsample", "n", "temperature")


def grid(
    coefs: Iterable[float],
    methods: Iterable[str] = METHODS,
    first_n: Iterable[int] = SWEEP_FIRST_N,
    spread_coefs: Iterable[float] = (SPREAD_COEF,),
) -> list[Cell]:
    """All combinations of the settings."""
    return [Cell(*values) for values in product(methods, first_n, coefs, spread_coefs)]


def encoder_grid(
    encoders: Iterable[str] = tuple(ENCODER_COEFS),
    methods: Iterable[str] = METHODS,
    first_n: Iterable[int] = SWEEP_FIRST_N,
    spread_coefs: Iterable[float] = (SPREAD_COEF,),
) -> list[Cell]:
    """All combinations of the other settings, with each encoder's own question weight."""
    return [
        Cell(method, n, ENCODER_COEFS[encoder], spread, encoder)
        for method, n, spread, encoder in product(methods, first_n, spread_coefs, encoders)
    ]


def sampling_grid(
    cells: Iterable[Cell], downsample: Iterable[float], completions: Iterable[tuple[int, float]]
) -> list[Cell]:
    """All combinations of cells, shares of drawn questions, and pairs of n and temperature."""
    return [
        replace(cell, downsample=share, n=n, temperature=temperature)
        for cell, share, (n, temperature) in product(cells, downsample, completions)
    ]


def sweep_runs(
    hits: DataFrame,
    statistics: DataFrame,
    cells: Iterable[Cell],
    cut: int = CUT,
    keys: tuple[str, ...] = (),
) -> DataFrame:
    """Scores of every cell: the similarities are computed once for all of them.

    ``statistics`` comes from ``question_statistics`` over the deepest
    ``first_n``. ``keys`` name further columns of both tables, such as model,
    indexer or encoder, that tell runs apart. Candidates below both a cell's
    ``first_n`` and the evaluation cut cannot reach the cut and are left out.
    Statistics with columns of ``SAMPLING``, as ``sampling_statistics`` gives them, are
    matched with the cells' own values of those.
    """
    sampled = [c for c in SAMPLING if c in statistics.columns]
    fields = (*SETTING, "encoder", *sampled)
    cells = list(cells)
    values = [
        F.struct(*[F.lit(getattr(c, f)).cast(CELL_TYPES[f]).alias(f) for f in fields]) for c in cells
    ]
    chosen = F.array(*values)
    if "encoder" in keys:
        own = F.col("encoder")
        chosen = F.filter(chosen, lambda c: c["encoder"].isNull() | (c["encoder"] == own))
    deepest = max([cut, *(c.first_n for c in cells)])
    first = hits.where(F.col("rank") <= deepest)
    if sampled:
        settings = {tuple(getattr(c, f) for f in sampled) for c in cells}
        each = [
            F.struct(*[F.lit(v).cast(CELL_TYPES[f]).alias(f) for f, v in zip(sampled, setting)])
            for setting in sorted(settings)
        ]
        first = first.select("*", F.inline(F.array(*each)))
        chosen = F.filter(
            chosen, lambda c: reduce(and_, [c[f].eqNullSafe(F.col(f)) for f in sampled], F.lit(True))
        )
    scored = first.join(statistics, [*keys, *sampled, "qid", "docid"], "left")
    each = scored.withColumn("_cell", F.explode(chosen))
    each = each.select("*", *[F.col(f"_cell.{f}").alias(f) for f in SETTING])
    reached = each.where(F.col("rank") <= F.greatest("first_n", F.lit(cut)))
    value = question_score(F.col("method"), F.col("spread_coef"))
    return reached.withColumn("question_score", value).select(
        *keys,
        *sampled,
        *SETTING,
        "qid",
        "docid",
        F.when(F.col("rank") <= F.col("first_n"), combined_score(F.col("question_coef")))
        .otherwise(F.col("score") - TAIL_PENALTY)
        .alias("score"),
    )


def sweep(
    hits: DataFrame,
    statistics: DataFrame,
    qrels: DataFrame,
    cells: Iterable[Cell],
    cut: int = CUT,
    keys: tuple[str, ...] = (),
) -> DataFrame:
    """Mean nDCG of every cell."""
    runs = sweep_runs(hits, statistics, cells, cut, keys)
    sampled = [c for c in SAMPLING if c in statistics.columns]
    return mean_ndcg(runs, qrels, cut, (*keys, *sampled, *SETTING))


def compare(runs: dict[str, DataFrame], qrels: DataFrame, cut: int = CUT) -> DataFrame:
    """Mean nDCG of several runs side by side, one row per ``run_id``."""
    labelled = None
    for run_id, run in runs.items():
        part = run.select(F.lit(run_id).alias("run_id"), "qid", "docid", "score")
        labelled = part if labelled is None else labelled.unionByName(part)
    return mean_ndcg(labelled, qrels, cut)
