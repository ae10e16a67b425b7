"""Registry of this subpackage's queries and what their operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import ctxrank
from ctxrank.session import broadcast_within, stage

# Functions travel to the Python workers by value.
cloudpickle.register_pickle_by_value(ctxrank)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def joinable(df: DataFrame, budget: int) -> DataFrame:
    """A staged side of a join: broadcast if its rows fit into ``budget`` bytes, else shuffled."""
    return broadcast_within(df, budget) or df


FILTER_BITS_PER_KEY = 16
# A row of a filter holds so many words of 64 bits.
FILTER_WORDS = 64


def split_by_filter(
    rows: DataFrame, keys: DataFrame, names: list[str], budget: int
) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` whose ``names`` may be among those of ``keys``, and the others, which surely are not.

    So a join with few of the rows shuffles few of them. The filter is a broadcast bitmap
    of ``FILTER_BITS_PER_KEY`` bits a key; one in sixteen others passes. Beyond ``budget``
    bytes there is no filter: all rows may be among the keys, and the second part is None.
    """
    n = keys.count()
    if n * FILTER_BITS_PER_KEY // 8 > budget:
        return rows, None
    size = 64 * FILTER_WORDS
    blocks = max(1, -(-n * FILTER_BITS_PER_KEY // size))
    block, bit = F.pmod(F.xxhash64(*names), F.lit(blocks)), F.pmod(F.xxhash64(*names, F.lit(1)), F.lit(size)).cast("int")
    taken, place, words = free_name(rows, "block"), free_name(rows, "bit"), free_name(rows, "words")
    word = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit") % 64)).alias("bits")
    bits = keys.select(block.alias(taken), bit.alias("bit")).groupBy(taken, F.floor(F.col("bit") / 64).cast("int").alias("nth"))
    held = bits.agg(word).groupBy(taken).agg(F.map_from_entries(F.collect_list(F.struct("nth", "bits"))).alias("held"))
    numbers = F.sequence(F.lit(0), F.lit(FILTER_WORDS - 1))
    filled = F.transform(numbers, lambda i: F.coalesce(F.try_element_at("held", i), F.lit(0).cast("long")))
    filter_ = F.broadcast(stage(held.select(taken, filled.alias(words))))
    marked = rows.withColumn(taken, block).withColumn(place, bit).join(filter_, taken, "left")
    at = F.col(f"`{place}`")
    may = F.coalesce(F.getbit(F.get(F.col(f"`{words}`"), F.floor(at / 64).cast("int")), at % 64) == 1, F.lit(False))
    return tuple(marked.where(c).select(*[F.col(f"`{x}`") for x in rows.columns]) for c in (may, ~may))


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores in front until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def column(df: DataFrame, name: str) -> Column:
    return df[f"`{name}`"]


def with_text(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with another text; ``n_chars``, where it is a column, follows it."""
    changed = df.withColumn("text", text)
    if "n_chars" in df.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(df.schema["n_chars"].dataType))
    return changed
