"""Registry of the workload's queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, vector: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and the SQL that gives the same rows.

    A ``vector`` column comes out as one row per dimension, so that results
    hold plain values only.
    """

    def register(run: Query) -> Query:
        QUERIES[name] = run if vector is None else lambda spark, sf: by_dimension(run(spark, sf), vector)
        if sql is not None:
            ORACLES[name] = sql if vector is None else by_dimension_sql(sql, vector)
        return run

    return register


def by_dimension(df: DataFrame, vector: str) -> DataFrame:
    others = [c for c in df.columns if c != vector]
    return df.select(*others, F.posexplode(vector).alias("dim", "value"))


def by_dimension_sql(sql: str, vector: str) -> str:
    return f"""SELECT * EXCLUDE ({vector}), unnest(range(len({vector})))::INTEGER AS dim,
        unnest({vector}) AS value FROM ({sql})"""
