"""Connected components of an edge list, by rounds of joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxrank.session import stage


def _large_stars(edges: DataFrame) -> DataFrame:
    """Point a node's larger neighbours at the smallest of them and itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_stars(edges: DataFrame) -> DataFrame:
    """Point a node's smaller neighbours and itself at the smallest of them."""
    joined = edges.join(edges.groupBy("a").agg(F.min("b").alias("least")), "a")
    moved = F.array(*[F.struct(F.col(c).alias("a"), F.col("least").alias("b")) for c in ("a", "b")])
    return joined.select(F.inline(moved)).where("a <> b").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every ``a`` has one ``b`` and none is the ``b`` of another; stars change no more."""
    up = F.struct(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    down = F.struct(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    ends = F.array(up, down)
    nodes = edges.select(F.inline(ends)).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not nodes.where("up > 1 or up = 1 and down = 1").take(1)


def components(edges: DataFrame) -> DataFrame:
    """(a, b): every node of ``edges`` (a, b) that is not the smallest of its component, and that smallest.

    Alternates large and small stars until only stars are left; a hub of any size is
    only ever one side of a join and of a minimum. Each half is staged, so that the shuffles
    of the next one are written by a task per split of a small table, not by one per partition.
    """
    now = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while not _are_stars(now):
        now = stage(_small_stars(stage(_large_stars(now))))
    return now
