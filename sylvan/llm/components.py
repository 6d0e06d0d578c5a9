"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's larger neighbours (or itself and its smaller ones) to the least of all it sees."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
    least = edges.groupBy("u").agg(F.min("v").alias("m"))  # edges point to the smaller node
    return edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """``node, component``, the least node, for the nodes of edges (u, v); self-loops and nulls are ignored.

    All work is in joins and aggregations with partial sums; the driver sees two numbers a round.
    """
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, before = cut(now), None
    for _ in range(most):
        now = cut(_star(_star(now, True).distinct(), False).distinct())
        sums = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sums == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = sums
    raise RuntimeError("components did not converge")
