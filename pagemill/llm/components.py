"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, stored


def _both(e: DataFrame) -> DataFrame:
    return e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of u is tied to the smallest of u and its neighbours."""
    both = _both(e)
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    """u and its smaller neighbours are tied to the smallest of them."""
    low = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = low.groupBy("u").agg(F.min("v").alias("m"))
    tied = low.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge; edges has long columns u and v, component is the smallest node.

    Minima are pre-aggregated, and a hub's edges meet its minimum in a join that adaptive execution splits.  The rounds
    go on until nothing moves; their number is of the order of the square of the logarithm of the number of nodes.
    """
    e = stored(edges.select("u", "v").filter("u <> v").distinct(), "cc")
    mark = None
    while True:
        before, e = e, stored(_small_star(_large_star(e)).filter("u <> v").distinct(), "cc")
        discard(before)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
