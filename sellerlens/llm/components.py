"""Connected components by alternating stars, and links inside shared keys.

``components`` is the distributed union-find: edges are rewired to the
smallest neighbour until every vertex hangs on its component's smallest. All
groupings are minima, which combine before the shuffle, so a vertex with a
third of all edges is no problem; vertices never reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sellerlens.llm.work import cut, drop


def _rewire(e: DataFrame) -> DataFrame:
    """One large-star and one small-star step on edges (hi, lo), hi > lo."""
    both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
        e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = (both.join(least, "u").where("v > u")
             .select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi > lo").distinct())
    down = large.groupBy("hi").agg(F.min("lo").alias("m"))
    small = large.join(down, "hi")
    return (small.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi > lo")
            .unionByName(small.select("hi", F.col("m").alias("lo"))).distinct())


def components(edges: DataFrame, name: str = "edges") -> DataFrame:
    """(id, root) of every vertex that is not its component's smallest, from
    edges (a, b) over any ordered type. Loops and repeated edges do no harm."""
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), name)
    while not _flat(e):
        before, e = e, cut(_rewire(e), name)
        drop(before)
    return e.select(F.col("hi").alias("id"), F.col("lo").alias("root"))


def _flat(e: DataFrame) -> bool:
    """Does every vertex hang on one other at most, which hangs on none?"""
    up, down = F.lit(1).alias("up"), F.lit(0).alias("down")
    ends = e.select(F.col("hi").alias("v"), up, down).unionByName(
        e.select(F.col("lo").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return (ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
            .where("up > 1 OR (up = 1 AND down = 1)").isEmpty())
