"""Connected components by alternating large and small stars, without collecting any link."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titleforge.llm.common import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.where("v < u")
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")) if large else near.groupBy("u").agg(F.min("v").alias("m"))
    out = near.join(least, "u")
    if large:
        return out.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    # the node itself hangs on the least neighbour, and so do its other smaller neighbours
    return out.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node of the links (u, v); the component is its smallest node.

    Each round writes its links to the shared folder, so an executor may be lost at any time. Rounds grow
    with the logarithm of the longest path. Links of a node with itself count for nothing.
    """
    now = scratch.save(edges.select("u", "v").where("u <> v").distinct())
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(now)
    while before[0]:
        now = scratch.save(_star(_star(now, True), False))
        after = mark(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
