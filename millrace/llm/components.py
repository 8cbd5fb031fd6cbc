"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root): the smallest reachable node of every node that has an edge. ``edges`` has columns a and b.

    Each round joins every node's edges to the smaller of its neighbours, which halves the height of the trees; the rounds end when
    an exact count and hash of the edges stay the same. A node's minimum is combined before the shuffle, and the join
    back is a shuffle join that adaptive execution splits at hot nodes.
    """
    now = scratch.save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = None
    while (seen := _state(now)) != mark:
        mark = seen
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        after = scratch.save(small.select("e.u", "e.v").where("u <> v").distinct())
        scratch.free(now, shuffles=False)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
