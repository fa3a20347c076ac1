"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustweave.llm.shared import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, component`` (the smallest node reachable) of every node of ``links`` ``a, b``.

    Each round moves every node to the smallest neighbour it knows; the number
    of rounds grows with the logarithm of the longest path.  Minima are
    pre-aggregated, so a node with many links is no burden, and joins on such a
    node are split by adaptive execution.
    """
    edges = scratch.keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: larger neighbours go to the smallest one
        large = scratch.keep(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        # small star: a node and its smaller neighbours go to the smallest one
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        after = scratch.keep(small.where("u <> v").distinct())
        state = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.free(edges, large)
        edges = after
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                edges.select(F.col("v"), F.col("v"))).distinct()
        before = state
