"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """``a, b`` (any order, repeats allowed) to ``node, component``: the smallest node each one reaches.

    Every round sends a node's neighbours to the smallest of them, so rows never grow beyond the links and a hot node
    needs no list of its neighbours, only their minimum. Each round is written out, which cuts lineage.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = stored(both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        after = stored(small, "stars")
        # no node has two parents and no parent has one: every edge leads to a root
        done = after.agg(F.count(F.lit(1)), F.countDistinct("u")).first()
        if done[0] == done[1] and after.join(after.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            return after.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(after.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        edges = after
