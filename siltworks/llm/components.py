"""Connected components by alternating large-star and small-star sweeps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm.common import checkpointed, release_shuffles, respread


def settled(edges: DataFrame) -> bool:
    """Whether distinct edges (a, b), a > b, are what stars() gives: every a has one edge, and to a node that is no a itself."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    left = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR up = 1 AND down = 1")
    return left.limit(1).count() == 0


def stars(edges: DataFrame) -> DataFrame:
    """(a, b): b is the smallest node of a's component, for every node a that isn't the smallest itself.

    edges: pairs (a, b) of longs in any order, repeats and loops allowed. Minima are aggregated before the shuffle and
    joined back as tables of their own, so that Spark can split a node with very many neighbours among tasks. Each sweep ends
    in a checkpoint; edges that are stars already take none, and none follows to confirm the last.
    """
    now = checkpointed(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not settled(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(respread(least, "a"), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(respread(least, "a"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        now = checkpointed(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        release_shuffles(now.sparkSession)
    return now
