"""Connected components of an edge table by alternating large-star and small-star steps (joins and groupings only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges (a, b) -> (node, component): component is the smallest node reachable; a row for each node with an edge.

    Each round links every node to the smallest in its neighbourhood, first for larger neighbours, then for
    smaller ones, until nothing changes: O(log n) rounds on chains, with one row for each edge at most.
    """
    links = written(
        edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    for _ in range(most_rounds):
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written, so that a node with very many neighbours only meets its minimum in a join, which Spark can split.
        low = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low")), "star-minima")
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).filter("u != v").distinct()
        large = written(large, "large-stars")
        down = written(large.groupBy("u").agg(F.min("v").alias("low")), "star-minima")
        small = large.join(down, "u").select(F.explode(F.array(F.struct("u", F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v")))).alias("x")).select("x.*").filter("u != v").distinct()
        following = written(small, "links")
        if following.count() == links.count() and following.join(links, ["u", "v"], "left_anti").isEmpty():
            break
        links = following
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    stars = links.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return stars.union(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
