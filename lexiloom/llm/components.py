"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import stored


def _star(pairs: DataFrame, smaller: bool) -> DataFrame:
    """One contraction of (a, b), a > b: neighbours are tied to the smallest one of each node.

    A large star ties the larger neighbours of every node, a small star the smaller ones and the node itself.
    The minimum is a partial aggregate and the join one that Spark can split, so a hub's size does not matter.
    """
    if smaller:
        around = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
    else:
        around = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            pairs.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
    least = stored(around.groupBy("u").agg(F.min("v").alias("m")), "star")
    least = least.select("u", F.least("u", "m").alias("m"))
    tied = around.join(least, "u")
    if smaller:
        out = tied.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
    else:
        out = tied.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.where("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b): the smallest node that it can reach."""
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    pairs = stored(pairs, "pairs")
    mark = None
    while True:
        pairs = stored(_star(stored(_star(pairs, False), "large-star"), True), "small-star")
        sums = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(sums) == mark or not sums[0]:
            break
        mark = tuple(sums)
    ties = pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return ties.unionByName(ties.select(F.col("component").alias("node"), "component").distinct())
