"""Connected components by alternating stars, as DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duebook.llm.common import Scratch


def _starred(edges: DataFrame, large: bool) -> DataFrame:
    """Each node links its larger neighbours (large) or its smaller ones and itself to the
    smallest node it knows. The smallest is found by an aggregation that combines before the
    shuffle; it goes back to the edges by a join that Spark splits where a node is hot."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    if large:
        moved = both.where("b > a").join(least, "a").select(F.col("b").alias("x"), F.col("m").alias("y"))
    else:
        lower = both.where("b < a").join(least, "a").select(F.col("b").alias("x"), F.col("m").alias("y"))
        own = least.select(F.col("a").alias("x"), F.col("m").alias("y"))
        moved = lower.unionByName(own)
    return (moved.where("x <> y")
            .select(F.greatest("x", "y").alias("b"), F.least("x", "y").alias("a")).distinct()
            .select("a", "b"))


def components(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """node, component (the smallest node that links reach) for links of columns a and b.

    Nodes without a link have no row. Rounds go on until the edges are stars, none of whose centres
    is the end of another; their number grows with the logarithm of the longest chain. The result reads a
    table of `scratch`.
    """
    scratch = scratch or Scratch(links.sparkSession)
    edges = scratch.stored(links.where("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while True:
        # Every end has one centre, and no centre is an end.
        ends = edges.groupBy(F.col("b").alias("node")).agg(F.count(F.lit(1)).alias("n"))
        centres = edges.select(F.col("a").alias("node")).distinct().withColumn("centre", F.lit(True))
        if ends.join(centres, "node", "left").where("n > 1 or centre").isEmpty():
            break
        old, edges = edges, scratch.stored(_starred(_starred(edges, large=True), large=False), "edges")
        scratch.drop(old)
    stars = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    centres = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return stars.unionByName(centres)
