"""Connected components of an edge table, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.workspace import materialize


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of ``edges(a, b)``; the label is the smallest node it can reach.

    Each round links a node's larger neighbours to its smallest one, then the smaller ones. Only edge tables are
    shuffled, a hub's neighbours are a joined table that Spark can split, and every round is written to the
    shared folder, so a lost executor costs one round at most. Nodes must not be null; loops are ignored.
    """
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        if _are_stars(now):
            labels = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
            roots = now.select(F.col("v").alias("node")).distinct().withColumn("label", F.col("node"))
            return labels.unionByName(roots)


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour, and that one has none."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    ends = ends.groupBy("x").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    return ends.filter("up > 1 OR up > 0 AND down > 0").isEmpty()
