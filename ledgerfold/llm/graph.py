"""Connected components by alternating stars, one stored table per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import stage


def components(edges: DataFrame) -> DataFrame:
    """`node`, `root` (smallest node reachable) for all nodes of `edges` (long columns a, b).

    Each round hangs the larger neighbours of a node, then its smaller ones, below
    the smallest of them. Every edge keeps its component, and rounds end when the
    stars no longer change. Group minima are combined before they move.
    """
    tree = edges.filter("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).distinct()
    before = None
    while True:
        both = tree.unionByName(tree.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = both.groupBy("node").agg(F.least(F.min("root"), F.col("node")).alias("top"))
        large = (  # larger neighbours of a node: the edges in which it is the root
            tree.join(least.withColumnsRenamed({"node": "root", "top": "least"}), "root")
            .select("node", F.col("least").alias("root"))
        )
        lowest = large.groupBy("node").agg(F.min("root").alias("top"))
        hung = large.join(lowest, "node")
        ends = F.array(F.struct("node", F.col("top").alias("root")), F.struct(F.col("root").alias("node"), F.col("top").alias("root")))
        tree = stage(hung.select(F.inline(ends)).filter("node <> root").distinct(), "stars")
        state = tuple(tree.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first())
        if state == before:
            return tree.unionByName(tree.select(F.col("root").alias("node"), "root").distinct())
        before = state
