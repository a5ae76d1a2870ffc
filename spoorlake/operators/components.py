"""Connected components by alternating large-star and small-star contraction.

Each round is two grouped minima and two joins; the number of rounds is logarithmic in the longest path. Edges are
rewritten to the shared folder every round, so the plan stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import erased, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(lowest, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    lowest = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(lowest, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.union(lowest.select("u", "m")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether all edges point to centres of stars: no node has two, and no centre points on. As b < a throughout, a
    centre is then its component's smallest node."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("points")).union(edges.select("b", F.lit(0)))
    twice = ends.groupBy("node").agg(F.sum("points").alias("n"), F.min("points").alias("least")).where("n > 1 OR (n = 1 AND least = 0)")
    return twice.isEmpty() and edges.where("a < b").isEmpty()


def connected_components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """``node, component`` (its smallest node) for every node of ``edges`` (two columns of one orderable type; rows
    with a null and loops are ignored, so a node that has only loops doesn't appear)."""
    edges = edges.toDF("a", "b").where("a <> b").distinct()
    edges = written(edges, "edges")
    for _ in range(rounds):
        if _settled(edges):
            break
        before, edges = edges, written(_small_star(_large_star(edges)), "edges")
        erased(before)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
