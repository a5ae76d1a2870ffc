"""Root-to-leaf paths of message forests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import written


def leaf_paths(nodes: DataFrame, keys: list[str], rounds: int = 100_000) -> DataFrame:
    """``keys, leaf, path`` (node ids from the root) for ``keys, node, parent``; ``node`` is unique within the keys.

    A parent that isn't there makes a root. A node is a leaf if no node names it as parent; nodes of cycles without an
    exit are in no path. Pointer doubling: after k rounds each node knows 2**k ancestors, so the number of joins is
    logarithmic in the depth; a walk that meets a node again stops there."""
    known = nodes.select(*keys, F.col("node").alias("parent"), F.lit(True).alias("there"))
    tree = nodes.select(*keys, "node", "parent").join(known, [*keys, "parent"], "left")
    tree = tree.select(*keys, "node", F.when(F.col("there"), F.col("parent")).alias("parent"))
    inner = tree.where("parent IS NOT NULL").select(*keys, F.col("parent").alias("node"), F.lit(True).alias("inner")).distinct()
    # path: the node and the ancestors known so far, nearest first; up: the next ancestor.
    state = tree.join(inner, [*keys, "node"], "left").select(*keys, "node", F.col("inner").isNull().alias("leaf"), F.array("node").alias("path"), F.col("parent").alias("up"))
    state = written(state, "paths")
    for _ in range(rounds):
        if state.where("up IS NOT NULL").limit(1).count() == 0:
            break
        above = state.select(*keys, F.col("node").alias("up"), F.col("path").alias("more"), F.col("up").alias("next"))
        joined = state.join(above, [*keys, "up"], "left")
        seen = F.size(F.array_intersect("path", "more")) > 0  # the walk closes a cycle: its new part up to there, then stop
        met = F.filter("more", lambda x: ~F.array_contains("path", x))
        state = written(joined.select(
            *keys, "node", "leaf", F.when(F.col("up").isNull(), F.col("path")).when(seen, F.concat("path", met)).otherwise(F.concat("path", "more")).alias("path"),
            F.when(F.col("up").isNull() | seen, F.lit(None)).otherwise(F.col("next")).alias("up"),
        ), "paths")
    return state.where("leaf").select(*keys, F.col("node").alias("leaf"), F.reverse("path").alias("path"))
