"""Connected components of an edge table by alternating large-star and small-star steps.

All steps are joins and aggregates over written tables; nothing of the graph reaches the driver
but the number of edges that a round has changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame, folder: str, name: str = "cc") -> DataFrame:
    """edges: a, b (long). Returns node, root (the smallest node reachable) of every node with an edge."""
    pairs = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs, turn = written(pairs, folder, f"{name}-0"), 0
    while True:
        turn += 1
        # Large star: each node sends its larger neighbours to the least node it sees.
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").where("b <> m").select(F.col("m").alias("a"), "b").distinct()
        # Small star: each node sends its smaller neighbours, and itself, to the least of them.
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), "b"), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("e"))
        after = written(small.select("e.a", "e.b").where("a <> b").distinct(), folder, f"{name}-{turn}")
        changed = after.join(pairs, ["a", "b"], "left_anti").head(1) or pairs.join(after, ["a", "b"], "left_anti").head(1)
        pairs = after
        if not changed:
            break
    roots = pairs.select("a").distinct().select(F.col("a").alias("node"), F.col("a").alias("root"))
    return written(roots.union(pairs.select(F.col("b").alias("node"), F.col("a").alias("root"))), folder, f"{name}-roots")
