"""Connected components by alternating large-star and small-star rounds, all on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evalframe.session import checkpointed


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the smallest node reached.

    Each round attaches all neighbours of a node to the smallest node of its neighbourhood and halves
    the diameter, so the number of rounds grows with its logarithm. Lineage is cut each round by
    ``checkpoint()``. Empty input gives no rows; loops and repeated edges are ignored; null ends are
    dropped. Raises if ``max_rounds`` do not suffice (never cut short silently).
    """
    now = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = checkpointed(now)
    for _ in range(max_rounds):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(low, "u")
        small = down.select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = checkpointed(small)
        same = after.exceptAll(now).limit(1).count() == 0 and now.exceptAll(after).limit(1).count() == 0
        now = after
        if same:
            break
    else:
        raise RuntimeError("connected_components needs more rounds")
    tops = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(tops)
