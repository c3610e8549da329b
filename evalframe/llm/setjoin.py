"""Exact set-similarity join by anchor points, shared by the near-duplicate and split-overlap operators.

The space is that of shingle sets. Anchors are the code words of weight one (single shingles): a set
S lies within distance |S| - 1 of exactly those anchors that are its own shingles, and every non-empty
set has one, so the code covers the space. Two sets with Jaccard similarity >= t share at least
ceil(t * |S|) shingles, hence, in ANY fixed order of all shingles, one of the first
``|S| - ceil(t * |S|) + 1`` of each. Replicating a set to these anchors only (radius plus threshold)
therefore loses no pair. Sets meet, and are compared, per anchor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def meeting_anchors(anchored: DataFrame, block: int, sides: bool) -> DataFrame:
    """The rows whose anchor is a meeting place, with ``nb``: the blocks its list is cut into (1 for nearly all).

    An anchor of a single set (with ``sides``: of a single side) makes no pair; its rows end here. The
    counts are aggregated before the shuffle.
    """
    if sides:
        counts = anchored.groupBy("h").agg(F.count_if("side").alias("c1"), F.count_if(~F.col("side")).alias("c0")).where("c1 > 0 and c0 > 0")
        most = F.greatest("c0", "c1")
    else:
        counts = anchored.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        most = F.col("c")
    return anchored.join(counts.select("h", F.ceil(most / block).cast("int").alias("nb")), "h")


def candidate_pairs(anchored: DataFrame, threshold: tuple[int, int], block: int = 4096, sides: bool = False) -> DataFrame:
    """Distinct pairs (a, b) of ids that meet at an anchor, a < b, and may still reach the threshold there.

    ``anchored``: h (anchor), id, n (set size), pos (the anchor's rank in the set, from 0, in the common
    order) and, when ``sides``, a boolean ``side``: then only pairs of different sides meet, as a = the
    false side and b = the true side. At the first anchor that two sets share, nothing before it is common,
    so their overlap is at most what is left from there on; pairs for which that is too little at every
    anchor are no candidates. An anchor with more than ``block`` sets is cut into blocks, and each pair of
    blocks is a join key of its own, so no task gets an unbounded list.
    """
    num, den = threshold
    rows = meeting_anchors(anchored, block, sides)
    rows = rows.withColumn("k", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
    every = F.sequence(F.lit(0), F.col("nb") - 1)
    one, two = (rows.where(~F.col("side")), rows.where(F.col("side"))) if sides else (rows, rows)
    left = one.select("h", F.col("id").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("k").alias("i"), F.explode(every).alias("j"))
    right = two.select("h", F.col("id").alias("b"), F.col("n").alias("nb_"), F.col("pos").alias("pb"), F.explode(every).alias("i"), F.col("k").alias("j"))
    ordered: Column = F.lit(True) if sides else F.col("a") < F.col("b")
    need = F.ceil((F.col("na") + F.col("nb_")) * num / (num + den) - 1e-9)
    enough = (F.col("na") - F.col("pa") >= need) & (F.col("nb_") - F.col("pb") >= need)
    return left.join(right, ["h", "i", "j"]).where(ordered & enough).select("a", "b").distinct()


#: candidate pairs up to which the sets they need are picked by a broadcast of the ids (8 bytes each)
BROADCAST_PAIRS = 2_000_000


def verified(pairs: DataFrame, left: DataFrame, right: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The exact check of candidate pairs: a, b, na, nb, common. ``left``/``right``: id, n, sh.

    Only sets of records in a pair are sent around: where the pairs are few (counted first; they should be
    checkpointed) their ids are broadcast and sets of other records end in the scan.
    """
    num, den = threshold
    if pairs.count() <= BROADCAST_PAIRS:
        needed = lambda c: F.broadcast(pairs.select(F.col(c).alias("id")).distinct())
        left, right = left.join(needed("a"), "id", "left_semi"), right.join(needed("b"), "id", "left_semi")
    one = left.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sh").alias("sa"))
    two = right.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sh").alias("sb"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).alias("common"))
    return both.where(F.col("common") * den >= (F.col("na") + F.col("nb") - F.col("common")) * num)


def prefix_length(n: Column, threshold: tuple[int, int]) -> Column:
    """|S| - ceil(t * |S|) + 1 in whole numbers."""
    num, den = threshold
    return (n - F.floor((n * num + (den - 1)) / den) + 1).cast("int")
