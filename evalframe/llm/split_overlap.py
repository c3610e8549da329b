"""Problem 6: same or near-same records across splits, by partitioned n-gram hashes of the evaluation side."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evalframe.llm import setjoin, shingles
from evalframe.llm.near_duplicates import in_blocks
from evalframe.session import checkpointed


def split_overlap_links(
    df: DataFrame, id_col: str = "case_id", suite_col: str = "suite", first_col: str = "stdin", second_col: str = "expected_stdout",
    train: str = "repair", k: int = 3, threshold: tuple[int, int] = (3, 5), min_pieces: int = 12, block: int = 4096,
) -> tuple[DataFrame, DataFrame]:
    """(membership: id, suite, rep; links: a = evaluation class, b = training class, na, nb, common).

    Equal shingle sets of one side form a class. The n-gram hashes of the evaluation classes (those in
    the prefix that any overlap must touch) are partitioned with those of the training classes; hits
    are candidates, and the exact containment common/na and Jaccard similarity follow for each.
    """
    known = df.where(F.col(suite_col).isNotNull())
    sets = shingles.shingle_sets(known, id_col, first_col, second_col, shingles.pieces, k, min_pieces, suite_col, rarest_first=True)
    sets = sets.select("id", F.col("tag").alias("suite"), (F.col("tag") == train).alias("side"), "n", "sh")
    prefix = F.slice("sh", F.lit(1), setjoin.prefix_length(F.col("n"), threshold))
    keyed = sets.select("id", "suite", "side", "n", F.xxhash64("sh").alias("g1"), F.hash("sh").alias("g2"), prefix.alias("prefix"))
    classes = keyed.groupBy("side", "n", "g1", "g2").agg(F.min("id").alias("rep"), F.any_value("prefix").alias("prefix"))
    members = keyed.drop("prefix").join(classes.drop("prefix"), ["side", "n", "g1", "g2"]).select("id", "suite", "rep", "side")
    anchored = classes.select(F.col("rep").alias("id"), "side", "n", F.posexplode("prefix").alias("pos", "h"))
    pairs = checkpointed(setjoin.candidate_pairs(anchored, threshold, block, sides=True))
    links = setjoin.verified(pairs, sets.where(~F.col("side")), sets.where("side"), threshold)
    return members, links


def split_overlap_pairs(df: DataFrame, **kw) -> DataFrame:
    """id_a < id_b, eval_id, train_id: every overlapping evaluation/training pair, copies included."""
    members, links = split_overlap_links(df, **kw)
    named = members.select("id", F.struct("side", "rep").alias("c"))
    end = lambda side, c: F.struct(F.lit(side).alias("side"), F.col(c).alias("rep"))
    met = in_blocks(links.select(end(False, "a").alias("a"), end(True, "b").alias("b")), named)
    pairs = met.select(F.col("x").alias("eval_id"), F.col("y").alias("train_id"))
    return pairs.select(F.least("eval_id", "train_id").alias("id_a"), F.greatest("eval_id", "train_id").alias("id_b"), "eval_id", "train_id").distinct()


def split_overlap_report(df: DataFrame, source_col: str = "source", **kw) -> DataFrame:
    """suite, source, rows, overlapping, contained, exact: evaluation rows per suite and source, how many overlap training.

    Of these, how many have all their runs in one training row (``contained``), and how many have just the
    runs of one (``exact``).

    All evaluation rows count, those too short to be compared too. A null source is a group of its own.
    """
    id_col, suite_col, train = kw.get("id_col", "case_id"), kw.get("suite_col", "suite"), kw.get("train", "repair")
    members, links = split_overlap_links(df, **kw)
    same = (F.col("common") == F.col("na")) & (F.col("common") == F.col("nb"))
    best = links.groupBy("a").agg(F.max(F.col("common") / F.col("na")).alias("containment"), F.bool_or(same).alias("same"))
    hit = members.where(~F.col("side")).join(best, members.rep == best.a).select(F.col("id").alias("hit_id"), "containment", "same")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(suite_col).alias("suite"), F.col(source_col).alias("source")).where(F.col("suite").isNotNull() & (F.col("suite") != train))
    joined = rows.join(hit, rows.id == hit.hit_id, "left")
    return joined.groupBy("suite", "source").agg(F.count(F.lit(1)).alias("rows"), F.count("hit_id").alias("overlapping"), F.count_if(F.col("containment") >= 1).alias("contained"), F.count_if("same").alias("exact"))
