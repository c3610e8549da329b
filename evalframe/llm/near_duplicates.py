"""Problem 1: near-duplicate records with small edits, by anchor-point covering and an exact check.

1. Each record's shingle set gives a fingerprint and two hashes of the whole set. Records with equal sets
   form a class, represented by its smallest id; copies take no further part.
2. Fingerprints go to every anchor of a covering code within covering radius plus threshold and are
   compared per anchor (``anchor_points``).
3. The pairs found are checked exactly on the shingle sets, made again from the texts of just these records.

The fingerprints are random projections, so step 2 may miss a pair; the README gives the measured recall.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from evalframe.llm import anchor_points, shingles
from evalframe.llm.components import connected_components
from evalframe.session import checkpointed, spread

#: ids (16 bytes each) up to which the check's records are found by a broadcast instead of a shuffle of the texts
BROADCAST_IDS = 1_000_000
#: shingles that a worker turns into fingerprints at once
_CHUNK = 1 << 17
_FIELDS = [f"f{i}" for i in range(anchor_points.WORDS)]


def _mark(s: np.ndarray, seed: int) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes(), seed=seed)).astype(np.int64))


def _printed(cut: Callable, k: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, known = anchor_points.multipliers(), {}
        for batch in batches:
            ids, sets, size = [], [], 0

            def made() -> pa.RecordBatch:
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                flat = np.concatenate(sets) if sets else np.empty(0, dtype=np.int64)
                prints = anchor_points.fingerprints(flat, np.cumsum(sizes) - sizes, factors).view(np.int64) if sets else np.zeros((0, len(_FIELDS)), dtype=np.int64)
                arrays = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array([_mark(s, 0) for s in sets], pa.int64()), pa.array([_mark(s, 1) for s in sets], pa.int64())]
                return pa.RecordBatch.from_arrays([*arrays, *[pa.array(prints[:, i]) for i in range(len(_FIELDS))]], names=["id", "n", "mark", "mark2", *_FIELDS])

            for i, first, second in zip(*(c.to_pylist() for c in batch.columns)):
                tokens, n = cut(first, second)
                if n >= least and len(tokens) >= k:
                    ids.append(i)
                    sets.append(shingles.hashes(tokens, k, known, False))
                    size += len(sets[-1])
                    if size >= _CHUNK:
                        yield made()
                        ids, sets, size = [], [], 0
            yield made()
    return run


def _cut_again(cut: Callable, k: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            ids, sets = [], []
            for i, first, second in zip(*(c.to_pylist() for c in batch.columns)):
                tokens, n = cut(first, second)
                if n >= least and len(tokens) >= k:
                    ids.append(i)
                    sets.append(shingles.hashes(tokens, k, known, False))
            sizes = np.array([len(s) for s in sets], dtype=np.int32)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            values = np.concatenate(sets) if sets else np.empty(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([_mark(s, 0) for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["id", "mark", "sh"])
    return run


def _base(df: DataFrame, id_col: str, text_cols: tuple[str, str]) -> DataFrame:
    first, second = (F.col(c).cast("string") for c in text_cols)
    return df.select(F.col(id_col).cast("long").alias("id"), first.alias("first"), second.alias("second")).where("id is not null")


def checked(pairs: DataFrame, base: DataFrame, k: int, threshold: tuple[int, int], min_words: int) -> DataFrame:
    """The exact check: a, b, na, nb, common of the candidate pairs (a, ga, b, gb; checkpointed) that reach the threshold.

    The shingle sets are made from the texts of the records in pairs only. These are picked by a broadcast of
    their ids where those are few (counted first), else by an ordinary join.
    """
    num, den = threshold
    ids = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct()
    few = pairs.count() * 2 <= BROADCAST_IDS
    texts = base.join(F.broadcast(ids) if few else ids, "id", "left_semi")
    sets = texts.mapInArrow(_cut_again(shingles.words, k, min_words), "id long, mark long, sh array<long>")
    one = sets.select(F.col("id").alias("a"), F.col("mark").alias("ga"), F.col("sh").alias("sa"))
    two = sets.select(F.col("id").alias("b"), F.col("mark").alias("gb"), F.col("sh").alias("sb"))
    both = pairs.join(one, ["a", "ga"]).join(two, ["b", "gb"])
    sized = both.select("a", "ga", "b", "gb", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("common"))
    return sized.where(F.col("common") * den >= (F.col("na") + F.col("nb") - F.col("common")) * num).distinct()


def near_duplicate_links(
    df: DataFrame, id_col: str, text_cols: tuple[str, str], k: int = 5, threshold: tuple[int, int] = (4, 5), min_words: int = 20, tables: int = anchor_points.TABLES, within: int = 1, block: int = 65_536
) -> tuple[DataFrame, DataFrame]:
    """(membership: id, rep, mark; links between representatives: a, ga, b, gb, na, nb, common).

    Records with equal shingle sets form a class, named by its smallest id and the hash of the set (an id
    that is repeated with another text is in several classes). Links join different classes whose
    similarity is at least ``threshold`` (a fraction). Empty tables and tables of short or null texts give
    empty results; rows with a null id are left out.
    """
    base = _base(df, id_col, text_cols)
    prints = ", ".join(f"{f} long" for f in _FIELDS)
    marks = checkpointed(spread(base).mapInArrow(_printed(shingles.words, k, min_words), f"id long, n int, mark long, mark2 long, {prints}"))
    classes = marks.groupBy("n", "mark", "mark2").agg(F.min("id").alias("rep"), *[F.any_value(f).alias(f) for f in _FIELDS])
    classes = checkpointed(classes)
    members = marks.select("id", "n", "mark", "mark2").join(classes.drop(*_FIELDS), ["n", "mark", "mark2"]).select("id", "rep", "mark").distinct()
    pairs = checkpointed(anchor_points.near_pairs(classes.select(F.col("rep").alias("id"), "mark", *_FIELDS), threshold, tables, within, block))
    return checkpointed(members), checkpointed(checked(pairs, base, k, threshold, min_words))


def in_blocks(links: DataFrame, members: DataFrame, block: int = 1024) -> DataFrame:
    """(x, y): every pair of a member of class a and one of class b, for links (a, b); ``members``: id, c (its class).

    The members of a class are cut into blocks of about ``block`` by a hash of the id, and each pair of
    blocks is joined by itself, so a class that holds a third of all rows is no single join key.
    """
    sizes = members.groupBy("c").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("nb"))
    side = lambda p, c: sizes.select(F.col("c").alias(c), F.col("nb").alias(p))
    cells = links.select("a", "b").join(side("na", "a"), "a").join(side("nb", "b"), "b")
    cells = cells.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("na") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    placed = members.join(sizes, "c").withColumn("k", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
    left = placed.select(F.col("c").alias("a"), F.col("k").alias("i"), F.col("id").alias("x"))
    right = placed.select(F.col("c").alias("b"), F.col("k").alias("j"), F.col("id").alias("y"))
    return cells.join(left, ["a", "i"]).join(right, ["b", "j"]).select("a", "b", "x", "y")


def expanded(links: DataFrame, members: DataFrame, block: int = 1024) -> DataFrame:
    """(x, y): every pair of members of linked classes, and of members of one class."""
    named = members.select("id", F.struct("rep", "mark").alias("c"))
    own = named.groupBy("c").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("c").alias("a"), F.col("c").alias("b"))
    across = links.select(F.struct(F.col("a").alias("rep"), F.col("ga").alias("mark")).alias("a"), F.struct(F.col("b").alias("rep"), F.col("gb").alias("mark")).alias("b"))
    return in_blocks(across.unionByName(own), named, block).where((F.col("a") != F.col("b")) | (F.col("x") < F.col("y"))).select("x", "y")


def near_duplicate_pairs(df: DataFrame, id_col: str, text_cols: tuple[str, str], **kw) -> DataFrame:
    """All pairs (id_a < id_b) of near-duplicate records, copies included; an id is never paired with itself."""
    members, links = near_duplicate_links(df, id_col, text_cols, **kw)
    both = expanded(links, members)
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).where("id_a < id_b").distinct()


def near_duplicate_classes(df: DataFrame, id_col: str, text_cols: tuple[str, str], **kw) -> DataFrame:
    """id, class_id (smallest id of the transitive class), copies, links: one row for each record with enough words.

    ``copies`` counts the equal records (itself included), ``links`` the other classes it is directly
    linked to. An id that is repeated with different texts stands for all of them together.
    """
    members, links = near_duplicate_links(df, id_col, text_cols, **kw)
    members, links = members.select("id", "rep"), links.select("a", "b").where("a <> b").distinct()
    ends = links.select(F.col("a").alias("rep")).unionAll(links.select(F.col("b").alias("rep")))
    degree = ends.groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    comp = connected_components(links).select(F.col("node").alias("rep"), "component")
    copies = members.groupBy("rep").agg(F.count(F.lit(1)).alias("copies"))
    heads = copies.join(degree, "rep", "left").join(comp, "rep", "left")
    heads = heads.select("rep", F.coalesce("component", "rep").alias("class_id"), "copies", F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    return members.join(heads, "rep").select("id", "class_id", "copies", "links")
