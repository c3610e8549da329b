"""Problem 4: records that differ only in formatting, by progressive partition refinement.

Level 1 groups by cheap invariants that any change of layout keeps: the number of letters and digits
and their byte histogram. Level 2 computes the full key (a 128-bit digest of the letters and digits, by
field) only for rows of classes with several members. The rows are scanned twice instead of shuffling
their texts: between the scans goes a bit map of the level-1 classes with several members. The map has
a fixed size, whatever the number of rows; a false hit only means a digest computed in vain, and level 2
groups by the true keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from evalframe.llm.answers import letters_digits, parse_answer
from evalframe.session import checkpointed, spread

#: bits of the map between the two scans (2 MB)
MAP_BITS = 1 << 24


def code_fields(text: str | None, least: int = 30) -> list[str] | None:
    """The one field of a source file; None for code with fewer than ``least`` letters and digits."""
    body = letters_digits(text) if text else ""
    return [body] if len(body) >= least else None


def answer_fields(text: str | None) -> list[str] | None:
    """The four fields of an answer, each reduced to letters and digits; None unless all are filled and the fence is closed."""
    if not text:
        return None
    a = parse_answer(text)
    if not a.closed or None in (a.explanation, a.time, a.space, a.code):
        return None
    parts = [letters_digits(x) for x in (a.explanation, a.time, a.space, a.code)]
    return parts if all(parts) else None


def _invariant(parts: list[str]) -> tuple[int, int]:
    whole = "".join(parts)
    histogram = np.bincount(np.frombuffer(whole.encode("utf-8", "surrogatepass"), dtype=np.uint8), minlength=256).astype("<i4")
    return len(whole), int(np.int64(np.uint64(xxhash.xxh64_intdigest(histogram.tobytes()))))


def _slot(n: int, hist: int) -> int:
    return (hist ^ (n * 0x9E3779B97F4A7C15)) % MAP_BITS


def _level1(fields: Callable[[str | None], list[str] | None]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = fields(text)
                if parts is not None and i is not None:
                    n, h = _invariant(parts)
                    rows.append((n, h, _slot(n, h)))
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32())], names=["n", "hist", "slot"])
    return run


def _level2(fields: Callable[[str | None], list[str] | None], bitmap: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap, dtype=np.uint8)
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = fields(text)
                if parts is None or i is None:
                    continue
                n, h = _invariant(parts)
                s = _slot(n, h)
                if bits[s >> 3] >> (s & 7) & 1:
                    digest = hashlib.md5("\x1f".join(parts).encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()
                    rows.append((i, n, h, digest))
            cols = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary())], names=["id", "n", "hist", "digest"]
            )
    return run


def _bitmap(level1: DataFrame) -> bytes:
    """One bit for each level-1 class with several members; at most MAP_BITS / 62 rows reach the driver."""
    several = level1.groupBy("n", "hist", "slot").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    words = several.select(F.floor(F.col("slot") / 62).alias("word"), F.expr("shiftleft(1L, cast(slot % 62 as int))").alias("mask"))
    rows = words.groupBy("word").agg(F.bit_or("mask").alias("mask")).collect()
    bits = np.zeros(MAP_BITS // 8, dtype=np.uint8)
    for word, mask in rows:
        while mask:
            low = mask & -mask
            s = int(word) * 62 + low.bit_length() - 1
            bits[s >> 3] |= 1 << (s & 7)
            mask ^= low
    return bits.tobytes()


def format_classes(df: DataFrame, id_col: str, text_col: str, fields: Callable[[str | None], list[str] | None] = code_fields) -> DataFrame:
    """id, kept_id, copies: each row that has a formatting copy, the smallest id of its class, the class size.

    Rows whose ``fields`` are None (null, blank, too short, incomplete) and null ids are left out; so are
    rows without a copy. A class of any size is handled by partial aggregation and a join on its key.
    """
    rows = spread(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")))
    bitmap = _bitmap(rows.mapInArrow(_level1(fields), "n int, hist long, slot int"))
    keyed = checkpointed(rows.mapInArrow(_level2(fields, bitmap), "id long, n int, hist long, digest binary"))
    kept = keyed.groupBy("n", "hist", "digest").agg(F.min("id").alias("kept_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return keyed.join(kept, ["n", "hist", "digest"]).select("id", "kept_id", "copies")
