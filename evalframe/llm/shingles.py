"""Shingle sets of records as sorted 64-bit hashes, computed in Arrow batches with numpy."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from evalframe.session import checkpointed, spread

_WORD = re.compile(r"[^\W_]+")
#: words kept in a worker's hash table before it starts anew
_KEPT = 1 << 18


def words(first: str | None, second: str | None) -> tuple[list[str], int]:
    """Longest runs of letters and digits, lower-cased, of the first text then the second; and how many there are."""
    found = [w.lower() for t in (first, second) if t for w in _WORD.findall(t)]
    return found, len(found)


def pieces(first: str | None, second: str | None) -> tuple[list[str], int]:
    """Blank-separated pieces of the first text then the second; and how many the first has."""
    head = first.split() if first else []
    return head + (second.split() if second else []), len(head)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes(tokens: list[str], k: int, known: dict[str, int], rarest_first: bool) -> np.ndarray:
    """Sorted distinct hashes of the k-token runs. ``rarest_first`` puts runs of long tokens first in that order."""
    if len(tokens) < k:
        return np.empty(0, dtype=np.int64)
    if len(known) > _KEPT:
        known.clear()
    codes = []
    for w in tokens:
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        codes.append(h)
    w = np.array(codes, dtype=np.uint64)
    m = len(tokens) - k + 1
    acc = np.zeros(m, dtype=np.uint64)
    for j in range(k):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + _mix(w[j : j + m] + np.uint64(2 * j + 1))
    acc = _mix(acc)
    if rarest_first:
        size = np.array([len(x) for x in tokens], dtype=np.int64)
        total = size[:m].copy()
        for j in range(1, k):
            total += size[j : j + m]
        rank = 15 - np.minimum(total // 2, 15)
        acc = (acc & np.uint64((1 << 59) - 1)) | (rank.astype(np.uint64) << np.uint64(59))
    return np.unique(acc.view(np.int64))


def _run(cut: Callable, k: int, least: int, rarest_first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            ids, tags, sets = [], [], []
            for i, tag, first, second in zip(*(c.to_pylist() for c in batch.columns)):
                tokens, n = cut(first, second)
                if n >= least and len(tokens) >= k:
                    ids.append(i)
                    tags.append(tag)
                    sets.append(hashes(tokens, k, known, rarest_first))
            sizes = np.array([len(s) for s in sets], dtype=np.int32)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            values = np.concatenate(sets) if sets else np.empty(0, dtype=np.int64)
            arrays = [pa.array(ids, pa.int64()), pa.array(tags, pa.string()), pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "tag", "n", "sh"])
    return run


def shingle_sets(df: DataFrame, id_col: str, first_col: str, second_col: str, cut: Callable, k: int, least: int, tag_col: str | None = None, rarest_first: bool = False) -> DataFrame:
    """id, tag, n, sh (sorted distinct hashes) of rows whose texts have ``least`` tokens; written once to the shared folder.

    Null texts are empty, rows with a null id or fewer than k tokens give no row.
    """
    tag = F.col(tag_col) if tag_col else F.lit(None)
    base = df.select(F.col(id_col).cast("long").alias("id"), tag.cast("string").alias("tag"), F.col(first_col).cast("string").alias("first"), F.col(second_col).cast("string").alias("second"))
    rows = spread(base.where("id is not null"))
    return checkpointed(rows.mapInArrow(_run(cut, k, least, rarest_first), "id long, tag string, n int, sh array<long>"))
