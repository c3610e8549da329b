"""Pairs of similar sets by anchor points: a covering code over fixed-length fingerprints.

A set becomes a fingerprint of ``tables`` words of 23 bits. Each bit is one bit of a min-wise hash, so two
sets of Jaccard similarity s differ in a bit with probability (1 - s) / 2. In every table the anchors are
the 4096 code words of the binary Golay code: its covering radius is 3 (each word of 23 bits lies within 3
of exactly one anchor). A fingerprint is replicated to every anchor within covering radius plus threshold,
3 + 1 bits, 5.3 anchors a table on average. Any two words that differ in at most ``within`` bits meet (the
home anchor of one is in reach of the other), and many that differ in more; with several tables the pairs
left over become few. Per anchor all fingerprints are compared over all their bits.

Anchors are sent around in shards, one or more for every two tables (a record goes once to each shard that holds
one of its anchors). The number of shards grows with the records, so what a task holds is bounded; an anchor with more than ``block``
records is cut into blocks, and each pair of blocks is a group of its own.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# The binary Golay code (length, message bits, generator polynomial, covering radius).
LENGTH, MESSAGE, GENERATOR, RADIUS = 23, 12, 0b101011100011, 3
#: fingerprint words of 64 bits
WORDS = 6
TABLES = WORDS * 64 // LENGTH
ANCHORS = 1 << MESSAGE
#: anchor entries that one shard may be expected to hold
SHARD_ENTRIES = 4_000_000
#: tables that share their shards
TOGETHER = 2
_CHECKS = LENGTH - MESSAGE


def syndrome(words: np.ndarray) -> np.ndarray:
    """What is left of words of 23 bits divided by the generator: 0 for the anchors."""
    left = words.astype(np.int64)
    for i in range(LENGTH - 1, _CHECKS - 1, -1):
        left ^= ((left >> i) & 1) * (GENERATOR << (i - _CHECKS))
    return left


class Code:
    """For each syndrome the error patterns of at most RADIUS + ``within`` bits, in one flat list."""

    def __init__(self, within: int) -> None:
        masks = [sum(1 << i for i in c) for r in range(RADIUS + within + 1) for c in itertools.combinations(range(LENGTH), r)]
        errors = np.array(masks, dtype=np.int64)
        of = syndrome(errors)
        order = np.argsort(of, kind="stable")
        self.errors = errors[order]
        self.first = np.searchsorted(of[order], np.arange((1 << _CHECKS) + 1)).astype(np.int64)
        half = np.arange(1 << MESSAGE, dtype=np.int64)
        self._low, self._high = syndrome(half), syndrome(half << MESSAGE & ((1 << LENGTH) - 1))

    def anchors(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, anchor number) of every anchor in reach of each word."""
        of = self._low[words & (ANCHORS - 1)] ^ self._high[words >> MESSAGE]
        count = self.first[of + 1] - self.first[of]
        row = np.repeat(np.arange(len(words)), count)
        at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.first[of], count)
        return row, (words[row] ^ self.errors[at]) >> _CHECKS


_CODES: dict[int, Code] = {}


def code(within: int) -> Code:
    """The code of a threshold, built once a process."""
    if within not in _CODES:
        _CODES[within] = Code(within)
    return _CODES[within]


def multipliers(seed: int = 20) -> np.ndarray:
    """The odd factors of the min-wise hashes, one a bit."""
    return np.random.default_rng(seed).integers(0, 1 << 63, TABLES * LENGTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def fingerprints(flat: np.ndarray, starts: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """(sets, WORDS) fingerprints of non-empty sets of 64-bit hashes, laid end to end."""
    out = np.zeros((len(starts), WORDS), dtype=np.uint64)
    hashes = flat.view(np.uint64)
    for bit, a in enumerate(factors):
        low = np.minimum.reduceat(hashes * a, starts)
        low ^= low >> np.uint64(31)
        low *= np.uint64(0x9E3779B97F4A7C15)
        out[:, bit >> 6] |= (low >> np.uint64(63)) << np.uint64(bit & 63)
    return out


def table_word(prints: np.ndarray, table: int) -> np.ndarray:
    """The 23-bit word of each fingerprint in a table."""
    at, off = divmod(table * LENGTH, 64)
    word = prints[:, at] >> np.uint64(off)
    if off + LENGTH > 64:
        word = word | prints[:, at + 1] << np.uint64(64 - off)
    return (word & np.uint64((1 << LENGTH) - 1)).astype(np.int64)


def entries(prints: np.ndarray, tables: int, within: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) of every replica; anchors of table t are numbered from t * ANCHORS."""
    rows, anchors = zip(*(code(within).anchors(table_word(prints, t)) for t in range(tables)))
    return np.concatenate(rows), np.concatenate([a + t * ANCHORS for t, a in enumerate(anchors)])


def most_bits(threshold: tuple[int, int], bits: int, sigmas: float) -> int:
    """How many of ``bits`` fingerprint bits a pair at the similarity threshold may differ in (mean plus ``sigmas`` deviations)."""
    p = (1 - threshold[0] / threshold[1]) / 2
    return math.ceil(bits * p + sigmas * math.sqrt(bits * p * (1 - p)))


def _prints(batch) -> np.ndarray:
    return np.stack([batch.column(f"f{i}").to_numpy(zero_copy_only=False) for i in range(WORDS)], axis=1).view(np.uint64) if batch.num_rows else np.zeros((0, WORDS), dtype=np.uint64)


def _block_of(ids: np.ndarray, blocks: int) -> np.ndarray:
    x = ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(33)) % np.uint64(blocks)).astype(np.int64)


def _groups(tables: int) -> int:
    return -(-tables // TOGETHER)


def _counted(tables: int, within: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(tables * ANCHORS, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(entries(_prints(batch), tables, within)[1], minlength=len(total))
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["anchor", "n"])
    return run


def _sent(tables: int, within: int, parts: int, hot: dict[int, tuple[int, int]]):
    """Rows (shard, id, fingerprint): once a shard of ordinary anchors, once a pair of blocks of a hot one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_anchors = np.array(sorted(hot), dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, shards = batch.column("id").to_numpy(), _groups(tables) * parts
            if parts == 1 and not hot:  # every record has an anchor in every table
                to = np.arange(len(ids) * shards)
            else:
                row, anchor = entries(_prints(batch), tables, within)
                cool = ~np.isin(anchor, hot_anchors)
                to = np.unique(row[cool] * shards + anchor[cool] // (ANCHORS * TOGETHER) * parts + anchor[cool] % ANCHORS % parts)
            where, group = [to // shards], [to % shards]
            for a in hot_anchors[np.isin(hot_anchors, anchor)] if hot else ():
                blocks, base = hot[int(a)]
                mine = row[anchor == a]
                k = _block_of(ids[mine], blocks)
                for j in range(blocks):
                    i, m = np.minimum(k, j), np.maximum(k, j)
                    where.append(mine)
                    group.append(base + i * blocks + m)
            where, group = np.concatenate(where), np.concatenate(group)
            for at in range(0, len(where), 100_000):
                part = pa.array(where[at : at + 100_000])
                cols = [batch.column(c).take(part) for c in ("id", "mark", *[f"f{i}" for i in range(WORDS)])]
                yield pa.RecordBatch.from_arrays([pa.array(group[at : at + 100_000].astype(np.int64)), *cols], names=["shard", "id", "mark", *[f"f{i}" for i in range(WORDS)]])
    return run


def _near(x: np.ndarray, y: np.ndarray, most: tuple[int, int], step: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of x and y whose fingerprints differ in at most ``most[1]`` bits (and, asked first, the first half in ``most[0]``)."""
    half = WORDS // 2
    for at in range(0, len(x), step):
        off = np.zeros((len(x[at : at + step]), len(y)), dtype=np.uint16)
        for w in range(half):
            off += np.bitwise_count(x[at : at + step, w, None] ^ y[None, :, w])
        i, j = np.nonzero(off <= most[0])
        full = off[i, j] + np.bitwise_count(x[i + at, half:] ^ y[j, half:]).sum(axis=1, dtype=np.uint16)
        near = full <= most[1]
        yield i[near] + at, j[near]


def _compared(tables: int, within: int, parts: int, hot: dict[int, tuple[int, int]], most: tuple[int, int]):
    """The pairs of one shard that meet at an anchor and whose fingerprints are near."""
    hot_anchors = np.array(sorted(hot), dtype=np.int64)

    def run(group: pa.Table) -> pa.Table:
        ids, marks, prints = group.column("id").to_numpy(), group.column("mark").to_numpy(), _prints(group)
        shard, lefts, rights = group.column("shard")[0].as_py(), [], []
        if shard < _groups(tables) * parts:
            first, part = divmod(shard, parts)
            for table in range(first * TOGETHER, min(tables, (first + 1) * TOGETHER)):
                row, anchor = code(within).anchors(table_word(prints, table))
                mine = (anchor % parts == part) & ~np.isin(anchor + table * ANCHORS, hot_anchors)
                row, anchor = row[mine], anchor[mine]
                order = np.argsort(anchor, kind="stable")
                row, cuts = row[order], np.flatnonzero(np.diff(anchor[order])) + 1
                for members in np.split(row, cuts):
                    if len(members) > 1:
                        for i, j in _near(prints[members], prints[members], most):
                            lefts.append(members[i[i < j]])
                            rights.append(members[j[i < j]])
        else:
            blocks, base = next((b, s) for b, s in hot.values() if s <= shard < s + b * b)
            one, two = divmod(shard - base, blocks)
            k = _block_of(ids, blocks)
            x, y = np.flatnonzero(k == one), np.flatnonzero(k == two)
            for i, j in _near(prints[x], prints[y], most):
                keep = x[i] != y[j] if one != two else x[i] < y[j]
                lefts.append(x[i[keep]])
                rights.append(y[j[keep]])
        i, j = (np.concatenate(lefts), np.concatenate(rights)) if lefts else (np.zeros(0, dtype=np.int64),) * 2
        swap = (ids[i] > ids[j]) | (ids[i] == ids[j]) & (marks[i] > marks[j])
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        if len(i):
            i, j = np.unique(np.stack([i, j]), axis=1)
        return pa.table({"a": ids[i], "ga": marks[i], "b": ids[j], "gb": marks[j]})
    return run


def near_pairs(prints: DataFrame, threshold: tuple[int, int], tables: int = TABLES, within: int = 1, block: int = 65_536) -> DataFrame:
    """Distinct (a, ga, b, gb) of records that meet at an anchor and whose fingerprints may belong to similar sets.

    ``prints``: id, mark (the two name a record; unique together), f0 .. f5. The counts of the anchors (at
    most tables * 4096 rows, whatever the data) are the only thing that reaches the driver. The pairs are
    candidates: an exact check follows elsewhere.
    """
    if not 1 <= tables <= TABLES:
        raise ValueError(f"1 to {TABLES} tables")
    most = (most_bits(threshold, WORDS // 2 * 64, 4.5), most_bits(threshold, TABLES * LENGTH, 4.0))
    counts = prints.mapInArrow(_counted(tables, within), "anchor int, n long").groupBy("anchor").agg(F.sum("n").alias("n")).collect()
    parts = max(1, -(-sum(r.n for r in counts) // (_groups(tables) * SHARD_ENTRIES)))
    hot: dict[int, tuple[int, int]] = {}
    base = _groups(tables) * parts
    for r in sorted(r for r in counts if r.n > block):
        blocks = -(-r.n // block)
        hot[r.anchor] = (blocks, base)
        base += blocks * blocks
    cols = ", ".join(f"f{i} long" for i in range(WORDS))
    sent = prints.mapInArrow(_sent(tables, within, parts, hot), f"shard long, id long, mark long, {cols}")
    found = sent.groupBy("shard").applyInArrow(_compared(tables, within, parts, hot, most), "a long, ga long, b long, gb long")
    return found.distinct()
