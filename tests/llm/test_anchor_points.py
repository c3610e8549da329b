"""The covering code, its reach, and the recall of the pairs found by it."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalframe.llm import anchor_points as ap
from evalframe.llm.near_duplicates import expanded, near_duplicate_pairs


def test_every_word_has_one_anchor_within_the_radius():
    words = np.random.default_rng(1).integers(0, 1 << 23, 20_000)
    row, anchor = ap.code(0).anchors(words)
    assert (np.bincount(row, minlength=len(words)) == 1).all() and anchor.max() < ap.ANCHORS
    row, anchor = ap.code(1).anchors(words)
    assert 5.2 < len(row) / len(words) < 5.4


def test_words_within_the_threshold_meet():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 23, 5000)
    y = x ^ (1 << rng.integers(0, 23, 5000))
    reach = [dict() for _ in range(2)]
    for side, words in enumerate((x, y)):
        for r, a in zip(*ap.code(1).anchors(words)):
            reach[side].setdefault(int(r), set()).add(int(a))
    assert all(reach[0][i] & reach[1][i] for i in range(5000))


def test_bits_differ_as_the_sets_do():
    rng = np.random.default_rng(3)
    pool = rng.integers(-(1 << 62), 1 << 62, (400, 150))
    flat = np.concatenate([np.concatenate([p[:100], p[50:150]]) for p in pool])
    prints = ap.fingerprints(flat, np.arange(0, len(flat), 100), ap.multipliers())
    bits = ap.TABLES * ap.LENGTH
    off = np.bitwise_count(prints[::2] ^ prints[1::2]).sum(axis=1) / bits
    assert abs(off.mean() - (1 - 1 / 3) / 2) < 0.01
    far = np.bitwise_count(prints[:-2:2] ^ prints[2::2]).sum(axis=1) / bits
    assert abs(far.mean() - 0.5) < 0.01


def edited(rng, words, vocab, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = rng.choice(vocab)
    return out


@pytest.mark.parametrize("block", [65_536, 20])
def test_recall_near_the_threshold(spark, block):
    """600 pairs of edited texts against the exact similarity; with small blocks every anchor is a hot one."""
    rng = random.Random(4)
    vocab = [f"v{i}" for i in range(5000)]
    rows, want = [], set()
    grams = lambda w: {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    for i in range(600):
        a = [rng.choice(vocab) for _ in range(100)]
        b = edited(rng, a, vocab, rng.randrange(1, 12))
        rows += [(2 * i, "", " ".join(a)), (2 * i + 1, "", " ".join(b))]
        x, y = grams(a), grams(b)
        if 2 * len(x & y) >= len(x | y):
            want.add((2 * i, 2 * i + 1))
    df = spark.createDataFrame(rows, "id long, title string, body string")
    got = {tuple(r) for r in near_duplicate_pairs(df, "id", ("title", "body"), k=3, threshold=(1, 2), block=block).collect()}
    assert got <= want and len(got) >= 0.99 * len(want) and len(want) > 400


def test_expanded_in_blocks(spark):
    members = spark.createDataFrame([(i, 0, 7) for i in range(50)] + [(100 + i, 100, 8) for i in range(3)], "id long, rep long, mark long")
    links = spark.createDataFrame([(0, 7, 100, 8)], "a long, ga long, b long, gb long")
    for block in (4, 1000):
        got = [tuple(sorted(r)) for r in expanded(links, members, block).collect()]
        want = {(i, j) for i in range(50) for j in range(i + 1, 50)} | {(i, 100 + j) for i in range(50) for j in range(3)} | {(100, 101), (100, 102), (101, 102)}
        assert len(got) == len(set(got)) and set(got) == want


def test_ids_repeated_with_other_texts(spark):
    w = [" ".join(f"{c}{i}" for i in range(30)) for c in "abc"]
    df = spark.createDataFrame([(1, "", w[0]), (1, "", w[1]), (2, "", w[0]), (3, "", w[1]), (3, "", w[1]), (4, "", w[2])], "id long, title string, body string").withColumns({"mark": F.lit(0), "a": F.lit("x"), "f0": F.lit(1)})
    assert {tuple(r) for r in near_duplicate_pairs(df, "id", ("title", "body")).collect()} == {(1, 2), (1, 3)}


@pytest.mark.parametrize("entries, block", [(2_000_000, 65_536), (3000, 65_536), (777, 65_536), (3000, 3)])
def test_shards_lose_nothing(spark, monkeypatch, entries, block):
    """The same pairs whatever the number of shards and blocks."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, (60, ap.WORDS), dtype=np.uint64)
    near = base.copy()
    for row in near:
        for bit in rng.integers(0, ap.TABLES * ap.LENGTH, 20):
            row[bit >> 6] ^= np.uint64(1) << np.uint64(bit & 63)
    prints = np.concatenate([base, near]).view(np.int64)
    monkeypatch.setattr(ap, "SHARD_ENTRIES", entries)
    df = spark.createDataFrame([(i, 5, *map(int, r)) for i, r in enumerate(prints)], "id long, mark long, " + ", ".join(f"f{i} long" for i in range(ap.WORDS)))
    got = {(r.a, r.b) for r in ap.near_pairs(df, (1, 2), block=block).collect()}
    assert got == {(i, 60 + i) for i in range(60)}
    few = {(r.a, r.b) for r in ap.near_pairs(df, (1, 2), tables=3, block=block).collect()}
    assert few <= got and len(few) > 50
