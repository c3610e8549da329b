"""Near-duplicates, split overlap and components against brute force; edge cases of each operator."""

import random
import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from evalframe.llm import setjoin, shingles
from evalframe.llm.components import connected_components
from evalframe.llm.near_duplicates import near_duplicate_classes, near_duplicate_pairs
from evalframe.llm.split_overlap import split_overlap_links, split_overlap_pairs, split_overlap_report

WORD = re.compile(r"[^\W_]+")


def grams(words, k):
    return frozenset(zip(*(words[i:] for i in range(k))))


def brute_pairs(rows, k, num, den, least):
    sets = {}
    for i, a, b in rows:
        w = [x.lower() for t in (a, b) if t for x in WORD.findall(t)]
        if len(w) >= least and i is not None:
            sets[i] = grams(w, k)
    ids = sorted(sets)
    return {(x, y) for n, x in enumerate(ids) for y in ids[n + 1 :] if den * len(sets[x] & sets[y]) >= num * len(sets[x] | sets[y])}


def texts(seed, n):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    bases = [[rng.choice(vocab) for _ in range(rng.randrange(5, 60))] for _ in range(n // 4)]
    rows = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 5, 9])):
            p = rng.randrange(len(w))
            w[p : p + rng.randrange(2)] = [rng.choice(vocab)]
        rows.append((i, rng.choice(["", None, "A title"]), " ".join(w).upper() if i % 3 else ", ".join(w)))
    return rows


SCHEMA = "id long, title string, body string"


@pytest.mark.parametrize("threshold, k, block", [((1, 2), 3, 4096), ((4, 5), 5, 2), ((3, 5), 2, 3)])
def test_pairs_equal_brute_force(spark, threshold, k, block):
    rows = texts(k, 160) + [(900, None, None), (901, "", " "), (None, "x " * 40, None), (902, "long", "z9 y8 " * 5000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"sh": F.lit(1), "n": F.lit("x"), "rep": F.lit(0), "h": F.lit(2)})
    got = {tuple(r) for r in near_duplicate_pairs(df, "id", ("title", "body"), k=k, threshold=threshold, min_words=8, block=block).collect()}
    assert got == brute_pairs(rows, k, *threshold, 8) and got


def test_classes(spark):
    a, b, c = "one two three four five six seven", "one two three four five six eight", "nine ten eleven twelve thirteen fourteen fifteen"
    df = spark.createDataFrame([(5, "", a), (1, "", b), (2, "", a.upper()), (3, "", c), (4, "", "short")], SCHEMA)
    got = {r.id: (r.class_id, r.copies, r.links) for r in near_duplicate_classes(df, "id", ("title", "body"), k=3, threshold=(1, 2), min_words=5).collect()}
    assert got == {1: (1, 1, 1), 2: (1, 2, 1), 5: (1, 2, 1), 3: (3, 1, 0)}


def test_hot_copies_stay_one_class(spark):
    df = spark.range(3000).select("id", F.lit("").alias("title"), F.when(F.col("id") % 3 == 0, "same words in all of these many rows here").otherwise(F.concat(F.lit("row number "), *[F.concat((F.col("id") * p).cast("string"), F.lit(" ")) for p in (3, 5, 7, 11, 13)])).alias("body"))
    got = near_duplicate_classes(df, "id", ("title", "body"), k=3, threshold=(1, 2), min_words=5)
    assert got.where("copies = 1000").count() == 1000 and got.select("class_id").distinct().count() == 2001


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_duplicate_pairs(empty, "id", ("title", "body")).count() == 0
    assert near_duplicate_classes(empty, "id", ("title", "body")).count() == 0
    none = spark.createDataFrame([], "case_id long, suite string, stdin string, expected_stdout string, source string")
    assert split_overlap_pairs(none).count() == 0 and split_overlap_report(none).count() == 0


@given(st.lists(st.text(alphabet="ab1 -É", max_size=12), max_size=6), st.lists(st.text(alphabet="xyz", min_size=1, max_size=3), min_size=1, max_size=30))
@settings(max_examples=50, deadline=None)
def test_token_functions(parts, tokens):
    first, second = " ".join(parts[:3]), " ".join(parts[3:])
    assert shingles.words(first, second)[0] == [w.lower() for w in WORD.findall(first)] + [w.lower() for w in WORD.findall(second)]
    assert shingles.pieces(first, second) == (first.split() + second.split(), len(first.split()))
    assert len(shingles.hashes(tokens, 3, {}, False)) == len(shingles.hashes(tokens, 3, {}, True)) == len(grams(tokens, 3))


def test_split_overlap_brute_force(spark):
    rng = random.Random(3)
    bases = [[str(rng.randrange(10**rng.choice([1, 6]))) for _ in range(rng.randrange(10, 40))] for _ in range(25)]
    rows = []
    for i in range(240):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            w[rng.randrange(len(w))] = str(rng.randrange(9))
        rows.append((i, rng.choice(["repair", "eval", "held_out", None]), "\r\n".join(w), rng.choice(["1", None, "2 3\n"]), rng.choice(["s", None])))
    rows += [(999, "eval", None, None, None), (None, "eval", rows[0][2], "1", "s"), (998, "repair", "", "5", "s")]
    df = spark.createDataFrame(rows, "case_id long, suite string, stdin string, expected_stdout string, source string").withColumn("side", F.lit(5))
    want, sets = set(), {}
    for i, s, a, b, _ in rows:
        p = (a or "").split()
        if i is not None and s and len(p) >= 12:
            sets[i] = (s, grams(p + (b or "").split(), 3))
    for x in sets:
        for y in sets:
            if x < y and (sets[x][0] == "repair") != (sets[y][0] == "repair"):
                u, v = sets[x][1], sets[y][1]
                if 10 * len(u & v) >= 6 * len(u | v):
                    want.add((x, y))
    for block in (4096, 3):
        assert {(r.id_a, r.id_b) for r in split_overlap_pairs(df, block=block).collect()} == want and want
    report = {(r.suite, r.source): (r.rows, r.overlapping) for r in split_overlap_report(df).collect()}
    hit = {x if sets[x][0] != "repair" else y for x, y in want}
    for key, (n, over) in report.items():
        mine = [i for i, s, _, _, src in rows if (s, src) == key]
        assert (n, over) == (len(mine), sum(i in hit for i in mine))


def test_prefix_length(spark):
    for n in range(1, 60):
        for num, den in ((1, 2), (3, 5), (4, 5)):
            got = spark.range(1).select(setjoin.prefix_length(F.lit(n), (num, den)).alias("p")).first().p if n in (1, 7, 31, 59) else n - -(-n * num // den) + 1
            assert got == n - -(-n * num // den) + 1


@pytest.mark.parametrize("edges, want", [
    ([], {}), ([(1, 1)], {}), ([(i, i + 1) for i in range(40)], {i: 0 for i in range(41)}), ([(5, 9), (9, 7), (2, 3), (3, 2), (None, 4)], {5: 5, 9: 5, 7: 5, 2: 2, 3: 2}), ([(0, i) for i in range(1, 30)], {i: 0 for i in range(30)}),
])
def test_components(spark, edges, want):
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)
