"""Properties of the quotas: order of the input, sizes, scarce categories, exchanges, many strata."""

import random
import time

from pyspark.sql import functions as F

from evalframe.llm.quota_sample import Target, _available, exchanged, quota_sample, quotas


def some(seed, difficulties, sources, tags, rows):
    rng = random.Random(seed)
    targets = [Target("difficulty", f"d{i}", 20, 1) for i in range(difficulties)] + [Target("source", f"s{i}", 12, 1) for i in range(sources)] + [Target("tags", f"t{i}", rng.choice([1, 2, 5, 10]), 5) for i in range(tags)]
    counts = {}
    for _ in range(rows):
        k = (rng.choice([None, *(f"d{i}" for i in range(difficulties))]), rng.choice([None, *(f"s{i}" for i in range(sources))]), sum(1 << i for i in range(tags) if rng.random() < 0.3 / (i + 1) + 0.05))
        counts[k] = counts.get(k, 0) + 1
    return counts, targets, [f"t{i}" for i in range(tags)]


def test_order_of_the_strata_is_nothing():
    counts, targets, tags = some(1, 3, 4, 5, 900)
    want = quotas(counts, targets, tags, 180)
    for seed in range(3):
        items = list(counts.items())
        random.Random(seed).shuffle(items)
        assert quotas(dict(items), targets, tags, 180) == want
    assert sum(want.values()) == 180 and all(0 <= q <= counts[k] for k, q in want.items())


def test_scarce_categories_are_whole():
    counts = {("hard", "a", 1): 3, ("hard", None, 0): 4, ("easy", "a", 1): 40, ("easy", "b", 0): 60, (None, "b", 1): 33}
    targets = [Target("difficulty", "hard", 50, 1), Target("source", "a", 20, 1), Target("tags", "t", 40, 1)]
    q = quotas(counts, targets, ["t"], 28)
    assert q["hard", "a", 1] == 3 and q["hard", None, 0] == 4 and sum(q.values()) == 28
    assert all(_available(q, t, ["t"]) >= t.need(28) for t in targets[1:])


def test_exchange_along_a_path():
    """The only row with t2 costs d, which another stratum gives back: no single exchange helps."""
    counts = {("d", None, 1): 1, (None, None, 2): 1, ("d", None, 0): 1, (None, None, 0): 1}
    targets = [Target("difficulty", "d", 50, 0), Target("tags", "t2", 50, 0)]
    q = exchanged({("d", None, 1): 1, (None, None, 2): 0, ("d", None, 0): 0, (None, None, 0): 1}, counts, targets, ["t1", "t2"], 2)
    assert q == {("d", None, 1): 1, (None, None, 2): 1, ("d", None, 0): 0, (None, None, 0): 0}
    q = exchanged({("d", None, 1): 1, (None, None, 2): 0, ("d", None, 0): 0, (None, None, 0): 0}, counts, targets, ["t1", "t2"], 1)
    assert q["d", None, 1] == 1  # nothing to give without a loss


def test_many_strata_take_seconds():
    counts, targets, tags = some(2, 4, 6, 12, 200_000)
    assert len(counts) > 15_000
    began = time.perf_counter()
    q = quotas(counts, targets, tags, 40_000)
    assert time.perf_counter() - began < 30 and sum(q.values()) == 40_000
    assert all(_available(q, t, tags) >= t.need(40_000) for t in targets)


def test_sample_does_not_depend_on_partitions(spark):
    rng = random.Random(5)
    rows = [(i if i % 9 else None, rng.choice(["Easy ", "hard", None]), rng.choice(["a", "B", None]), rng.choice([["t", "T "], ["u"], [], None, ["t", "u"]])) for i in range(1, 800)]
    df = spark.createDataFrame(rows, "oracle_id long, difficulty string, source string, tags array<string>").withColumns({"d": F.lit(1), "mask": F.lit("x"), "key": F.lit(2)})
    targets = spark.createDataFrame([("difficulty", "easy", 0.3, 1), ("source", "b", 0.4, 1), ("tags", "t", 0.5, 1), ("tags", "u", 0.99, 1), ("source", "none", 0.1, 3)], "dimension string, category string, target_share double, min_rows long")
    one = {r.id for r in quota_sample(df.repartition(1), targets)[0].collect()}
    assert one == {r.id for r in quota_sample(df.repartition(7, "source"), targets)[0].collect()} and len(one) == 159
