"""Problem 2: a sample that matches target category proportions, by controlled rounding with max-flow.

1. One pass counts the strata (difficulty, source, set of targeted tags); their number is bounded by the
   targets, (D + 1) * (S + 1) * 2^T, not by the data.
2. Raking fits fractional quotas to the three sets of margins, never above what a stratum holds.
3. Two controlled roundings by max-flow with lower bounds make them whole: first the two-way table
   difficulty x source, then the two-way table (its cells) x tag sets. Each cell and each margin gets the
   floor or the ceiling of its fractional value, so both margins are preserved.
4. Where rounding left a target short, rows are exchanged between strata along augmenting paths, so that
   no other target that is short or just met loses by it.
5. Each stratum takes exactly its quota: the rows with the smallest random keys (a hash of seed and id).
   The key at which a quota is reached is found from a histogram of the keys, so only the rows of one
   histogram bar a stratum are ranked.
"""

from __future__ import annotations

import math
from collections import defaultdict, deque
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

#: most tags with a target: the strata are bounded by 2 to this power
MAX_TAGS = 12
KEY_BARS = 4096


def norm(c: Column) -> Column:
    """Letter case and blanks at the ends are ignored."""
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


@dataclass(frozen=True)
class Target:
    dimension: str
    category: str
    hundredths: int
    min_rows: int
    #: the category as the target table writes it
    label: str = ""

    def need(self, size: int) -> int:
        return max(-(-self.hundredths * size // 100), self.min_rows)


def read_targets(targets: DataFrame) -> list[Target]:
    """The target table (fixed and small); rows with a null field are left out, shares are whole hundredths."""
    rows = targets.select("dimension", norm(F.col("category")).alias("category"), F.round(F.col("target_share") * 100).cast("long").alias("hundredths"), F.coalesce("min_rows", F.lit(0)).cast("long").alias("min_rows"), F.col("category").alias("label"))
    return sorted({Target(*r) for r in rows.where("dimension is not null and category is not null and hundredths is not null").collect()}, key=lambda t: (t.dimension, t.category))


class _Flow:
    """Dinic's max-flow on a small graph."""

    def __init__(self, n: int) -> None:
        self.to: list[int] = []
        self.cap: list[int] = []
        self.out: list[list[int]] = [[] for _ in range(n)]

    def add(self, u: int, v: int, cap: int) -> int:
        k = len(self.to)
        self.to += [v, u]
        self.cap += [cap, 0]
        self.out[u].append(k)
        self.out[v].append(k + 1)
        return k

    def run(self, s: int, t: int) -> int:
        total = 0
        while True:
            level = [-1] * len(self.out)
            level[s], queue = 0, deque([s])
            while queue:
                u = queue.popleft()
                for k in self.out[u]:
                    if self.cap[k] and level[self.to[k]] < 0:
                        level[self.to[k]] = level[u] + 1
                        queue.append(self.to[k])
            if level[t] < 0:
                return total
            at = [0] * len(self.out)
            while True:
                path, u = [], s
                while u != t:
                    while at[u] < len(self.out[u]):
                        k = self.out[u][at[u]]
                        if self.cap[k] and level[self.to[k]] == level[u] + 1:
                            break
                        at[u] += 1
                    else:
                        if not path:
                            break
                        k = path.pop()
                        u = self.to[k ^ 1]
                        at[u] += 1
                        continue
                    path.append(k)
                    u = self.to[k]
                if not path:
                    break
                push = min(self.cap[k] for k in path)
                for k in path:
                    self.cap[k] -= push
                    self.cap[k ^ 1] += push
                total += push


def controlled_rounding(table: dict[tuple, float], caps: dict[tuple, int], row_totals: dict | None = None, total: int | None = None) -> dict[tuple, int]:
    """Whole quotas for a fractional two-way table {(row, column): x}.

    Every cell becomes the floor or ceiling of x (at most its cap), and so does every row and column
    total (rows take ``row_totals`` exactly where given, as far as the caps allow). Feasible by the
    integrality of flows; where rounding errors leave it infeasible, columns and then cells are loosened.
    ``total``, if given, is the sum of all cells.
    """
    eps = 1e-6
    rows, cols = sorted({r for r, _ in table}, key=str), sorted({c for _, c in table}, key=str)
    sums_r, sums_c = defaultdict(float), defaultdict(float)
    for (r, c), x in table.items():
        sums_r[r] += x
        sums_c[c] += x
    for slack in range(3):
        source, sink, s2, t2 = 0, 1, 2, 3
        ids = {("r", r): 4 + i for i, r in enumerate(rows)} | {("c", c): 4 + len(rows) + i for i, c in enumerate(cols)}
        g = _Flow(4 + len(rows) + len(cols))
        need = defaultdict(int)
        arcs = {}

        def bounded(u: int, v: int, low: int, high: int) -> int:
            need[v] += low
            need[u] -= low
            return g.add(u, v, max(0, high - low))

        for r in rows:
            x = sums_r[r]
            low, high = (row_totals[r], row_totals[r]) if row_totals is not None and slack == 0 else (math.floor(x + eps), math.ceil(x - eps))
            if row_totals is not None and slack:
                low, high = 0, row_totals[r]
            bounded(source, ids["r", r], low, high)
        for c in cols:
            x = sums_c[c]
            bounded(ids["c", c], sink, 0 if slack else math.floor(x + eps), 1 << 60 if slack > 1 else math.ceil(x - eps) + slack)
        lows = {}
        for (r, c), x in table.items():
            low, high = min(math.floor(x + eps), caps[r, c]), min(math.ceil(x - eps), caps[r, c])
            if slack > 1:
                low, high = 0, caps[r, c]
            lows[r, c] = low
            arcs[r, c] = bounded(ids["r", r], ids["c", c], low, high)
        if total is None or slack > 1:
            g.add(sink, source, 1 << 60)
        else:
            bounded(sink, source, total, total)
        for v, x in need.items():
            if x > 0:
                g.add(s2, v, x)
            elif x < 0:
                g.add(v, t2, -x)
        full = g.run(s2, t2) == sum(x for x in need.values() if x > 0)
        if full:
            if slack:
                g.run(source, sink)
            return {k: lows[k] + g.cap[a ^ 1] for k, a in arcs.items()}
    return {k: min(caps[k], math.floor(x + eps)) for k, x in table.items()}


def _wants(members: dict, counts: dict[tuple, int], want: dict, size: int) -> list[tuple[list[tuple], float]]:
    """(strata, rows to take) for each category of one dimension, together ``size``.

    A category asks for its need, or all it has; what is left goes to the rows without a target, then
    to all categories in proportion to what they still hold.
    """
    have = {c: sum(counts[k] for k in m) for c, m in members.items()}
    take = {c: float(min(have[c], want.get(c, 0))) for c in members}
    over = sum(take.values())
    if over > size:
        take = {c: v * size / over for c, v in take.items()}
    left = max(0.0, size - sum(take.values()))
    extra = min(left, have.get(None, 0) - take.get(None, 0.0))
    if extra > 0:
        take[None] += extra
        left -= extra
    room = {c: have[c] - take[c] for c in members}
    if left > 1e-9 and sum(room.values()):
        take = {c: take[c] + left * room[c] / sum(room.values()) for c in members}
    return [(members[c], take[c]) for c in members]


def rake(counts: dict[tuple, int], size: int, targets: list[Target], tags: list[str], rounds: int = 4000) -> tuple[dict[tuple, float], set[tuple]]:
    """(fractional quotas for the strata (difficulty, source, tag mask), strata taken whole): fitted to the needs, capped by the counts.

    A category that has no more rows than it needs is taken whole (unless such categories together
    exceed the sample), and the rest is fitted around it.
    """
    total = sum(counts.values())
    x = {k: n * size / total for k, n in counts.items()} if total else {}
    groups = []
    for i, tag in enumerate(tags):
        members = {True: [k for k in counts if k[2] >> i & 1], None: [k for k in counts if not k[2] >> i & 1]}
        groups.append(_wants(members, counts, {True: next(t.need(size) for t in targets if t.dimension == "tags" and t.category == tag)}, size))
    for pos, dim in ((1, "source"), (0, "difficulty")):
        want = {t.category: t.need(size) for t in targets if t.dimension == dim}
        if want:
            members = defaultdict(list)
            for k in counts:
                members[k[pos] if k[pos] in want else None].append(k)
            groups.append(_wants(members, counts, want, size))
    keys = list(counts)
    at = {k: i for i, k in enumerate(keys)}
    v, most = np.array([x[k] for k in keys]), np.array([float(counts[k]) for k in keys])
    scarce = np.zeros(len(keys), dtype=bool)
    for g in groups:
        for m, want in g:
            if m and want >= sum(counts[k] for k in m):
                scarce[[at[k] for k in m]] = True
    if most[scarce].sum() > size:
        scarce[:] = False
    v[scarce] = most[scarce]
    parts = []
    for g in groups:
        for m, want in g:
            ix = np.array([at[k] for k in m], dtype=int)
            parts.append((ix[~scarce[ix]], max(0.0, want - most[ix[scarce[ix]]].sum())))
    for _ in range(rounds):
        moved = 0.0
        for ix, want in parts:
            mine, cap = v[ix], most[ix]
            moved = max(moved, abs(mine.sum() - want))
            for _ in range(4):
                now = mine.sum()
                if now > want:
                    mine = mine * (want / now)
                    break
                free = mine < cap
                room = mine[free].sum()
                if now >= want or not room:
                    break
                mine = np.where(free, np.minimum(cap, mine * ((want - now + room) / room)), mine)
            v[ix] = mine
        if moved < 1e-4:
            break
    return dict(zip(keys, v.tolist())), {k for k, whole in zip(keys, scarce) if whole}


def strata(df: DataFrame, targets: list[Target], id_col: str, difficulty_col: str, source_col: str, tags_col: str) -> tuple[DataFrame, list[str]]:
    """id, d, s, mask for every row with an id; categories without a target are null, null tags are no tags."""
    known = {dim: [t.category for t in targets if t.dimension == dim] for dim in ("difficulty", "source", "tags")}
    tags = known["tags"]
    if len(tags) > MAX_TAGS:
        raise ValueError(f"at most {MAX_TAGS} tags may have a target")
    one = lambda c, dim: F.when(norm(F.col(c)).isin(known[dim]), norm(F.col(c))) if known[dim] else F.lit(None).cast("string")
    mine = F.transform(F.coalesce(F.col(tags_col), F.array().cast("array<string>")), lambda t: norm(t))
    mask = F.lit(0)
    for i, tag in enumerate(tags):
        mask = mask + F.when(F.array_contains("mine", tag), F.lit(1 << i)).otherwise(F.lit(0))
    base = df.select(F.col(id_col).cast("long").alias("id"), one(difficulty_col, "difficulty").alias("d"), one(source_col, "source").alias("s"), mine.alias("mine"))
    return base.select("id", "d", "s", mask.cast("int").alias("mask")), tags


def _by_stratum(st: DataFrame) -> dict[tuple, int]:
    return {(r.d, r.s, r.mask): r.n for r in st.groupBy("d", "s", "mask").agg(F.count(F.lit(1)).alias("n")).collect()}


def _counts(st: DataFrame) -> dict[tuple, int]:
    return _by_stratum(st)


def target_report(df: DataFrame, targets: DataFrame, id_col: str = "oracle_id", difficulty_col: str = "difficulty", source_col: str = "source", tags_col: str = "tags", part: int = 5) -> DataFrame:
    """dimension, category, need, available, met: what each target asks for and whether the data can meet it.

    The sample size is floor(rows / part), need = max(ceil(share * size), min_rows), all in whole
    numbers. An empty table meets only targets that need nothing.
    """
    spark = df.sparkSession
    wanted = read_targets(targets)
    st, tags = strata(df, wanted, id_col, difficulty_col, source_col, tags_col)
    counts = _counts(st)
    size = sum(counts.values()) // part
    rows = [(t.dimension, t.label, t.need(size), _available(counts, t, tags)) for t in wanted]
    out = spark.createDataFrame(rows, "dimension string, category string, need long, available long")
    return out.withColumn("met", F.col("available") >= F.col("need"))


def _available(counts: dict[tuple, int], t: Target, tags: list[str]) -> int:
    if t.dimension == "tags":
        i = tags.index(t.category)
        return sum(n for k, n in counts.items() if k[2] >> i & 1)
    pos = {"difficulty": 0, "source": 1}.get(t.dimension)
    return sum(n for k, n in counts.items() if pos is not None and k[pos] == t.category)


def _in_order(counts: dict[tuple, int]) -> dict[tuple, int]:
    """The strata in one fixed order, whatever order they were counted in."""
    return dict(sorted(counts.items(), key=lambda kv: tuple((x is None, str(x)) for x in kv[0])))


def quotas(counts: dict[tuple, int], wanted: list[Target], tags: list[str], size: int) -> dict[tuple, int]:
    """Whole quotas of the strata: raking, the two controlled roundings, exchanges. They sum to ``size`` (at most all rows).

    Strata of categories that have no more rows than they need are taken whole before the rounding.
    """
    counts = _in_order(counts)
    size = min(size, sum(counts.values()))
    x, scarce = rake(counts, size, wanted, tags)
    whole = {k: counts[k] for k in counts if k in scarce}
    left = size - sum(whole.values())
    rest = {k: v for k, v in x.items() if k not in scarce}
    total = sum(rest.values())
    rest = {k: min(float(counts[k]), v * left / total) if total else 0.0 for k, v in rest.items()}
    cells, caps = defaultdict(float), defaultdict(int)
    for (d, s, m), v in rest.items():
        cells[d, s] += v
        caps[d, s] += counts[d, s, m]
    first = controlled_rounding(dict(cells), dict(caps), total=left)
    table, most = {}, {}
    for (d, s, m), v in rest.items():
        table[(d, s), m] = min(v * (first[d, s] / cells[d, s] if cells[d, s] else 0.0), float(counts[d, s, m]))
        most[(d, s), m] = counts[d, s, m]
    second = controlled_rounding(table, most, {r: n for r, n in first.items()})
    quota = _filled(whole | {(d, s, m): q for ((d, s), m), q in second.items()}, counts, size)
    return exchanged(quota, counts, wanted, tags, size)


def _filled(quota: dict[tuple, int], counts: dict[tuple, int], size: int) -> dict[tuple, int]:
    """The quotas brought to the size where rounding could not keep it: single rows to or from the strata with most room."""
    off = size - sum(quota.values())
    while off:
        room = {k: counts[k] - quota[k] if off > 0 else quota[k] for k in counts}
        for k in sorted(counts, key=lambda k: -room[k])[: abs(off)]:
            if room[k] > 0:
                quota[k] += 1 if off > 0 else -1
                off -= 1 if off > 0 else -1
    return quota


def exchanged(quota: dict[tuple, int], counts: dict[tuple, int], wanted: list[Target], tags: list[str], size: int) -> dict[tuple, int]:
    """Exchanges of rows between strata for targets that rounding left short, along augmenting paths.

    One exchange gives rows of a stratum for rows of another. A path begins at a short target; each of its
    exchanges gains one target and may cost one other that is just met, which the next exchange gains back;
    the last one costs none. Paths are sought breadth first over the targets, so the size of the sample stays,
    no target gets worse, and the search ends when no short target can be helped.
    """
    keys = list(counts)
    q, cap = np.array([quota.get(k, 0) for k in keys], dtype=np.int64), np.array([counts[k] for k in keys], dtype=np.int64)
    known = [t for t in wanted if t.dimension in ("difficulty", "source", "tags")]
    has = lambda k, t: bool(k[2] >> tags.index(t.category) & 1) if t.dimension == "tags" else k[0 if t.dimension == "difficulty" else 1] == t.category
    bits = np.zeros(len(keys), dtype=np.int64)
    for i, t in enumerate(known):
        bits |= np.array([has(k, t) for k in keys], dtype=np.int64) << i
    held = lambda v: np.array([int(v[bits >> i & 1 == 1].sum()) for i in range(len(known))], dtype=np.int64)
    need = np.minimum([t.need(size) for t in known], held(cap)) if known else np.zeros(0, dtype=np.int64)
    stuck: set[int] = set()
    while True:
        over = held(q) - need
        short = [i for i in np.flatnonzero(over < 0) if i not in stuck]
        if not short:
            return dict(zip(keys, q.tolist()))
        path = _path(short[0], q, cap, bits, int(sum(1 << i for i in np.flatnonzero(over <= 0))), len(known))
        moved = q.copy()
        for give, take in path or ():
            moved[give] -= 1
            moved[take] += 1
        after = held(moved) - need
        if not path or (moved < 0).any() or (moved > cap).any() or np.minimum(after, 0).sum() <= np.minimum(over, 0).sum():
            stuck.add(short[0])
            continue
        times = _repeats(path, q, cap, after - over, over, short[0])
        for give, take in path:
            q[give] -= times
            q[take] += times
        stuck.clear()


def _repeats(path: list[tuple[int, int]], q: np.ndarray, cap: np.ndarray, change: np.ndarray, over: np.ndarray, short: int) -> int:
    """How often a path can be walked at once before a stratum is used up, its target is met or another falls short."""
    given, taken = defaultdict(int), defaultdict(int)
    for give, take in path:
        given[give] += 1
        taken[take] += 1
    bounds = [int(q[g]) // n for g, n in given.items()] + [int(cap[t] - q[t]) // n for t, n in taken.items()]
    bounds.append(-(int(over[short]) // int(change[short])))
    bounds += [int(over[i]) // int(-change[i]) for i in np.flatnonzero((change < 0) & (over > 0))]
    return max(1, min(bounds))


def _path(start: int, q: np.ndarray, cap: np.ndarray, bits: np.ndarray, tight: int, targets: int) -> list[tuple[int, int]] | None:
    """The exchanges (give, take) of a shortest augmenting path from a short target."""
    came: dict[int, tuple[int, int, int] | None] = {start: None}
    queue = deque([start])
    while queue:
        i = queue.popleft()
        for lost, give, take in _exchanges(i, q, cap, bits, tight):
            if lost is None:
                path = [(give, take)]
                while came[i] is not None:
                    i, g, t = came[i]
                    path.append((g, t))
                return path
            if lost not in came:
                came[lost] = (i, give, take)
                queue.append(lost)
    return None


def _exchanges(i: int, q: np.ndarray, cap: np.ndarray, bits: np.ndarray, tight: int) -> list[tuple[int | None, int, int]]:
    """One exchange that gains target i for each single tight target it may cost; (None, ..) first if one costs none.

    Strata alike in the tight targets are alike here, so only one of each kind is looked at.
    """
    gives, takes = np.flatnonzero((q > 0) & (bits >> i & 1 == 0)), np.flatnonzero((q < cap) & (bits >> i & 1 == 1))
    u, first_u = np.unique(bits[gives] & tight, return_index=True)
    v, first_v = np.unique(bits[takes] & tight, return_index=True)
    found: dict[int | None, tuple[int, int]] = {}
    for at in range(0, len(u), 512):
        lost = u[at : at + 512, None] & ~v[None, :]
        single = np.argwhere(lost & (lost - 1) == 0)
        kinds, firsts = np.unique(lost[single[:, 0], single[:, 1]], return_index=True)
        for kind, f in zip(kinds.tolist(), firsts):
            a, b = single[f]
            found.setdefault(kind.bit_length() - 1 if kind else None, (int(gives[first_u[at + a]]), int(takes[first_v[b]])))
        if None in found:
            return [(None, *found[None])]
    return [(lost, g, t) for lost, (g, t) in found.items()]


def quota_sample(
    df: DataFrame, targets: DataFrame, id_col: str = "oracle_id", difficulty_col: str = "difficulty", source_col: str = "source", tags_col: str = "tags", part: int = 5, seed: int = 17, counted: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(sample: id, difficulty, source, tag_mask; report: dimension, category, need, available, sampled, met).

    Ties of random keys are broken by id, rows that repeat an id are drawn separately by chance of the
    same key. Rows with a null id count towards the sizes but are never drawn, and quotas leave them out.
    The sample depends on the rows alone, not on their order or partitions.
    The report is of the quotas; if ``counted``, the sample is drawn at once and the report is of its rows.
    """
    spark = df.sparkSession
    wanted = read_targets(targets)
    st, tags = strata(df, wanted, id_col, difficulty_col, source_col, tags_col)
    counts = _counts(st)
    size = sum(counts.values()) // part
    unnamed = _by_stratum(st.where("id is null")) if any(f.name == id_col and f.nullable for f in df.schema) else {}
    quota = quotas({k: n - unnamed.get(k, 0) for k, n in counts.items()}, wanted, tags, size)
    named = spark.createDataFrame([(d, s, m, q) for (d, s, m), q in quota.items() if q], "d string, s string, mask int, quota long")
    bar = F.shiftrightunsigned("key", 64 - 12).cast("int")
    keyed = st.where("id is not null").withColumn("key", F.xxhash64(F.lit(seed), "id")).withColumn("bar", bar).withColumn("low", F.col("key").bitwiseAND(F.lit((1 << 52) - 1)))
    bars = keyed.groupBy("d", "s", "mask", "bar").agg(F.count(F.lit(1)).alias("n"))
    upto = bars.withColumn("before", F.sum("n").over(Window.partitionBy("d", "s", "mask").orderBy("bar")) - F.col("n"))
    named = named.toDF("qd", "qs", "qmask", "quota")
    cut = upto.join(named, F.col("d").eqNullSafe(F.col("qd")) & F.col("s").eqNullSafe(F.col("qs")) & (F.col("mask") == F.col("qmask"))).where("before < quota")
    cut = cut.select("qd", "qs", "qmask", F.col("bar").alias("qbar"), (F.col("quota") - F.col("before")).alias("left"), "n")
    rows = keyed.join(cut, F.col("d").eqNullSafe(F.col("qd")) & F.col("s").eqNullSafe(F.col("qs")) & (F.col("mask") == F.col("qmask")) & (F.col("bar") == F.col("qbar")))
    rows = rows.select("id", "d", "s", "mask", "bar", "low", "left", "n")
    whole = rows.where(F.col("n") <= F.col("left"))
    last = rows.where(F.col("n") > F.col("left")).withColumn("rank", F.row_number().over(Window.partitionBy("d", "s", "mask", "bar").orderBy("low", "id"))).where(F.col("rank") <= F.col("left")).drop("rank")
    sample = whole.unionByName(last).select("id", F.col("d").alias("difficulty"), F.col("s").alias("source"), F.col("mask").alias("tag_mask"))
    taken = _counts(sample.toDF("id", "d", "s", "mask")) if counted else quota
    drawn = [(t.dimension, t.label, t.need(size), _available(counts, t, tags), _available(taken, t, tags)) for t in wanted]
    report = spark.createDataFrame(drawn, "dimension string, category string, need long, available long, sampled long").withColumn("met", F.col("sampled") >= F.col("need"))
    return sample, report
