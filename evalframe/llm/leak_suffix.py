"""Problem 8: evaluation passages inside corpus documents, by suffix arrays of the corpus shards.

A shard is a run of documents of one partition. Its texts become sequences of unit numbers, its suffixes
are sorted by their first units, as many as the least length (an array of bounded order: that is as far as a
search must tell suffixes apart), and every suffix of every evaluation item is looked up by binary search.
What is found is extended, all hits at once, to the longest verbatim match. A unit that no item holds cannot
be part of a match, so suffixes that meet one before the least length are left out of the array; this loses
nothing and leaves few. The items are sent to the workers in groups of bounded size, one group a pass.

For ``en`` items a unit is a longest run of letters and digits; for ``zh`` items it is one Chinese
character or a longest run of other letters and digits; both lower-cased.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evalframe.session import spread

#: Unit pattern and least number of units by language.
UNITS = {"en": (re.compile(r"[^\W_]+"), 12), "zh": (re.compile(r"[一-鿿]|[^\W_一-鿿]+"), 25)}


class ItemIndex:
    """The evaluation items of one language: their units as numbers (1, 2, ...) and all their suffixes."""

    def __init__(self, items: list[tuple[int, str]], unit: re.Pattern, least: int) -> None:
        self.unit, self.least = unit, least
        self.number: dict[str, int] = {}
        cut = [(i, [w.lower() for w in unit.findall(t)]) for i, t in items]
        self.items = [(i, np.array([self.number.setdefault(w, len(self.number) + 1) for w in ws], dtype=np.int32)) for i, ws in cut if len(ws) >= least]
        used = {w for i, ws in cut if len(ws) >= least for w in ws}
        self.number = {w: n for w, n in self.number.items() if w in used}
        self.needs_han = bool(self.items) and all(_HAN.search("".join(ws[j : j + least])) for _, ws in cut for j in range(len(ws) - least + 1))
        starts = [(i, s, j) for i, s in self.items for j in range(len(s) - least + 1)]
        self.owner = np.array([i for i, _, _ in starts], dtype=np.int64)
        self.offset = np.array([j for _, _, j in starts], dtype=np.int32)
        self.queries = np.array([s[j : j + least] for _, s, j in starts], dtype=">u4").reshape(-1, least) if starts else np.empty((0, least), dtype=">u4")
        at = np.cumsum([0, *[len(s) + 1 for _, s in self.items]])
        self.units = np.concatenate([np.append(s, 0) for _, s in self.items]) if self.items else np.zeros(0, dtype=np.int32)
        self.begins = np.array([at[n] for n, (_, s) in enumerate(self.items) for _ in range(len(s) - least + 1)], dtype=np.int64)


_HAN = re.compile(r"[一-鿿]")


def _as_keys(a: np.ndarray) -> np.ndarray:
    """Rows of big-endian numbers as byte strings, which sort like the rows (no number is 0)."""
    return np.ascontiguousarray(a).view(f"S{a.shape[1] * 4}").reshape(-1)


def shard_matches(index: ItemIndex, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
    """(text index, item, position in the text, position in the item, length) of maximal matches, in units."""
    least, number = index.least, index.number
    if not len(index.queries):
        return []
    pieces, starts, at = [], [], 0
    for text in texts:
        get = number.get
        pieces.append(np.array([get(w.lower(), 0) for w in index.unit.findall(text)] if text and not (index.needs_han and not _HAN.search(text)) else [], dtype=np.int32))
        starts.append(at)
        at += len(pieces[-1]) + 1
    seq = np.zeros(at + least, dtype=np.int32)
    for s, p in zip(starts, pieces):
        seq[s : s + len(p)] = p
    holes = np.concatenate([[0], np.cumsum(seq == 0)])
    live = np.flatnonzero(holes[least : len(seq)] - holes[: len(seq) - least] == 0)
    if not len(live):
        return []
    keys = _as_keys(np.lib.stride_tricks.sliding_window_view(seq, least)[live].astype(">u4"))
    order = np.argsort(keys, kind="stable")
    array, sorted_keys = live[order], keys[order]
    wanted = _as_keys(index.queries)
    low, high = np.searchsorted(sorted_keys, wanted, "left"), np.searchsorted(sorted_keys, wanted, "right")
    first = np.array(starts, dtype=np.int64)
    queries = np.flatnonzero(high > low)
    count = high[queries] - low[queries]
    q = np.repeat(queries, count)
    pos = array[np.arange(len(q)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low[queries], count)]
    unit = index.begins[q] + index.offset[q]  # where the suffix stands among the units of all items
    inner = (index.offset[q] > 0) & (pos > 0)
    inner[inner] = seq[pos[inner] - 1] == index.units[unit[inner] - 1]
    q, pos, unit = q[~inner], pos[~inner], unit[~inner]  # the others are parts of matches that begin earlier
    length = np.full(len(q), least, dtype=np.int64)
    going = np.arange(len(q))
    seq = np.concatenate([seq, [0]])
    while len(going):
        here = index.units[unit[going] + length[going]]  # 0 after the last unit of an item
        going = going[(here != 0) & (seq[np.minimum(pos[going] + length[going], len(seq) - 1)] == here)]
        length[going] += 1
    t = np.searchsorted(first, pos, "right") - 1
    return list(zip(t.tolist(), index.owner[q].tolist(), (pos - first[t]).tolist(), index.offset[q].tolist(), length.tolist()))


def leaked_passages(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", lang_col: str = "lang", item_text_col: str = "text", shard_chars: int = 4_000_000, group_chars: int = 50_000_000
) -> DataFrame:
    """(doc_id, item_id, lang, doc_unit, item_unit, units): every maximal verbatim match of at least the least length.

    Items shorter than the least length, null texts and languages without a unit definition give nothing.
    The size of the items is asked first: they are cut into groups of about ``group_chars`` characters by a
    hash of their id, each group is broadcast to a pass over the documents, and the passes are united.
    """
    known = items.select(F.col(item_col).cast("long").alias("item"), F.lower(F.col(lang_col)).alias("lang"), F.col(item_text_col).cast("string").alias("text")).where("text is not null and item is not null")
    known = known.where(F.col("lang").isin(*UNITS))
    groups = -(-(known.agg(F.sum(F.length("text"))).first()[0] or 1) // group_chars)
    found = [_group_passages(docs, known.where(F.pmod(F.xxhash64("item"), F.lit(groups)) == g), id_col, text_col, shard_chars) for g in range(groups)]
    return reduce(DataFrame.unionByName, found)


def _group_passages(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, shard_chars: int) -> DataFrame:
    """The passages of one bounded group of items (item, lang, text)."""
    rows = items.collect()
    indexes = [(lang, ItemIndex([(i, t) for i, l, t in rows if l == lang], *UNITS[lang])) for lang in UNITS]
    shared = docs.sparkSession.sparkContext.broadcast(indexes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shard(ids: list, texts: list[str]) -> pa.RecordBatch:
            found = [(ids[t], item, lang, a, b, n) for lang, index in shared.value for t, item, a, b, n in shard_matches(index, texts)]
            cols = list(zip(*found)) or [()] * 6
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "item_id", "lang", "doc_unit", "item_unit", "units"])

        ids, texts, size = [], [], 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text and i is not None:
                    ids.append(i)
                    texts.append(text)
                    size += len(text)
                    if size >= shard_chars:
                        yield shard(ids, texts)
                        ids, texts, size = [], [], 0
        if ids:
            yield shard(ids, texts)

    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return spread(base).mapInArrow(run, "doc_id long, item_id long, lang string, doc_unit long, item_unit long, units long")


def leaked_pairs(docs: DataFrame, items: DataFrame, **kw) -> DataFrame:
    """Distinct (doc_id, item_id)."""
    return leaked_passages(docs, items, **kw).select("doc_id", "item_id").distinct()


def leaked_items(docs: DataFrame, items: DataFrame, **kw) -> DataFrame:
    """(item_id, documents, longest): how many documents hold a passage of the item, and the longest in units."""
    return leaked_passages(docs, items, **kw).groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.max("units").alias("longest"))


def without_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **kw) -> DataFrame:
    """The documents that hold no passage of an item; rows with a null id stay."""
    bad = leaked_passages(docs, items, id_col=id_col, **kw).select(F.col("doc_id").alias("_leaked")).distinct()
    return docs.join(bad, docs[id_col] == bad["_leaked"], "left_anti")
