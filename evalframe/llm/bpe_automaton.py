"""Problem 7: encoding a corpus with a byte-level BPE vocabulary through a tokenization automaton.

``MergeAutomaton`` stands for the automaton that one gadget a merge, in rank order, would build: the gadget of
u, v -> t deletes the arc v from the state reached by u, adds the arc t wherever u was allowed, and lets the
state after t start as the state after v was at that moment. A path of the finished automaton is exactly a BPE
encoding. Written out it would have an arc for nearly every pair of labels (some 10^9 for 50,000 labels), so
it is not: construction records the gadgets, and whether an arc (state after a, label b) stands is worked out
from them when it is first asked for (no gadget took away a pair on the right edge of a and the left edge of b
while both were alive) and then kept.

``Transducer`` determinises the automaton over characters: a state is the last settled label and the bytes
that later characters may still regroup; reading a character settles the labels on which all live
continuations agree and emits them. Its tables are filled as characters are seen, so encoding is a table
look-up a character. Decoding emits the bytes of the arc labels.
"""

from __future__ import annotations

import gc
import json
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from evalframe.session import spread

#: Fixed value: the published pattern that splits a text before byte-level merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: The same cuts for the faster standard module, where it agrees on what letters, digits and blanks are.
_PLAIN = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")


def _uncommon() -> str:
    """A class of the characters on which the two modules may differ: other numbers, unassigned, some controls, all beyond the first plane."""
    ranges: list[list[int]] = []
    for c in range(0x10000):
        if 0x1C <= c <= 0x1F or unicodedata.category(chr(c)) in ("No", "Nl", "Cn"):
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    return "[" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in ranges) + "\\U00010000-\\U0010ffff]"


def splitter(pattern: str = PATTERN):
    """A function that cuts a text into words by the pattern."""
    exact = regex.compile(pattern).findall
    if pattern != PATTERN:
        return exact
    plain, uncommon = _PLAIN.findall, re.compile(_uncommon()).search
    return lambda text: plain(text) if not uncommon(text) else exact(text)


#: words and table entries that a worker keeps before it starts anew
KEPT_WORDS = 1 << 17
KEPT_ARCS = 1 << 19


def byte_symbols() -> dict[str, int]:
    """The printable symbols that byte-level vocabularies use for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str) -> tuple[list[bytes], list[tuple[int, int]]]:
    """(bytes of each id, merges as pairs of ids in rank order) of a byte-level BPE file in JSON."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    of = byte_symbols()
    labels = [b""] * (max(model["vocab"].values()) + 1)
    for symbol, i in model["vocab"].items():
        labels[i] = bytes(of[c] for c in symbol) if all(c in of for c in symbol) else b""
    pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
    return labels, [(model["vocab"][a], model["vocab"][b]) for a, b in pairs]


class MergeAutomaton:
    """States are the start and, for each label, the state after it."""

    def __init__(self, labels: list[bytes], merges: list[tuple[int, int]]) -> None:
        self.labels = labels
        self.id_of = {b: i for i, b in enumerate(labels) if b}
        n = len(labels)
        self.rank = [-1] * n
        self.halves: list[tuple[int, int] | None] = [None] * n
        self.deleted: dict[tuple[int, int], int] = {}
        produced = set()
        for k, (u, v) in enumerate(merges):
            self._gadget(k, u, v)
            produced.add(self.id_of[labels[u] + labels[v]])
        reachable = produced | {i for i, b in enumerate(labels) if len(b) == 1}
        self.id_of = {b: i for b, i in self.id_of.items() if i in reachable}
        self.proper_prefixes = {b[:j] for b in self.id_of for j in range(1, len(b))}
        self.longest = max(map(len, self.id_of))
        self._right: dict[int, list[tuple[int, int]]] = {}
        self._left: dict[int, list[tuple[int, int]]] = {}
        self.arcs: dict[tuple[int, int], bool] = {}

    def _gadget(self, k: int, u: int, v: int) -> None:
        t = self.id_of[self.labels[u] + self.labels[v]]
        self.deleted.setdefault((u, v), k)
        if self.halves[t] is None:
            self.rank[t], self.halves[t] = k, (u, v)

    def _edge(self, t: int, side: int) -> list[tuple[int, int]]:
        """(label, rank at which it is absorbed) along one edge of the gadgets that built t."""
        known = self._right if side else self._left
        if t not in known:
            spine, end = [], 1 << 60
            x: int | None = t
            while x is not None:
                spine.append((x, end))
                end = self.rank[x]
                x = self.halves[x][side] if self.halves[x] else None
            known[t] = spine
        return known[t]

    def arc(self, a: int | None, b: int) -> bool:
        """Whether label b may follow label a (None: the start)."""
        if a is None:
            return True
        known = self.arcs.get((a, b))
        if known is None:
            if len(self.arcs) > KEPT_ARCS:
                self.arcs.clear()
            known = True
            for x, x_end in self._edge(a, 1):
                for y, y_end in self._edge(b, 0):
                    k = self.deleted.get((x, y))
                    # of equal ranks the one further left is applied first
                    if k is not None and k < x_end and k <= y_end:
                        known = False
                        break
                if not known:
                    break
            self.arcs[a, b] = known
        return known


class Transducer:
    """The automaton determinised over characters, its tables filled on demand."""

    def __init__(self, automaton: MergeAutomaton) -> None:
        self.automaton = automaton
        self.reset()

    def reset(self) -> None:
        self._made: dict[tuple[int | None, bytes], dict] = {}
        self._size = 0
        self.words: dict[str, tuple[int, ...]] = {}
        self.start = self._state(None, b"")

    def _state(self, last: int | None, pending: bytes) -> dict:
        key = (last, pending)
        state = self._made.get(key)
        if state is None:
            state = self._made[key] = {"": key}
        return state

    def _chain(self, last: int | None, data: bytes) -> list[tuple[int, int | None] | None]:
        """For each prefix of data: (where its last label begins, that label).

        None for a prefix whose last label begins before data: no continuation cuts there.
        """
        auto, back = self.automaton, [(0, last)]
        for end in range(1, len(data) + 1):
            for begin in range(max(0, end - auto.longest), end):
                t = auto.id_of.get(data[begin:end])
                if t is not None and back[begin] is not None and auto.arc(back[begin][1], t):
                    back.append((begin, t))
                    break
            else:
                back.append(None)
        return back

    @staticmethod
    def _path(back: list[tuple[int, int | None]], end: int) -> list[tuple[int, int]]:
        path = []
        while end:
            begin, t = back[end]
            path.append((end, t))
            end = begin
        return path[::-1]

    def step(self, state: dict, ch: str) -> tuple[dict, tuple[int, ...]]:
        """Fill and return the table entry for a character: the next state and the labels it emits."""
        last, pending = state[""]
        data = pending + ch.encode("utf-8")
        back = self._chain(last, data)
        whole = self._path(back, len(data))
        settled = len(whole)
        for k in range(len(data)):
            if data[k:] in self.automaton.proper_prefixes:
                other = self._path(back, k)
                same = 0
                while same < min(len(other), settled) and other[same] == whole[same]:
                    same += 1
                settled = min(settled, same)
                if not settled:
                    break
        emitted = tuple(t for _, t in whole[:settled])
        at = whole[settled - 1][0] if settled else 0
        entry = (self._state(emitted[-1] if emitted else last, data[at:]), emitted)
        state[ch] = entry
        self._size += 1
        return entry

    def word(self, word: str) -> tuple[int, ...]:
        """The labels of one pre-split word."""
        out: list[int] = []
        state = self.start
        for ch in word:
            entry = state.get(ch) or self.step(state, ch)
            state = entry[0]
            if entry[1]:
                out += entry[1]
        end = state.get("end")
        if end is None:
            last, pending = state[""]
            end = state["end"] = tuple(t for _, t in self._path(self._chain(last, pending), len(pending)))
        return (*out, *end)

    def encode(self, text: str, split) -> list[int]:
        if self._size > KEPT_ARCS:
            self.reset()
        known, out = self.words, []
        for w in split(text):
            ids = known.get(w)
            if ids is None:
                ids = self.word(w)
                if len(w) <= 64:
                    if len(known) >= KEPT_WORDS:
                        known.clear()
                    known[w] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.automaton.labels[i] for i in ids]).decode("utf-8", "replace")


_READY: dict[tuple, tuple] = {}


def _ready(key: tuple, vocabulary) -> tuple:
    """One (transducer, splitter) a worker process, kept for its later tasks."""
    if key not in _READY:
        _READY.clear()
        _READY[key] = (Transducer(MergeAutomaton(*vocabulary.value)), splitter(key[-1]))
        gc.freeze()
    return _READY[key]


def _shared(df: DataFrame, path: str, pattern: str):
    return (path, os.path.getsize(path), pattern), df.sparkSession.sparkContext.broadcast(read_vocabulary(path))


def token_ids(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", pattern: str = PATTERN, slice_rows: int = 512) -> DataFrame:
    """(id column, ids): the label ids of every text, without special tokens.

    Null and empty texts both give an empty list; strings that look like special tokens are plain text.
    Rows with a null id keep it. The vocabulary (fixed by its file, under 2 MB here) is broadcast.
    """
    key, shared = _shared(df, vocabulary_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, split = _ready(key, shared)
        for batch in batches:
            for at in range(0, batch.num_rows, slice_rows):
                part = batch.slice(at, slice_rows)
                flat, ends = [], [0]
                for text in part.column(1).to_pylist():
                    if text:
                        flat += machine.encode(text, split)
                    ends.append(len(flat))
                values = pa.array(np.array(flat, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], names=[id_col, "ids"])

    base = df.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text"))
    return spread(base).mapInArrow(run, f"`{id_col}` long, ids array<int>")


def token_report(df: DataFrame, vocabulary_path: str, group_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", pattern: str = PATTERN) -> DataFrame:
    """(group column, texts, tokens, chars, unequal): sizes a group, and how many texts decoding does not give back."""
    key, shared = _shared(df, vocabulary_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, split = _ready(key, shared)
        for batch in batches:
            sizes, chars, bad = [], [], []
            for text in batch.column(1).to_pylist():
                ids = machine.encode(text, split) if text else []
                sizes.append(len(ids))
                chars.append(len(text or ""))
                bad.append(int(machine.decode(ids) != (text or "")))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(chars, pa.int64()), pa.array(bad, pa.int64())], names=["g", "tokens", "chars", "bad"])

    base = spread(df.select(F.col(group_col).cast("string").alias("g"), F.col(text_col).cast("string").alias("text")))
    sizes = base.mapInArrow(run, "g string, tokens long, chars long, bad long")
    return sizes.groupBy(F.col("g").alias(group_col)).agg(F.count(F.lit(1)).alias("texts"), F.sum("tokens").alias("tokens"), F.sum("chars").alias("chars"), F.sum("bad").alias("unequal"))
