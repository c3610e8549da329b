"""Problem 9: sentence boundaries across languages and scripts, by cascading break / no-break rule tables.

A text is first cut by layout: blank lines, heading lines, list lines and fenced code blocks. Within a
paragraph every possible boundary (after a terminator and what closes with it; in Thai a blank between
two Thai characters) is put to the rule tables in their order; each rule is a pair of patterns for the
text before and after the position, and the first rule whose pair matches decides. A terminator inside
quotes or brackets is no possible boundary, unless it is the last thing inside: then the position after
the closing mark is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evalframe.session import spread

_CJK = "぀-ヿ㐀-䶿一-鿿豈-﫿"
_LOWER_WORD = r"(?:[a-zà-öø-ÿß]{2,}\b(?![.A-Z])|[а-яё])"

#: Cascading tables: (table, break?, before, after). Before-patterns end at the position, after-patterns
#: begin at the next character that is no white space. Before-patterns ignore letter case, after-patterns do
#: not. The abbreviations are fixed values.
RULES: list[tuple[str, bool, str, str]] = [
    # speech and dots that the sentence goes on after
    ("quotes", False, r"[!?.…。！？।؟]+[\"”’»“]", r"[,;:،؛—–\-]"),
    ("quotes", False, r"[!?.…]+[\"”’»“]", _LOWER_WORD),
    ("quotes", False, r"[!?.…。！？]+[”’」』»]", rf"[{_CJK}]"),
    ("quotes", False, r"[!?.…।]+\"", r"\S+ ने "),
    ("quotes", False, r"[!?.…]+\"", r"\S{1,40}[가이은는] ?(?:말|썼|물|답|적|외|전|덧)"),
    ("dots", False, r"(?:\.{2,}|…+)", _LOWER_WORD),
    ("dots", False, r"…+", rf"[{_CJK}]"),
    # text in capitals, where the next word's case tells nothing
    ("capitals", False, r"[!?.…]+[\"”’»“]", r"(?:ASKED|WONDERED|SAID|WROTE|REPLIED|AND|BUT)\b"),
    ("capitals", False, r"(?-i:\.{2,}|…+)", r"(?:AND|OR|BUT)\b"),
    ("capitals", False, r"(?<!\w)(?-i:ET AL)\.", r"[A-Z]{2,}"),
    ("capitals", False, r"(?<!\w)(?-i:[AP]\.M)\.", r"(?:ON|AND|OR|IN|AT|TO|FOR|WITH|THE)\b"),
    ("capitals", True, r"(?<!\w)(?-i:Т\.\s?[ДПК])\.", r"[А-ЯЁ«]"),
    # abbreviations that never end a sentence
    ("en", False, r"(?<!\w)(?:Mr|Mrs|Ms|Dr|Prof|St|Messrs|vs|cf|e\.g|i\.e|n\.b|N\.B|viz|resp|incl|approx)\.", r"\S"),
    ("en", False, r"(?<!\w)(?:Figs?|Secs?|Eqs?|Tabs?|Ch|[Nn]os?|vol|pp?|ver|v|Art|[Rr]ef|approx|ca)\.", r"[\d#(~≈]"),
    ("de", False, r"(?<!\w)(?:z\.\s?B|d\.\s?h|u\.\s?a|z|d|u|i\.\s?d|o\.\s?[äÄ]|Nr|Abb|Hr|Fr|Dipl|bzw|vgl|Vgl|ca|evtl|ggf|inkl|sog|Str|Bd|Jh|Kap)\.", r"\S"),
    ("de", False, r"(?<!\w)(?:[Aa]m|[Ii]m|[Vv]om|[Zz]um|[Bb]is|[Dd](?:er|em|en|es|ie|as)|[Ss]eit|[Aa]b)\s+\d{1,4}\.", r"[A-ZÄÖÜa-zäöü]"),
    ("es", False, r"(?<!\w)(?:Dra?|Sra?s?|Srta|Ud|Uds|D|Dña|p\.\s?ej|p|ej|núm|pág|art|fig|cap|aprox|vol)\.", r"\S"),
    ("ru", False, r"(?<!\w)(?:т\.\s?е|т|[Сс]м|[Рр]ис|стр|[Гг]л|[Сс]р|[Нн]апр|ул|им|проф|акад|табл|п|разд|тыс|млн|млрд|№)\.", r"\S"),
    ("ru", False, r"(?<!\w)(?:т\.\s?[дпк]|др|гг?|руб|коп|пр)\.", r"[а-яё]"),
    ("hi", False, r"(?<!\w)(?:डॉ|डा|श्री|प्रो|कु|पं|सं|क्र|पृ)\.", r"\S"),
    ("ar", False, r"(?<!\w)(?:ص|د|أ|م|ج|ت|هـ|رقم)\.", r"\S"),
    ("initials", False, r"(?<![\w.])(?-i:[A-ZÀ-ÖØ-ÞА-ЯЁ])\.", r"[A-ZÀ-ÖØ-ÞА-ЯЁa-zà-ÿа-яё]"),
    # abbreviations that may end one: they do not before a word in lower case
    ("en", False, r"(?<!\w)(?:et al|etc|[ap]\.m|Inc|Ltd|Co|Jr|Sr|usw|etc)\.", rf"(?:{_LOWER_WORD}|[,;:)])"),
    # terminators
    ("breaks", True, r"[。！？।॥؟۔!?]+[\"”’»“」』)）\]}]*", r""),
    ("breaks", True, r"\.+[\"”’»“」』)）\]}]*|…+[\"”’»“」』)）\]}]*", r""),
    ("th", True, r"[฀-๿]", r"[฀-๿]"),
]
_COMPILED = [(table, brk, re.compile(rf"(?:{b})\Z", re.I), re.compile(a) if a else None) for table, brk, b, a in RULES]
#: no rule but a break can match after a full stop that none of these ends with, nor after these marks
_SPECIAL = re.compile("(?:" + "|".join(f"(?:{b})" for table, brk, b, _ in RULES if not brk or table == "capitals") + r")\Z", re.I)
_PLAIN_STOPS = set("。！？।॥؟۔!?")

_PAIRS = re.compile(
    r"\"[^\"]*\"|„[^„“”]*[“”]|“[^“”]*”|«[^«»]*»|「[^「」]*」|『[^『』]*』|`[^`\n]*`"
    r"|\((?:[^()]|\([^()]*\))*\)|（[^（）]*）|\[[^\[\]]*\]|\{[^{}]*\}"
)
_TERMINATOR = re.compile(r"[。！？।॥؟۔]+[!?.]*|[!?]+(?=[\s\"”’»“」』)）\]}]|\Z|[぀-ヿ一-鿿])|[.…]+(?=[\s\"”’»“」』)）\]}]|\Z)|…+")
_CLOSERS = re.compile(r"[”’»」』)）\]}]*")
_THAI = re.compile(r"(?<=[฀-๿])\s+(?=[฀-๿])")
_HAS_THAI = re.compile(r"[฀-๿]")
_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n|\Z)")
_FENCE = re.compile(r"\s*(`{3,}|~{3,})")
_CLOSING = set("\"”’»“」』)）]}")


#: what a rule looks back on besides blanks and marks: no before-pattern asks for more
REACH = 20
_RUNS = re.compile(r"\s\s|[.!?…。！？]{3}")
_MARKS = set(".!?…。！？।॥؟۔\"”’»“」』)）]}")


def _back(text: str, at: int) -> int:
    """Where REACH characters that are neither blanks nor marks begin before the position."""
    left = REACH
    while at and left:
        at -= 1
        if not text[at].isspace() and text[at] not in _MARKS:
            left -= 1
    return at


def decide(text: str, at: int) -> bool:
    """Whether a sentence ends at the position: the first rule of the tables that matches."""
    end = len(text)
    nxt = at
    while nxt < end and text[nxt].isspace():
        nxt += 1
    if nxt == end:
        return True
    if text[at - 1] in _PLAIN_STOPS:
        return True
    start = max(0, at - REACH)
    if _RUNS.search(text, start, at):
        start = _back(text, at)
    if text[at - 1] == "." and not _SPECIAL.search(text, start, at):
        return True
    for _, brk, b, a in _COMPILED:
        if (a is None or a.match(text, nxt)) and b.search(text, start, at):
            return brk
    return False


def _paragraph(text: str, start: int, end: int, out: list[tuple[int, int]]) -> None:
    """The sentences of one paragraph, as positions in ``text``."""
    p = text[start:end]
    spans = [m.span() for m in _PAIRS.finditer(p)]
    cuts: list[int] = []
    began, k = len(p) - len(p.lstrip()), 0
    for m in _TERMINATOR.finditer(p):
        s, e = m.span()
        if s < began:
            continue
        while k < len(spans) and spans[k][1] <= s:
            k += 1
        if k < len(spans) and spans[k][0] <= s:
            a, b = spans[k]
            if e != b - 1:
                continue
            e = b
            if p[a] in "(（[{" and a != began:
                continue
        else:
            e = _CLOSERS.match(p, e).end()
        if decide(p, e):
            cuts.append(e)
            began = e
            while began < len(p) and p[began].isspace():
                began += 1
    if _HAS_THAI.search(p):
        cuts = sorted({*cuts, *(m.start() for m in _THAI.finditer(p) if decide(p, m.start()))})
    at = 0
    for cut in [*cuts, len(p)]:
        a, b = at, cut
        while a < b and p[a].isspace():
            a += 1
        while b > a and p[b - 1].isspace():
            b -= 1
        if a < b:
            out.append((start + a, start + b))
        at = cut


def sentence_spans(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of every sentence unit in code points; none for null, empty and blank texts."""
    out: list[tuple[int, int]] = []
    if not text:
        return out
    size, at, para, fence, opened = len(text), 0, -1, "", 0

    def unit(a: int, b: int) -> None:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            out.append((a, b))

    def close(b: int) -> None:
        nonlocal para
        if para >= 0:
            _paragraph(text, para, b, out)
            para = -1

    while at < size:
        m = _LINE.match(text, at)
        end = m.end()
        line = m[0]
        bare = line.strip()
        if fence:
            if bare.startswith(fence) and not bare.strip(fence[0]):
                unit(opened, end)
                fence = ""
        elif not bare:
            close(at)
        else:
            head = bare[0]
            if head in "`~" and (f := _FENCE.match(line)):
                close(at)
                fence, opened = f[1], at
            elif head == "#" or bare.startswith("- ") or bare == "-":
                close(at)
                unit(at, end)
            elif para < 0:
                para = at
        at = end
    if fence:
        unit(opened, size)
    close(size)
    return out


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, starts, ends = [], [], []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for a, b in sentence_spans(text):
                ids.append(i)
                starts.append(a)
                ends.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=["doc_id", "start_pos", "end_pos"])


def sentences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start_pos, end_pos): one row a sentence unit, offsets in code points, end exclusive.

    The units of a text cover all of it but white space. Null, empty and blank texts give no rows; a
    repeated row gives its units again. An open code fence runs to the end of the text.
    """
    base = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return spread(base).mapInArrow(_run, "doc_id long, start_pos long, end_pos long")
