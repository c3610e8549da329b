"""String functions of the workload as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Unicode white space as a regular-expression class, control separators included.
WS = r"[\s\x1c-\x1f]"
# A run is entered at its start only and never given back, so long runs of blanks stay linear.
_BOTH_WS = rf"(?U)\A{WS}++|(?<!{WS}){WS}++\z"
_INLINE = r"[\s\x1c-\x1f&&[^\n]]"
_LINE_TAIL = rf"(?U)(?<!{_INLINE}){_INLINE}++(?=\n|\z)"
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"

# Labels and patterns of the answer format.
HEADING = r"(?i)(?:\A|\n)\s*(?:#{1,6}\s*)?%s\s*:?\s*"
EXPLANATION, TIME, SPACE = r"solution\s+explanation", r"time\s+complexity", r"space\s+complexity"
CPP_FENCE = r"(?is)```(?:cpp|c\+\+)\s*.*?```"
ANY_FENCE = r"(?is)```(?:cpp|c\+\+)?\s*(.*?)```"
BIG_O = r"(?i)(O\s*\([^)]+\))"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """White space removed at both ends (all Unicode white space, not blanks only)."""
    return F.regexp_replace(_col(c), _BOTH_WS, "")


def rstrip_lines(c: Column, ends: str) -> Column:
    """Line ends made newlines, white space before them removed."""
    return F.regexp_replace(F.regexp_replace(c, ends, "\n"), _LINE_TAIL, "")


def normalize_output(c: Column | str) -> Column:
    """One kind of line end, no white space at line ends, no empty lines at the end."""
    return F.regexp_replace(rstrip_lines(_col(c), "\r\n|\r"), r"(?<!\n)\n++\z", "")


def normalize_code(c: Column | str) -> Column:
    """Stripped as a whole, then each line at its end."""
    return rstrip_lines(strip(c), LINE_ENDS)


def extract_code(c: Column | str, strict: bool = False) -> Column:
    """The first fenced block; else all from ``#include``; else the text itself (strict: nothing)."""
    text = _col(c)
    at = F.instr(text, "#include")
    tail = strip(F.when(at > 0, F.substring(text, at, F.length(text))).otherwise(F.lit("") if strict else text))
    return F.when(F.regexp_like(text, F.lit(ANY_FENCE)), strip(F.regexp_extract(text, ANY_FENCE, 1))).otherwise(tail)


def _or_unknown(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown"))


def extract_complexity(c: Column | str, kind: str) -> Column:
    """``<kind> complexity: O(..)``, else ``unknown``."""
    return _or_unknown(F.regexp_extract(_col(c), rf"(?i){kind}\s+complexity\s*:\s*(o\s*\([^)]+\))", 1))


def labeled_complexity(c: Column | str, label: str) -> Column:
    """``<label>: O(..)`` or ``unknown``; the full-width colon counts."""
    return _or_unknown(F.regexp_extract(F.replace(_col(c), F.lit("："), F.lit(":")), rf"(?i){label}\s*:\s*(O\s*\([^)]+\)|unknown)", 1))


def complexity_fields(c: Column | str) -> tuple[Column, Column]:
    """(time, space): by label, else the first and the second ``O(..)``."""
    text = strip(c)
    every = F.regexp_extract_all(text, F.lit(BIG_O), F.lit(1))
    pick = lambda label, i: F.when(labeled_complexity(text, label) != "unknown", labeled_complexity(text, label)).otherwise(F.coalesce(F.try_element_at(every, F.lit(i)), F.lit("unknown")))
    return pick("time", 1), pick("space", 2)


def slug(c: Column | str, default: str = "problem", size: int = 120) -> Column:
    """Runs of other characters than ASCII letters and digits become one underscore; lower case; cut."""
    s = F.lower(F.regexp_replace(F.regexp_replace(_col(c), "[^a-zA-Z0-9]+", "_"), r"\A_+|_+\z", ""))
    return F.coalesce(F.nullif(F.substring(s, 1, size), F.lit("")), F.lit(default))


def trim_text(c: Column | str, size: int) -> Column:
    """One kind of line end; longer texts are cut and end with three dots."""
    text = F.regexp_replace(_col(c), "\r\n|\r", "\n")
    return F.when(F.length(text) <= size, text).otherwise(F.concat(F.substring(text, 1, size - 3), F.lit("...")))


def single_line(c: Column | str, size: int = 160) -> Column:
    """White space collapsed, trimmed to size, back quotes made quotes."""
    return F.translate(trim_text(F.regexp_replace(strip(c), rf"(?U){WS}+", " "), size), "`", "'")


def detect_language(c: Column | str) -> Column:
    """X11: by telling substrings."""
    low = F.lower(_col(c))
    has = lambda s: F.contains(low, F.lit(s))
    return F.when(has("#include") | has("using namespace std"), "cpp17").when(has("def ") | has("input(") | has("sys.stdin"), "python3").otherwise("unknown")


def constraint_lines(c: Column | str) -> Column:
    """Stripped lines that speak of a constraint or hold an upper bound."""
    lines = F.transform(F.split(_col(c), LINE_ENDS, -1), lambda x: strip(x))
    return F.filter(lines, lambda x: (x != "") & (F.contains(F.lower(x), F.lit("constraint")) | F.contains(x, F.lit("<=")) | F.contains(x, F.lit("≤"))))


def parse_time_limit(c: Column | str, default: float = 2.0) -> Column:
    """The first decimal number, whatever the unit."""
    return F.coalesce(F.nullif(F.regexp_extract(_col(c), r"[0-9]+(?:\.[0-9]+)?", 0), F.lit("")).try_cast("double"), F.lit(default))


def parse_memory_limit(c: Column | str, default: int = 256) -> Column:
    """The first whole number, whatever the unit."""
    return F.coalesce(F.nullif(F.regexp_extract(_col(c), r"[0-9]+", 0), F.lit("")).try_cast("int"), F.lit(default))


def limit_overflows(c: Column | str, kind: str) -> Column:
    """Whether a limit names a number that its type cannot hold; false for null and for texts without a number."""
    digits = F.nullif(F.regexp_extract(_col(c), r"[0-9]+(?:\.[0-9]+)?" if kind == "double" else r"[0-9]+", 0), F.lit(""))
    number = digits.try_cast(kind)
    beyond = number.isNull() | (number == F.lit(float("inf"))) if kind == "double" else number.isNull()
    return F.coalesce(digits.isNotNull() & beyond, F.lit(False))


def first_non_empty(*cols: Column | str) -> Column:
    """X15."""
    return F.coalesce(*[F.nullif(_col(c), F.lit("")) for c in cols], F.lit(""))


def expected_complexity(*cols: Column | str) -> Column:
    """The non-empty parts joined by comma and blank."""
    return F.concat_ws(", ", *[F.nullif(_col(c), F.lit("")) for c in cols])


def tokens_equal(a: Column, b: Column) -> Column:
    """Equal but for white space."""
    flat = lambda c: F.regexp_replace(strip(c), rf"(?U){WS}+", " ")
    return flat(a) == flat(b)


def general_number(c: Column | str) -> Column:
    """A number without trailing zeros: six significant digits for the range of limits (1e-4 to 1e6)."""
    return F.regexp_replace(F.format_string("%.6f", _col(c).cast("double")), r"\.?0+\z", "")


def has_explanation(c: Column | str) -> Column:
    """X20."""
    return F.regexp_like(_col(c), F.lit(HEADING % EXPLANATION))


def has_chinese_explanation(c: Column | str) -> Column:
    """A Chinese character between the explanation heading and the next time heading (or the end)."""
    text = _col(c)
    after = F.regexp_extract(text, rf"(?is)(?:\A|\n)\s*(?:#{{1,6}}\s*)?{EXPLANATION}\s*:?\s*(.*)\z", 1)
    head = F.element_at(F.split(after, HEADING % TIME, 2), 1)
    return has_explanation(text) & F.regexp_like(head, F.lit(r"[一-鿿]"))


def has_complexities(c: Column | str) -> Column:
    """X22."""
    return F.regexp_like(_col(c), F.lit(HEADING % TIME)) & F.regexp_like(_col(c), F.lit(HEADING % SPACE))


def has_cpp_block(c: Column | str) -> Column:
    """A closed fence tagged as C++."""
    return F.regexp_like(_col(c), F.lit(CPP_FENCE))


def format_reward(c: Column | str) -> Column:
    """0.2 for each of three signs of the format."""
    text = _col(c)
    has = lambda s: F.contains(text, F.lit(s))
    part = lambda b: F.when(b, F.lit(0.2)).otherwise(F.lit(0.0))
    return part(has("```cpp")) + part(has("Complexity:")) + part(has("#include") & has("int main"))
