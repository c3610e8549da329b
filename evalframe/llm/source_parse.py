"""Problem 3: source files that do not parse in their stated language, by memoised derivatives.

Each file's tokens run through the derivative table of its language (``derivatives``, ``grammars``): an
empty derivative is the failing token, a state that cannot end is a truncation. Every python3 file is also
put to Python's own parser, which decides where the two differ (the fields of f-strings, for one, are not in
the grammar); the workers should run Python 3.13, whose grammar is the stated one.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evalframe.session import spread

LANGUAGES = ("python3", "cpp17", "java")


def _python_refuses(code: str) -> Exception | None:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse(code)
        except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
            return e
    return None


def _place(code: str, e: Exception) -> int:
    """The offset in code points that a refusal names; 0 if it names none."""
    if not isinstance(e, SyntaxError) or not e.lineno:
        return max(code.find("\0"), 0)
    lines = re.findall(r"[^\r\n]*(?:\r\n|\r|\n)", code)
    return min(sum(map(len, lines[: e.lineno - 1])) + max((e.offset or 1) - 1, 0), len(code))


def parse_failure(code: str | None, lang: str | None) -> tuple[int, bool] | None:
    """(offset in code points of the failing token, whether the text merely breaks off); None if it parses or is no case.

    Null and blank code, null languages and languages other than LANGUAGES are never cases.
    """
    from evalframe.llm.grammars import language

    if lang not in LANGUAGES or code is None or not code.strip():
        return None
    found = language(lang).failure(code)
    if lang == "python3":
        refused = _python_refuses(code)
        if found and refused:  # a target, say, is named by Python's parser before the token that cannot follow it
            named = _place(code, refused) if isinstance(refused, SyntaxError) and refused.lineno and not found[1] else found[0]
            return min(found[0], named), found[1]
        if found:
            return None
        if isinstance(refused, (SyntaxError, ValueError)):  # other errors are limits of the parser
            return _place(code, refused), False
    return found


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [parse_failure(c, l) for c, l in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        arrays = [batch.column(0), pa.array([f[0] if f else None for f in found], pa.int64()), pa.array([f[1] if f else None for f in found], pa.bool_()), *batch.columns[2:]]
        yield pa.RecordBatch.from_arrays(arrays, names=["id", "failed_at", "truncated", "language", "repo"])


def parsed_files(df: DataFrame, id_col: str = "solution_id", code_col: str = "code", language_col: str = "language", repo_col: str = "repo") -> DataFrame:
    """id, failed_at (null: parses or no case), truncated, language, repo: one row a file, whatever its columns hold."""
    cols = [F.col(id_col).cast("long").alias("id"), *[F.col(c).cast("string").alias(n) for c, n in ((code_col, "code"), (language_col, "language"), (repo_col, "repo"))]]
    return spread(df.select(*cols)).mapInArrow(_run, "id long, failed_at long, truncated boolean, language string, repo string")


def unparsable_files(df: DataFrame, **kw) -> DataFrame:
    """id, failed_at, truncated of the files that do not parse."""
    return parsed_files(df, **kw).where("failed_at is not null").select("id", "failed_at", "truncated")


def parse_rates(df: DataFrame, **kw) -> DataFrame:
    """repo, language, files, unparsable, truncated, rate; null repos and languages are groups of their own."""
    flags = parsed_files(df, **kw)
    out = flags.groupBy("repo", "language").agg(F.count(F.lit(1)).alias("files"), F.count("failed_at").alias("unparsable"), F.count_if("truncated").alias("truncated"))
    return out.withColumn("rate", F.col("unparsable") / F.col("files"))
