"""Running candidate programs: one row holds a candidate and its tests, one task runs many rows.

Programs run in a temporary directory of the executor with time, memory and process limits; nothing
outlives the row, so a lost task is simply run again.
"""

from __future__ import annotations

import os
import resource
import signal
import subprocess
import sys
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from evalframe.schemas import CANDIDATE_RESULT


#: what a program may write to one file or stream
OUTPUT_MB = 16
#: what a build may write
BUILD_MB = 256


def normalized(data: bytes | str) -> str:
    """Output as it is compared: decoded with replacement, one kind of line end, no white space at ends."""
    s = data.decode("utf-8", errors="replace") if isinstance(data, bytes) else data
    return "\n".join(line.rstrip() for line in s.replace("\r\n", "\n").replace("\r", "\n").split("\n")).rstrip("\n")


def _limits(memory_mb: int, seconds: float, output_mb: int):
    def apply() -> None:
        resource.setrlimit(resource.RLIMIT_AS, (memory_mb << 20, memory_mb << 20))
        resource.setrlimit(resource.RLIMIT_CPU, (int(seconds) + 1, int(seconds) + 2))
        resource.setrlimit(resource.RLIMIT_CORE, (0, 0))
        resource.setrlimit(resource.RLIMIT_FSIZE, (output_mb << 20, output_mb << 20))
    return apply


def _call(args: list[str], cwd: str, stdin: bytes, seconds: float, memory_mb: int, output_mb: int = OUTPUT_MB) -> tuple[int | None, bytes, bytes]:
    """(exit code or None on a time-out, stdout, stderr); partial output is kept.

    Output goes to files that the file-size limit binds, so a program that prints without end is stopped
    (its exit code is not 0) and never fills the executor. The program runs in a group of its own, and
    whatever is left of the group is killed at the end.
    """
    with tempfile.TemporaryFile() as given, tempfile.TemporaryFile() as out, tempfile.TemporaryFile() as err:
        given.write(stdin)
        given.seek(0)
        env = {"PATH": os.environ.get("PATH", ""), "PYTHONDONTWRITEBYTECODE": "1"}
        run = subprocess.Popen(args, cwd=cwd, stdin=given, stdout=out, stderr=err, preexec_fn=_limits(memory_mb, seconds, output_mb), env=env, start_new_session=True)
        try:
            code: int | None = run.wait(seconds)
        except subprocess.TimeoutExpired:
            code = None
        try:
            os.killpg(run.pid, signal.SIGKILL)
        except (ProcessLookupError, PermissionError):
            pass
        run.wait()
        out.seek(0)
        err.seek(0)
        return code, out.read(output_mb << 20), err.read(output_mb << 20)


def _run_tests(command: list[str], cwd: str, tests, default: float, suite: str, memory_mb: int) -> list[dict]:
    out = []
    for t in tests:
        seconds = t["timeout_sec"] if t["timeout_sec"] is not None and t["timeout_sec"] == t["timeout_sec"] else default
        code, stdout, stderr = _call(command, cwd, (t["stdin"] or "").encode(), float(seconds), memory_mb)
        expected, actual = normalized(t["expected_stdout"] or ""), normalized(stdout)
        out.append({"test_id": t["id"], "suite": suite, "passed": code == 0 and actual == expected, "expected": expected, "actual": actual, "stderr": stderr.decode("utf-8", errors="replace"), "timed_out": code is None})
    return out


def _one(language: str, code: str, tests, default: float, suite: str, memory_mb: int, compiler: str) -> tuple[bool, str | None, list[dict]]:
    with tempfile.TemporaryDirectory() as d:
        name = "main.py" if language == "python3" else "main.cpp"
        source = os.path.join(d, name)
        with open(source, "w", encoding="utf-8", errors="surrogatepass") as f:
            f.write(code or "")
        if language == "python3":
            build, command, limit = [sys.executable, "-m", "py_compile", name], [sys.executable, name], 10.0
        else:
            build, command, limit = [compiler, "-std=c++17", "-O2", "-pipe", name, "-o", "main"], [os.path.join(d, "main")], 20.0
        try:
            built, _, err = _call(build, d, b"", limit, max(memory_mb, 1024), BUILD_MB)
        except OSError as e:
            return False, f"compiler not available: {e}", []
        if built != 0:
            return False, "Compilation timed out." if built is None else err.decode("utf-8", errors="replace"), []
        return True, None, _run_tests(command, d, tests, default, suite, memory_mb)


def evaluate(candidates: DataFrame, language: str = "python3", memory_mb: int = 512, compiler: str = "g++") -> DataFrame:
    """candidate_id, compiled, compile_error, tests for rows of the CANDIDATE schema.

    All tests run, in order; a test passes with exit code 0 and equal normalised output. A missing
    compiler, a failed or a late build is compiled = false. Null code is an empty program, null tests none.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                tests = r.tests if r.tests is not None else []
                default = r.timeout_sec if r.timeout_sec is not None and r.timeout_sec == r.timeout_sec else 2.0
                compiled, error, runs = _one(language, r.code, tests, default, r.suite or "repair", memory_mb, compiler)
                rows.append((r.candidate_id, compiled, error, runs))
            yield pd.DataFrame(rows, columns=["candidate_id", "compiled", "compile_error", "tests"])
    return candidates.mapInPandas(run, CANDIDATE_RESULT)


def first_passing(candidates: DataFrame, group: str, position: str, language: str = "python3", rounds: int = 3, memory_mb: int = 512, compiler: str = "g++") -> DataFrame:
    """For each group the first of at most ``rounds`` candidates that passes all its tests (at least one).

    Round r runs the r-th candidate of the groups still open; the rest are never run. Columns: the group,
    position of the passing candidate (null: none passed).
    """
    from pyspark.sql import Window, functions as F

    from evalframe.operators.metrics import all_passed
    from evalframe.session import checkpointed

    ranked = candidates.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(position)))
    open_groups = checkpointed(candidates.select(group).distinct())
    won = None
    for r in range(1, rounds + 1):
        now = ranked.where(F.col("_r") == r).join(open_groups, group, "left_semi")
        got = evaluate(now.select("candidate_id", "code", "tests", "timeout_sec", F.lit("repair").alias("suite")), language, memory_mb, compiler)
        ok = got.where(all_passed(F.struct("compiled", "tests")) & (F.size("tests") > 0)).select("candidate_id")
        new = checkpointed(now.join(ok, "candidate_id", "left_semi").select(group, F.col(position).alias("passed_at")))
        won = new if won is None else won.unionByName(new)
        if r < rounds:
            open_groups = checkpointed(open_groups.join(new.select(group), group, "left_anti"))
    return candidates.select(group).distinct().join(won, group, "left")
