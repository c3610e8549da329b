"""Verifying and translating the solutions of problem bundles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from evalframe.functions.text import extract_code
from evalframe.operators import sandbox
from evalframe.operators.limits import limit_on_success
from evalframe.operators.training import has_verified_cpp

# Wording of the translation request.
TRANSLATE_HEAD = "Translate the verified Python solution into a standalone C++17 stdin/stdout program.\nPreserve the algorithm and satisfy the resource limits.\n\n"
TRANSLATE_TAIL = "Return only one C++17 program inside a cpp markdown code block."

_CASES = "transform(concat(coalesce(tests.repair_tests, array()), coalesce(tests.eval_tests, array())), c -> named_struct('id', c.id, 'stdin', c.stdin, 'expected_stdout', c.expected_stdout, 'timeout_sec', c.timeout_sec))"
TIMEOUT = "coalesce(problem.time_limit_sec, 2.0D)"


def _candidates(rows: DataFrame) -> DataFrame:
    """problem_id, pos, code and the tests of the bundle as sandbox candidates."""
    return rows.withColumn("candidate_id", F.concat_ws(":", "problem_id", F.col("pos").cast("string")))


def verify_python(bundles: DataFrame, max_solutions: int = 3, memory_mb: int = 512) -> DataFrame:
    """Adds ``outcome`` (verified, no_python_solution, failed_python_solution) and marks what was run.

    Of each problem the first ``max_solutions`` Python solutions run on all its tests until one passes; those
    that ran are marked verified or not, all others stay as they were. A problem without tests verifies
    nothing.
    """
    is_py = lambda s: s["language"] == "python3"
    order = F.filter(F.transform("oracle.solutions", lambda s, i: F.when(is_py(s), i)), lambda i: i.isNotNull())
    base = bundles.withColumn("_py", F.slice(order, 1, max_solutions))
    rows = base.select(F.col("problem.id").alias("problem_id"), F.explode("_py").alias("pos"), "oracle", F.expr(_CASES).alias("tests"), F.expr(TIMEOUT).alias("timeout_sec"))
    rows = rows.select("problem_id", "pos", F.get("oracle.solutions", F.col("pos"))["code"].alias("code"), "tests", "timeout_sec")
    won = sandbox.first_passing(_candidates(rows), "problem_id", "pos", rounds=max_solutions, memory_mb=memory_mb).withColumnRenamed("problem_id", "_pid")
    joined = base.join(won, F.col("problem.id") == F.col("_pid"), "left")
    ran = lambda i: F.array_contains("_py", i) & (F.col("passed_at").isNull() | (i <= F.col("passed_at")))
    marked = F.transform("oracle.solutions", lambda s, i: F.when(ran(i), s.withField("verified", F.coalesce(i == F.col("passed_at"), F.lit(False)))).otherwise(s))
    outcome = F.when(F.size("_py") == 0, "no_python_solution").when(F.col("passed_at").isNull(), "failed_python_solution").otherwise("verified")
    return joined.withColumn("outcome", outcome).withColumn("oracle", F.col("oracle").withField("solutions", marked)).drop("_py", "_pid", "passed_at")


def translation_prompt(prompt: Column, python_code: Column) -> Column:
    """P18."""
    return F.concat(F.lit(TRANSLATE_HEAD), prompt, F.lit("\n\nPython solution:\n```python\n"), python_code, F.lit("\n```\n\n" + TRANSLATE_TAIL))


def first_verified_python(solutions: Column) -> Column:
    """O3c."""
    ok = F.filter(solutions, lambda s: (s["language"] == "python3") & F.coalesce(s["verified"], F.lit(False)))
    return F.coalesce(F.try_element_at(ok, F.lit(1))["code"], F.lit(""))


def table_translator(responses: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A translator that looks its responses up in a table (problem_id, candidate, response)."""
    return lambda asked: asked.select("problem_id", "candidate").join(responses, ["problem_id", "candidate"])


def translate(bundles: DataFrame, prompts: DataFrame, translator: Callable[[DataFrame], DataFrame], candidates: int = 2, language: str = "cpp17", memory_mb: int = 1024, compiler: str = "g++") -> DataFrame:
    """Bundles with the first of at most ``candidates`` translations that passes all tests added.

    ``prompts``: problem_id, prompt. ``translator`` maps (problem_id, candidate, request) to (problem_id,
    candidate, response). The passing code is appended as a verified C++ solution and becomes the reference;
    ``outcome`` is translated, no_verified_python or failed_translation.
    """
    base = bundles.withColumn("_python", first_verified_python(F.col("oracle.solutions")))
    asked = base.where("_python <> ''").select(F.col("problem.id").alias("problem_id"), "_python").join(prompts, "problem_id")
    asked = asked.select("problem_id", F.explode(F.sequence(F.lit(0), F.lit(candidates - 1))).alias("candidate"), translation_prompt(F.col("prompt"), F.col("_python")).alias("request"))
    codes = translator(asked).select("problem_id", F.col("candidate").alias("pos"), extract_code("response", strict=True).alias("code")).where("code <> ''")
    tests = bundles.select(F.col("problem.id").alias("problem_id"), F.expr(_CASES).alias("tests"), F.expr(TIMEOUT).alias("timeout_sec"))
    rows = _candidates(codes.join(tests, "problem_id"))
    won = sandbox.first_passing(rows, "problem_id", "pos", language, candidates, memory_mb, compiler).where("passed_at is not null").select("problem_id", F.col("passed_at").alias("pos"))
    best = codes.join(won, ["problem_id", "pos"]).select(F.col("problem_id").alias("_pid"), F.col("code").alias("_code"))
    joined = base.join(best, F.col("problem.id") == F.col("_pid"), "left")
    more = F.concat("oracle.solutions", F.array(F.struct(F.lit("cpp17").alias("language"), F.col("_code").alias("code"), F.lit(True).alias("verified"))))
    done = F.col("_code").isNotNull()
    oracle = F.col("oracle").withField("solutions", F.when(done, more).otherwise(F.col("oracle.solutions"))).withField("reference_solution", F.when(done, F.col("_code")).otherwise(F.col("oracle.reference_solution")))
    outcome = F.when(F.col("_python") == "", "no_verified_python").when(done, "translated").otherwise("failed_translation")
    return joined.withColumn("outcome", outcome).withColumn("oracle", oracle).drop("_python", "_pid", "_code")


def keep_verified(bundles: DataFrame, limit: int = 0) -> DataFrame:
    """The bundles with a verified C++ solution, at most ``limit`` of them in file order (0: all)."""
    ok = has_verified_cpp(F.col("oracle.solutions"))
    return limit_on_success(bundles, "file_ord", ok, limit).where(ok)


def solve_payload(results: DataFrame) -> DataFrame:
    """problem_id and the printed payload as JSON: solved runs with explanation, complexity and code, failed ones with reason and diagnostic, never code."""
    solved = F.col("status") == "SOLVED"
    have = set(results.columns)
    col = lambda c: F.col(c) if c in have else F.lit(None).cast("string").alias(c)
    verdict = col("resource_verdict").alias("resource_verdict")
    good = F.to_json(F.struct("status", "attempts", col("explanation").alias("explanation"), col("complexity").alias("complexity"), verdict, "code"), {"ignoreNullFields": "false"})
    bad = F.to_json(F.struct("status", "attempts", "failure_reason", "diagnostic_summary", verdict), {"ignoreNullFields": "false"})
    return results.select("problem_id", F.when(solved, good).otherwise(bad).alias("payload"))
