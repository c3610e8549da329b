"""The self-repair loop: a few rounds over all problems at once, the active set shrinking each round.

A generator is any function from a DataFrame of requests (problem_id, attempt, prompt, feedback) to one of
responses (problem_id, code, time_complexity, space_complexity, optionally reasoning), one a problem; it gets
neither the oracle nor the held-out tests. A problem without a response has failed that attempt and stays. A round generates, checks resources (a failed check skips execution, an unknown one does
not), runs the repair tests, and runs the held-out tests of what passed. A held-out failure is final and
tells nothing back.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evalframe.functions.feasibility import add_resource_verdict, unknown_verdict
from evalframe.functions.text import general_number
from evalframe.operators import diagnose, sandbox
from evalframe.operators.metrics import all_passed
from evalframe.operators.training import generation_prompt, prompt
from evalframe.session import checkpointed

Generator = Callable[[DataFrame], DataFrame]
SPEC = ("title", "statement", "input_format", "output_format", "constraints", "language", "time_limit_sec", "memory_limit_mb")


# Messages of the loop.
NO_REPAIR_TESTS, NO_EVAL_TESTS = "No repair tests are configured.", "No held-out evaluation tests are configured."
REPAIR_PASSED, HELD_OUT_PASSED, ENDED = "All repair tests passed.", "All held-out tests passed.", "Maximum repair turns reached."
NO_ANSWER = "The generator gave no program."


def table_generator(answers: DataFrame) -> Generator:
    """A generator that looks answers up in a table (problem_id, attempt, code, time_complexity, space_complexity)."""
    return lambda asked: asked.select("problem_id", "attempt").join(answers, ["problem_id", "attempt"]).drop("attempt")


def as_cases(cases: str) -> Column:
    """Tests of a bundle in the shape that the sandbox takes."""
    return F.transform(cases, lambda c: F.struct(c["id"].alias("id"), F.lit(None).cast("string").alias("name"), c["stdin"].alias("stdin"), c["expected_stdout"].alias("expected_stdout"), c["timeout_sec"].alias("timeout_sec")))


def _answered(asked: DataFrame, given: DataFrame) -> DataFrame:
    """One response for every problem asked about; nulls where the generator gave none."""
    text = lambda c: (F.col(c) if c in given.columns else F.lit(None)).cast("string").alias(c)
    one = given.groupBy("problem_id").agg(F.min(F.struct(*[text(c) for c in ("code", "time_complexity", "space_complexity", "reasoning")])).alias("r"))
    return asked.select("problem_id").join(one, "problem_id", "left").select("problem_id", "r.*")


def solve(
    problems: DataFrame, generate: Generator, language: str = "python3", max_repair_turns: int = 3, capture_code: bool = False, memory_mb: int = 512, compiler: str = "g++",
    explain: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """One row a problem, all of them: problem_id, status, attempts, code, explanation,
    failure_reason, diagnostic_summary, resource_verdict (of the last attempt), attempt_records, held_out_result, traces.

    ``problems``: problem_id, the SPEC columns, repair_tests and eval_tests. FAILED rows carry no code.
    ``explain`` maps solved rows (problem_id, code) to (problem_id, explanation).
    """
    base = checkpointed(problems)
    sized = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    missing = F.when(~sized("repair_tests"), "MISSING_REPAIR_TESTS").when(~sized("eval_tests"), "MISSING_EVAL_TESTS")
    refused = base.withColumn("failure_reason", missing).where("failure_reason is not null")
    active = base.where(missing.isNull()).select("problem_id", F.lit("").alias("feedback"))
    done, log = [], []
    spec = base.select("problem_id", prompt({c: F.col(c) for c in SPEC}).alias("prompt"))
    limits = base.select("problem_id", "constraints", F.coalesce("time_limit_sec", F.lit(2.0)).alias("tl"), F.coalesce("memory_limit_mb", F.lit(256)).alias("ml"), "repair_tests", "eval_tests")
    for attempt in range(1, max_repair_turns + 2):
        asked = active.join(spec, "problem_id").select("problem_id", F.lit(attempt).alias("attempt"), generation_prompt(F.col("prompt"), F.col("feedback"), F.lit(attempt)).alias("prompt"), "feedback")
        answer = _answered(asked, generate(asked)).join(limits, "problem_id")
        judged = checkpointed(add_resource_verdict(answer, "constraints", "tl", "ml", "time_complexity", "space_complexity", "code"))
        stopped = diagnose.blocked(F.col("resource_verdict"))
        as_rows = lambda df, tests, suite: df.select(F.col("problem_id").alias("candidate_id"), "code", F.col(tests).alias("tests"), F.col("tl").alias("timeout_sec"), F.lit(suite).alias("suite"))
        ran = sandbox.evaluate(as_rows(judged.where(~stopped & F.col("code").isNotNull()), "repair_tests", "repair"), language, memory_mb, compiler)
        ran = checkpointed(ran.select(F.col("candidate_id").alias("problem_id"), F.struct("compiled", "compile_error", "tests").alias("repair_result")))
        silent = F.when(F.col("code").isNull() & ~stopped, F.struct(F.lit(False).alias("compiled"), F.lit(NO_ANSWER).alias("compile_error"), F.array().cast(ran.schema["repair_result"].dataType["tests"].dataType).alias("tests")))
        seen = judged.join(ran, "problem_id", "left").withColumn("repair_result", F.coalesce("repair_result", silent))
        passed = F.col("repair_result").isNotNull() & all_passed(F.col("repair_result"))
        held = sandbox.evaluate(as_rows(seen.where(passed), "eval_tests", "eval"), language, memory_mb, compiler)
        held = checkpointed(held.select(F.col("candidate_id").alias("problem_id"), F.struct("compiled", "compile_error", "tests").alias("held_out_result")))
        done.append(seen.where(passed).join(held, "problem_id").select("problem_id", "code", "held_out_result", all_passed(F.col("held_out_result")).alias("ok")))
        why = F.when(stopped, F.array_join("resource_verdict.reasons", "\n")).otherwise(diagnose.repair_feedback(F.col("repair_result"), F.col("repair_tests")))
        record = F.struct(F.lit(attempt).alias("attempt"), "resource_verdict", "repair_result", (F.col("code") if capture_code else F.lit(None).cast("string")).alias("generated_code"))
        told = F.when(passed, REPAIR_PASSED).otherwise(why)
        steps = F.array(
            _trace(attempt, "generate", F.substring(F.coalesce("reasoning", F.lit("")), 1, 1000)), _trace(attempt, "resource_check", diagnose.verdict_line(F.col("resource_verdict"))),
            F.when(~stopped, _trace(attempt, "repair_tests", told)),
        )
        log.append(seen.select("problem_id", record.alias("record"), F.array_compact(steps).alias("steps")))
        active = checkpointed(seen.where(~F.coalesce(passed, F.lit(False))).select("problem_id", why.alias("feedback")))
    union = lambda dfs: reduce(lambda a, b: a.unionByName(b), dfs)
    ended = _ordered(union(log)).join(union(done), "problem_id", "left").join(active, "problem_id", "left").join(base.select("problem_id", "language", "time_limit_sec", "memory_limit_mb"), "problem_id")
    solved, tried = F.coalesce("ok", F.lit(False)), F.col("held_out_result").isNotNull()
    reason = F.when(solved, None).when(tried, "HELD_OUT_TEST_FAILED").otherwise(diagnose.agent_failure_reason(F.col("attempt_records")))
    summary = diagnose.held_out_summary(F.col("held_out_result"))
    told = F.when(solved, None).when(tried, summary).otherwise(F.coalesce(F.nullif("feedback", F.lit("")), F.lit(ENDED)))
    last = F.array(_trace(F.size("attempt_records"), "held_out_tests", F.when(solved, HELD_OUT_PASSED).otherwise(summary)))
    out = ended.select(
        "problem_id", F.when(solved, "SOLVED").otherwise("FAILED").alias("status"), F.size("attempt_records").alias("attempts"), F.when(solved, F.col("code")).alias("code"),
        reason.alias("failure_reason"), told.alias("diagnostic_summary"), F.element_at("attempt_records", -1)["resource_verdict"].alias("resource_verdict"), "attempt_records", "held_out_result",
        F.concat(_opening(), F.flatten("steps"), F.when(tried, last).otherwise(F.slice(last, 1, 0))).alias("traces"),
    )
    if explain:
        said = explain(out.where("status = 'SOLVED'").select("problem_id", "code")).select("problem_id", F.trim("explanation").alias("_said"))
        out = out.join(said, "problem_id", "left").withColumn("explanation", F.when(F.col("status") == "SOLVED", F.coalesce("_said", F.lit("")))).drop("_said")
    else:
        out = out.withColumn("explanation", F.when(F.col("status") == "SOLVED", F.lit("")))
    note = F.when(F.col("failure_reason") == "MISSING_REPAIR_TESTS", NO_REPAIR_TESTS).otherwise(NO_EVAL_TESTS)
    empty = refused.select("problem_id", F.lit("FAILED").alias("status"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("code"), "failure_reason", note.alias("diagnostic_summary"), unknown_verdict(F.coalesce("time_limit_sec", F.lit(2.0)), F.coalesce("memory_limit_mb", F.lit(256))).alias("resource_verdict"), _opening().alias("traces"))
    return out.unionByName(empty, allowMissingColumns=True)


def _trace(attempt: int | Column, stage: str, message: Column) -> Column:
    return F.struct((attempt if isinstance(attempt, Column) else F.lit(attempt)).cast("int").alias("attempt"), F.lit(stage).alias("stage"), message.alias("message"))


def _opening() -> Column:
    """The trace that every run begins with."""
    limits = F.concat(
        F.lit("language="), F.coalesce("language", F.lit("cpp17")), F.lit("; time_limit="), general_number(F.coalesce("time_limit_sec", F.lit(2.0))),
        F.lit("s; memory_limit="), F.coalesce("memory_limit_mb", F.lit(256)).cast("string"), F.lit("MB"),
    )
    return F.array(_trace(0, "problem", limits))


def _ordered(log: DataFrame) -> DataFrame:
    """Attempt records in the order of their attempts (maps inside forbid sorting the structs themselves)."""
    one = log.groupBy("problem_id").agg(F.collect_list(F.struct("record", "steps")).alias("rs"))
    by_attempt = F.array_sort("rs", lambda a, b: a["record"]["attempt"] - b["record"]["attempt"])
    return one.withColumn("rs", by_attempt).select("problem_id", F.col("rs.record").alias("attempt_records"), F.col("rs.steps").alias("steps"))


def demonstration(spark: SparkSession) -> DataFrame:
    """Four small problems of our own against a table that stands in for a generator."""
    test = "named_struct('id','{0}-0001','name',cast(null as string),'stdin','{1}','expected_stdout','{2}','timeout_sec',cast(1 as double))"
    cases = lambda s, a, b: "array(" + test.format(s, a, b) + ")"
    problems = spark.createDataFrame([("first",), ("second",), ("never",), ("overfit",), ("slow",), ("untested",)], "problem_id string").select(
        "problem_id", F.lit("Sum").alias("title"), F.lit("Add two numbers.").alias("statement"), F.lit("").alias("input_format"), F.lit("").alias("output_format"), F.array(F.lit("1 <= n <= 100000")).alias("constraints"),
        F.lit("python3").alias("language"), F.lit(1.0).alias("time_limit_sec"), F.lit(64).alias("memory_limit_mb"),
        F.when(F.col("problem_id") != "untested", F.expr(cases("repair", "1 2", "3"))).alias("repair_tests"), F.expr(cases("eval", "2 5", "7")).alias("eval_tests"),
    )
    good, bad, fixed = "print(sum(map(int, input().split())))", "print(0)", "input()\nprint(3)"
    table = [("first", 1, good, "O(n)"), *[("second", i, bad if i == 1 else good, "O(n)") for i in (1, 2)], *[("never", i, bad, "O(n)") for i in (1, 2, 3, 4)], ("overfit", 1, fixed, "O(n)"), *[("slow", i, good, "O(n^2)" if i < 3 else "unknown") for i in (1, 2, 3)]]
    answers = spark.createDataFrame(table, "problem_id string, attempt int, code string, time_complexity string").withColumn("space_complexity", F.lit("O(1)"))
    return solve(problems, table_generator(answers), memory_mb=1024)
