"""Failure taxonomy: decision tables on the last attempt, examples and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from evalframe.functions.feasibility import verdict_failed
from evalframe.functions.text import tokens_equal, trim_text
from evalframe.operators.metrics import last_candidate, rate


# The sentences of held_out_summary and repair_feedback are fixed values.


def failed_tests(candidate: Column) -> Column:
    """the tests that did not pass; none without a candidate."""
    return F.filter(candidate["tests"], lambda t: ~F.coalesce(t["passed"], F.lit(False)))


def _any_timeout(tests: Column) -> Column:
    return F.coalesce(F.exists(tests, lambda t: F.coalesce(t["timed_out"], F.lit(False))), F.lit(False))


def agent_failure_reason(records: Column) -> Column:
    """Why a run without success ended, from its last attempt record."""
    last = F.try_element_at(records, F.lit(-1))
    verdict, result = last["resource_verdict"], last["repair_result"]
    return (
        F.when(last.isNull(), "NO_CANDIDATE")
        .when(verdict["time_status"].eqNullSafe("FAIL"), "THEORETICAL_TLE")
        .when(verdict["memory_status"].eqNullSafe("FAIL"), "THEORETICAL_MLE")
        .when(result.isNull(), "RESOURCE_CHECK_FAILED")
        .when(~F.coalesce(result["compiled"], F.lit(False)), "COMPILE_FAILED")
        .when(_any_timeout(result["tests"]), "REPAIR_TEST_TIMEOUT")
        .otherwise("REPAIR_TEST_FAILED")
    )


def category(reason: Column, records: Column, held_out: Column) -> Column:
    """The diagnostic category. Time-outs look at all failed tests, the text rules at the first."""
    why = F.coalesce(reason, F.lit(""))
    last = last_candidate(records)
    failed, held = failed_tests(last), failed_tests(held_out)
    first = F.try_element_at(failed, F.lit(1))
    expected, actual = F.coalesce(first["expected"], F.lit("")), F.coalesce(first["actual"], F.lit(""))
    none = F.coalesce(F.size(failed), F.lit(0)) < 1
    return (
        F.when(why.isin("THEORETICAL_TLE", "THEORETICAL_MLE"), why)
        .when(last.isNull(), F.coalesce(F.nullif(why, F.lit("")), F.lit("NO_CANDIDATE")))
        .when(~F.coalesce(last["compiled"], F.lit(False)), "COMPILE_ERROR")
        .when(_any_timeout(failed), "TIMEOUT")
        .when(why == "HELD_OUT_TEST_FAILED", "HELD_OUT_FAILED")
        .when(none & _any_timeout(held), "HELD_OUT_TIMEOUT")
        .when(none & (F.coalesce(F.size(held), F.lit(0)) > 0), "HELD_OUT_FAILED")
        .when(none, F.coalesce(F.nullif(why, F.lit("")), F.lit("UNKNOWN_FAILURE")))
        .when((actual == "") & (expected != ""), "EMPTY_OUTPUT")
        .when((actual != "") & (expected == ""), "EXTRA_OUTPUT")
        .when(tokens_equal(actual, expected) & (actual != expected), "OUTPUT_FORMAT")
        .otherwise("WRONG_ANSWER")
    )


def failures(results: DataFrame) -> DataFrame:
    """the rows that are not solved (a missing status is a failure), with their category."""
    return results.where(~F.col("status").eqNullSafe("SOLVED")).withColumn("category", category(F.col("failure_reason"), F.col("attempt_records"), F.col("held_out_result")))


def totals(results: DataFrame) -> DataFrame:
    """A15."""
    solved = F.col("status").eqNullSafe("SOLVED")
    return results.agg(F.count(F.lit(1)).alias("total"), F.count_if(solved).alias("solved"), F.count_if(~solved).alias("failed"), rate(solved).alias("verified_success_rate"))


def first_examples(failed: DataFrame, order: list[str], k: int = 5, keep: list[str] = []) -> DataFrame:
    """The first k failures of each category in input order, as trimmed rows (P9), with the columns to ``keep``."""
    ranked = failed.withColumn("example", F.row_number().over(Window.partitionBy("category").orderBy(*order))).where(F.col("example") <= k)
    first = F.try_element_at(failed_tests(last_candidate(F.col("attempt_records"))), F.lit(1))
    text = lambda c, n: trim_text(F.coalesce(c, F.lit("")), n)
    return ranked.select(
        "category", "example", "problem_id", "status", "failure_reason", "attempts", text(F.col("diagnostic_summary"), 500).alias("diagnostic_summary"),
        first["test_id"].alias("test_id"), first["timed_out"].alias("timed_out"), text(first["expected"], 300).alias("expected"), text(first["actual"], 300).alias("actual"), text(first["stderr"], 300).alias("stderr"),
        text(F.try_element_at("traces", F.lit(-1))["message"], 500).alias("last_trace"), F.try_element_at("traces", F.lit(-1))["stage"].alias("last_stage"), *keep,
    )


def held_out_summary(candidate: Column) -> Column:
    """Counts only; inputs and outputs of held-out tests never leave."""
    tests = candidate["tests"]
    n, bad = F.size(tests), F.size(failed_tests(candidate))
    late = F.size(F.filter(tests, lambda t: F.coalesce(t["timed_out"], F.lit(False))))
    return F.when(~F.coalesce(candidate["compiled"], F.lit(False)), "Held-out evaluation failed because the final candidate did not compile.").otherwise(
        F.format_string("Held-out evaluation failed: %d/%d tests failed; %d timed out. Test inputs and expected outputs are withheld.", bad, n, late)
    )


def repair_feedback(candidate: Column, cases: Column) -> Column:
    """What the next attempt is told: the compiler's words or the first failing repair test with its input."""
    first = F.try_element_at(failed_tests(candidate), F.lit(1))
    stdin = F.try_element_at(F.filter(cases, lambda c: c["id"] == first["test_id"]), F.lit(1))["stdin"]
    late = F.when(F.coalesce(first["timed_out"], F.lit(False)), "\nFailure type: TIMEOUT").otherwise("")
    blank = lambda c: F.coalesce(c, F.lit(""))
    return F.when(~F.coalesce(candidate["compiled"], F.lit(False)), F.concat(F.lit("Compilation failed:\n"), blank(candidate["compile_error"]))).otherwise(
        F.concat(F.lit("Repair test failed: "), blank(first["test_id"]), late, F.lit("\nInput:\n"), blank(stdin), F.lit("\nExpected:\n"), blank(first["expected"]), F.lit("\nActual:\n"), blank(first["actual"]), F.lit("\nStderr:\n"), blank(first["stderr"]))
    )


def verdict_line(v: Column) -> Column:
    """P16."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit("none"))
    return F.concat(
        F.lit("time="), v["time_status"], F.lit(" ("), text(v["estimated_operations"]), F.lit("/"), text(v["operation_budget"]), F.lit("); memory="), v["memory_status"],
        F.lit(" ("), text(v["estimated_memory_bytes"]), F.lit("/"), text(v["memory_budget_bytes"]), F.lit("); reasons="), F.to_json(v["reasons"]),
    )


def blocked(v: Column) -> Column:
    """A verdict that keeps a candidate from running: a failed check; an unknown one does not."""
    return F.coalesce(verdict_failed(v), F.lit(False))
