"""Evaluation metrics over result rows (one a problem, nested attempts): one pass, one global aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def rate(x: Column) -> Column:
    """A1: share of true values; null counts as false; 0 for no rows."""
    return F.coalesce(F.avg(F.when(x, F.lit(1.0)).otherwise(F.lit(0.0))), F.lit(0.0))


def mean(x: Column) -> Column:
    """A2: 0 for no rows."""
    return F.coalesce(F.avg(x), F.lit(0.0))


def executed(records: Column) -> Column:
    """The repair results of the attempts that were run, in order."""
    return F.transform(F.filter(records, lambda a: a["repair_result"].isNotNull()), lambda a: a["repair_result"])


def first_candidate(records: Column) -> Column:
    """O1."""
    return F.try_element_at(executed(records), F.lit(1))


def last_candidate(records: Column) -> Column:
    """O2."""
    return F.try_element_at(executed(records), F.lit(-1))


def pass_rate(candidate: Column) -> Column:
    """Share of passed tests of one candidate; 0 without a candidate or without tests."""
    tests = candidate["tests"]
    passed = F.size(F.filter(tests, lambda t: F.coalesce(t["passed"], F.lit(False))))
    return F.when(F.size(tests) > 0, passed / F.size(tests)).otherwise(F.lit(0.0))


def all_passed(candidate: Column) -> Column:
    """compiled and every test passed (true for no tests)."""
    return F.coalesce(candidate["compiled"], F.lit(False)) & F.coalesce(F.forall(candidate["tests"], lambda t: F.coalesce(t["passed"], F.lit(False))), F.lit(True))


def per_problem(results: DataFrame, keep: list[str] = []) -> DataFrame:
    """The flat quantities that the summary aggregates, with the columns to ``keep``."""
    recs, held, v = F.col("attempt_records"), F.col("held_out_result"), F.col("resource_verdict")
    first, last = first_candidate(recs), last_candidate(recs)
    return results.select(
        "problem_id", "status", "failure_reason", "explanation",
        F.coalesce(first["compiled"], F.lit(False)).alias("first_compiled"),
        F.coalesce(F.when(held.isNotNull(), held["compiled"]).otherwise(last["compiled"]), F.lit(False)).alias("final_compiled"),
        pass_rate(last).alias("repair_rate"), pass_rate(held).alias("held_out_rate"),
        F.greatest(F.lit(0), F.coalesce("attempts", F.lit(0)) - 1).alias("turns"),
        v["time_status"].alias("time_status"), v["memory_status"].alias("memory_status"), *keep,
    )


def _summary() -> list[Column]:
    solved = F.col("status").eqNullSafe("SOLVED")
    return [
        F.count(F.lit(1)).alias("num_problems"),
        rate(F.col("first_compiled")).alias("initial_compile_rate"),
        rate(F.col("final_compiled")).alias("final_compile_rate"),
        mean(F.col("repair_rate")).alias("repair_test_pass_rate"),
        mean(F.col("held_out_rate")).alias("held_out_test_pass_rate"),
        rate(solved).alias("verified_success_rate"),
        mean(F.col("turns")).alias("avg_repair_turns"),
        rate(F.col("time_status") == "FAIL").alias("theoretical_tle_rate"),
        rate(F.col("memory_status") == "FAIL").alias("theoretical_mle_rate"),
        rate((F.col("time_status") == "UNKNOWN") | (F.col("memory_status") == "UNKNOWN")).alias("complexity_unknown_rate"),
        F.coalesce(F.avg(F.when(solved, F.when(F.col("explanation") != "", F.lit(1.0)).otherwise(F.lit(0.0)))), F.lit(0.0)).alias("explanation_success_rate"),
    ]


def summarize(results: DataFrame) -> DataFrame:
    """One row, all zero for no results."""
    return per_problem(results).agg(*_summary())


def summarize_by(results: DataFrame, key: str) -> DataFrame:
    """The same, one row a value of ``key`` (say, a report)."""
    return per_problem(results, [key]).groupBy(key).agg(*_summary())


def failure_breakdown(results: DataFrame, order: Column | None = None) -> DataFrame:
    """failure_reason, n, first_seen: non-empty reasons."""
    keyed = results.where(F.coalesce("failure_reason", F.lit("")) != "")
    return keyed.groupBy("failure_reason").agg(F.count(F.lit(1)).alias("n"), F.min(order if order is not None else F.col("problem_id")).alias("first_seen"))


def ordered_histogram(df: DataFrame, key: str, order: Column) -> DataFrame:
    """Key, n, rank: most frequent first, ties by what comes first."""
    from pyspark.sql import Window

    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_seen"))
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "first_seen"))).drop("first_seen")
