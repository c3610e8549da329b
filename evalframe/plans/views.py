"""Result-shaped and bundle-shaped views over the data tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evalframe.operators.limits import rank_within
from evalframe.operators.training import gold_answer, prompt, solution_picks
from evalframe.session import table

#: attempts of a run
PER_RUN = 4


def attempts(spark: SparkSession, d: str) -> DataFrame:
    """One row an event, read as an attempt of a run: four consecutive events of a user, at any size of the input."""
    e = rank_within(table(spark, d, "events"), "user_id", F.to_date("ts"), ["ts", "event_id"])
    run = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("-"), F.floor(F.col("rank") / PER_RUN).cast("string"))
    return e.select(run.alias("problem_id"), (F.col("rank") % PER_RUN + 1).cast("int").alias("attempt"), "event_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


def _runs(k, etype, value, suite: str, n):
    """The tests of an attempt, a function of its event only."""
    def one(i):
        ok = (etype == "purchase") | ((k + i) % 3 != 0)
        actual = F.when((k + i) % 5 == 0, "").when((k + i) % 5 == 1, F.format_string("%d  ok", k + i)).otherwise(F.format_string("%d no", k + i))
        expected = F.when((k + i) % 7 == 0, "").otherwise(F.format_string("%d ok", k + i))
        return F.struct(
            F.format_string(f"{suite}-%04d", i + 1).alias("test_id"), F.lit(suite).alias("suite"), ok.alias("passed"), expected.alias("expected"),
            F.when(ok, expected).otherwise(actual).alias("actual"), F.lit("").alias("stderr"), (~ok & (value > 100)).alias("timed_out"),
        )
    empty = F.transform(F.sequence(F.lit(0), F.lit(0)), lambda i: one(i))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: one(i))).otherwise(F.slice(empty, 1, 0))


def results(spark: SparkSession, d: str) -> DataFrame:
    """Nested report rows (RESULT schema, without the unused fields), one a run."""
    a = attempts(spark, d)
    k, etype, value = F.col("k"), F.col("event_type"), F.col("value")
    verdict = F.struct(F.when(value > 150, "FAIL").when(value < 3, "UNKNOWN").otherwise("PASS").alias("time_status"), F.when(k == 7, "FAIL").when(value < 1, "UNKNOWN").otherwise("PASS").alias("memory_status"))
    candidate = F.struct((etype != "error").alias("compiled"), F.when(etype == "error", "error: bad token").alias("compile_error"), _runs(k, etype, value, "repair", k % 4).alias("tests"))
    record = F.struct(
        F.col("attempt").alias("attempt"), verdict.alias("resource_verdict"), F.when(etype != "view", candidate).alias("repair_result"),
        F.when(k % 3 != 0, F.format_string("int main(){return %d;}  \n", k % 10)).alias("generated_code"),
        F.when(k % 2 == 0, F.struct(F.format_string("O(n^%d)", k % 3 + 1).alias("time_complexity"), F.when(k % 4 == 0, "").otherwise("O(n)").alias("space_complexity"))).alias("complexity"),
    )
    each = a.select("problem_id", "attempt", F.struct("attempt", record.alias("r"), "event_id", "event_type", "value", "k").alias("x"))
    runs = each.groupBy("problem_id").agg(F.sort_array(F.collect_list("x")).alias("xs")).withColumn("l", F.element_at("xs", -1))
    l = lambda c: F.col(f"l.{c}")  # noqa: E731, E741
    held = F.struct(F.lit(True).alias("compiled"), F.lit(None).cast("string").alias("compile_error"), _runs(l("k"), l("event_type"), l("value"), "eval", F.lit(2)).alias("tests"))
    reason = (
        F.when(l("event_type") == "purchase", None).when(l("event_type") == "error", "COMPILE_FAILED").when(l("value") > 150, "THEORETICAL_TLE")
        .when(l("k") % 11 == 0, "HELD_OUT_TEST_FAILED").when(l("event_type") == "click", "REPAIR_TEST_FAILED").when(l("k") % 2 == 0, "")
    )
    return runs.select(
        "problem_id", l("event_id").alias("report_ord"), F.when(l("event_type") == "purchase", "SOLVED").when(l("k") % 13 != 0, "FAILED").alias("status"), F.size("xs").alias("attempts"),
        F.when(l("k") % 2 == 1, "why").otherwise("").alias("explanation"), reason.alias("failure_reason"), F.format_string("run ended after\r\n%d", l("k")).alias("diagnostic_summary"),
        l("r.resource_verdict").alias("resource_verdict"), F.transform("xs", lambda x: x["r"]).alias("attempt_records"), F.when((l("event_type") == "purchase") | (l("value") > 50), held).alias("held_out_result"),
        F.array(F.struct(F.lit(1).alias("attempt"), F.lit("plan").alias("stage"), F.format_string("k=%d", l("k")).alias("message"))).alias("traces"),
    )


def last_by_problem(df: DataFrame, order: str, cols: list[str]) -> DataFrame:
    """One row a problem id: the one with the greatest order."""
    return df.where(F.col("problem_id").isNotNull()).groupBy("problem_id").agg(F.max_by(F.struct(*cols), order).alias("x")).select("problem_id", "x.*")


def specs(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "problem_specs")
    return last_by_problem(p, "spec_id", ["spec_id", "title", "statement", "input_format", "output_format", "constraints", "language", "time_limit_sec", "memory_limit_mb"])


def oracles(spark: SparkSession, d: str) -> DataFrame:
    return last_by_problem(table(spark, d, "oracle_meta"), "oracle_id", ["oracle_id", "tags", "expected_complexity", "reference_solution"])


def picks(spark: SparkSession, d: str) -> DataFrame:
    return solution_picks(table(spark, d, "solutions"), "problem_id", "solution_id")


def bundles(spark: SparkSession, d: str) -> DataFrame:
    """problem_id, bundle_ord, prompt, answer, cpp."""
    b = specs(spark, d).join(oracles(spark, d), "problem_id", "left").join(picks(spark, d), "problem_id", "left")
    spec = {c: F.col(c) for c in ("title", "statement", "input_format", "output_format", "constraints", "language", "time_limit_sec", "memory_limit_mb")}
    cpp = F.coalesce("vcpp", "reference_solution", F.lit(""))
    return b.select("problem_id", F.col("spec_id").alias("bundle_ord"), prompt(spec).alias("prompt"), cpp.alias("cpp"), gold_answer(F.col("tags"), F.col("expected_complexity"), cpp).alias("answer"))
