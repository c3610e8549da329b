"""Command line: ``python -m evalframe.cli <command> ...`` (or spark-submit)."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession, functions as F

from evalframe.operators import curate, formatcheck, limits, loop, oracles, training
from evalframe.sources import bundles as src, reports


#: what a raw row may lack
RAW_COLUMNS = (
    "question", "name", "input_output", "solutions", "difficulty", "tags", "raw_tags", "skill_types", "source", "url", "time_limit", "memory_limit",
    "Expected Time Complexity", "Expected Auxiliary Space", "expected_time_complexity", "expected_space_complexity",
)


def _spark() -> SparkSession:
    return SparkSession.builder.appName("evalframe").config("spark.sql.session.timeZone", "UTC").config("spark.cleaner.referenceTracking.cleanCheckpoints", "true").getOrCreate()


def _bundle_rows(df):
    p = {c: F.col(f"problem.{c}") for c in ("title", "statement", "input_format", "output_format", "constraints", "language", "time_limit_sec", "memory_limit_mb")}
    cpp = training.training_solution(F.col("oracle.solutions"), F.col("oracle.reference_solution"))
    return df.select(F.col("problem.id").alias("problem_id"), F.col("file_ord").alias("bundle_ord"), training.prompt(p).alias("prompt"), cpp.alias("cpp"), training.gold_answer(F.col("oracle.tags"), F.col("oracle.expected_complexity"), cpp).alias("answer"))


def _counts(found: dict, names: tuple[str, ...]) -> dict:
    """Counters by name, those that are zero too."""
    return {n: found.get(n, 0) for n in names}


def convert(spark: SparkSession, a: argparse.Namespace) -> dict:
    raw = curate.from_offset(src.read_raw(spark, a.input), a.offset)
    for c in RAW_COLUMNS:
        raw = raw if c in raw.columns else raw.withColumn(c, F.lit(None).cast("string"))
    done = curate.convert(raw, ratio=a.repair_ratio, min_tests=a.min_tests, max_repair=a.max_repair_tests, max_eval=a.max_eval_tests, include_function_tasks=a.include_function_tasks, target_language=a.target_language)
    done = limits.limit_on_success(done, "row_index", F.col("skip_reason").isNull(), a.limit).cache()
    src.write_bundles(done.where("skip_reason is null"), a.output)
    found = {r.outcome: r.n for r in curate.manifest(done).collect()}
    payload = {"input": a.input, "offset": a.offset, "written": found.get("written", 0), "skipped": _counts(found, curate.OUTCOMES[1:])}
    payload |= {k: getattr(a, k) for k in ("limit", "target_language", "repair_ratio", "min_tests", "max_repair_tests", "max_eval_tests", "include_function_tasks")}
    reports.write_json(payload, f"{a.output}/_manifest.json")
    done.unpersist()
    return payload


def _problems(spark: SparkSession, path: str):
    """Bundles as the loop takes them."""
    b = src.read_bundles(spark, path)
    return b.select(F.col("problem.id").alias("problem_id"), *[F.col(f"problem.{c}").alias(c) for c in loop.SPEC], *[loop.as_cases(f"tests.{c}").alias(c) for c in ("repair_tests", "eval_tests")])


def _solved(spark: SparkSession, a: argparse.Namespace):
    answers = spark.read.schema("problem_id string, attempt int, code string, time_complexity string, space_complexity string, reasoning string").json(a.answers)
    return loop.solve(_problems(spark, a.problems), loop.table_generator(answers), a.language, a.max_repair_turns, a.capture_code, a.memory_mb, a.compiler)


def solve(spark: SparkSession, a: argparse.Namespace) -> dict:
    """One payload a problem; the answers of a generator are a table (problem_id, attempt, code, ...)."""
    return {r.problem_id: json.loads(r.payload) for r in oracles.solve_payload(_solved(spark, a)).collect()}


def evaluate(spark: SparkSession, a: argparse.Namespace) -> dict:
    results = _solved(spark, a).cache()
    out = reports.summary(results.withColumn("report_ord", F.col("problem_id")))
    if a.output:
        src.write_jsonl(reports.serialized(results), f"{a.output}/problems")
        reports.write_json(out, f"{a.output}/summary.json")
    results.unpersist()
    return out


def _kept_prefix(bundles, limit: int):
    return limits.limit_on_scanned(bundles, "file_ord", limit)


def verify(spark: SparkSession, a: argparse.Namespace) -> dict:
    done = oracles.verify_python(_kept_prefix(src.read_bundles(spark, a.problems), a.limit), a.max_solutions, a.memory_mb).cache()
    src.write_bundles(done, a.output)
    found = {r.outcome: r.n for r in training.outcome_counts(done).collect()}
    names = ("verified", "no_python_solution", "failed_python_solution")
    payload = {"total": sum(found.values()), **_counts(found, names), "copied_manifests": src.copy_manifests(a.problems, a.output)}
    reports.write_json(payload, f"{a.output}/_python_oracle_manifest.json")
    return payload


def translate(spark: SparkSession, a: argparse.Namespace) -> dict:
    """The responses of a translator are a table (problem_id, candidate, response)."""
    bundles = _kept_prefix(src.read_bundles(spark, a.problems), a.limit)
    responses = spark.read.schema("problem_id string, candidate int, response string").json(a.responses)
    done = oracles.translate(bundles, _bundle_rows(bundles).select("problem_id", "prompt"), oracles.table_translator(responses), a.candidates, a.language, a.memory_mb, a.compiler).cache()
    src.write_bundles(done, a.output)
    found = {r.outcome: r.n for r in training.outcome_counts(done).collect()}
    total = sum(found.values())
    payload = {"total": total, "attempted": total - found.get("no_verified_python", 0), **_counts(found, ("translated", "no_verified_python", "failed_translation")), "copied_manifests": src.copy_manifests(a.problems, a.output)}
    reports.write_json(payload, f"{a.output}/_cpp_translation_manifest.json")
    return payload


def keep(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Byte copies of the bundles with a verified C++ solution, and of the manifests."""
    bundles = src.read_bundles(spark, a.problems)
    ok = training.has_verified_cpp(F.col("oracle.solutions"))
    seen = limits.limit_on_success(bundles, "file_ord", ok, a.limit).select("file_name", ok.alias("ok")).cache()
    src.copy_files(seen.where("ok"), a.problems, a.output)
    total, copied = seen.agg(F.count(F.lit(1)), F.count_if("ok")).first()
    payload = {"total": total, "copied": copied, "skipped_no_verified_cpp": total - copied, "copied_manifests": src.copy_manifests(a.problems, a.output)}
    reports.write_json(payload, f"{a.output}/_verified_cpp_filter_manifest.json")
    return payload


def summarize(spark: SparkSession, a: argparse.Namespace) -> dict:
    out = reports.summary(src.read_reports(spark, a.reports))
    if a.output:
        reports.write_json(out, a.output)
    return out


def analyze(spark: SparkSession, a: argparse.Namespace) -> dict:
    text = reports.failure_markdown(src.read_reports(spark, a.reports), ["report_ord", "prob_pos"], a.examples, a.reports)
    with open(a.output, "w", encoding="utf-8") as f:
        f.write(text)
    return {"written": a.output}


def datasets(spark: SparkSession, a: argparse.Namespace) -> dict:
    rows = _bundle_rows(src.read_bundles(spark, a.problems)).cache()
    sets = {"sft": training.sft_records(rows), "dpo": training.template_dpo_records(rows), "grpo": training.grpo_records(rows)}
    for name, df in sets.items():
        src.write_jsonl(df, f"{a.output}/{name}")
    return {name: df.count() for name, df in sets.items()}


def pairs(spark: SparkSession, a: argparse.Namespace) -> dict:
    failed = src.read_reports(spark, a.reports).where(~F.col("status").eqNullSafe("SOLVED"))
    last = lambda keep: F.try_element_at(F.filter("attempt_records", keep), F.lit(-1))
    rows = failed.select(
        "report_ord", "prob_pos", "problem_id", "failure_reason", "diagnostic_summary", last(lambda r: F.coalesce(r["generated_code"], F.lit("")) != "")["generated_code"].alias("failed_code"),
        last(lambda r: r["complexity"].isNotNull())["complexity"]["time_complexity"].alias("time_complexity"), last(lambda r: r["complexity"].isNotNull())["complexity"]["space_complexity"].alias("space_complexity"),
    )
    out = training.failure_pairs(rows, _bundle_rows(src.read_bundles(spark, a.problems)), ["report_ord", "prob_pos"], tuple(a.reasons))
    at = F.col("report_ord").cast("long") * (1 << 40) + F.col("prob_pos")
    out = limits.limit_on_success(out.withColumn("_place", at), "_place", F.col("outcome") == "written", a.max_records).drop("_place").cache()
    src.write_jsonl(training.pair_records(out), f"{a.output}/dpo_failures")
    found = {r.outcome: r.n for r in training.outcome_counts(out).collect()}
    counts = {"scanned_failures": sum(found.values()) - found.get("skipped_failure_reason", 0), **_counts(found, training.PAIR_OUTCOMES)}
    reports.write_json(counts | {"reasons": a.reasons, "max_records": a.max_records}, f"{a.output}/dpo_failures_manifest.json")
    return counts


def check_format(spark: SparkSession, a: argparse.Namespace) -> dict:
    return formatcheck.rates(formatcheck.score(spark.read.schema("problem_id string, completion string").json(a.input))).first().asDict()


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="evalframe")
    sub = parser.add_subparsers(dest="command", required=True)
    p = sub.add_parser("convert")
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    for flag, kind, default in (("offset", int, 0), ("limit", int, 0), ("repair-ratio", float, 0.7), ("min-tests", int, 2), ("max-repair-tests", int, 20), ("max-eval-tests", int, 10), ("target-language", str, "cpp17")):
        p.add_argument(f"--{flag}", type=kind, default=default)
    p.add_argument("--include-function-tasks", action="store_true")
    p.set_defaults(run=convert)
    for name, run in (("solve", solve), ("evaluate", evaluate), ("verify", verify), ("translate", translate), ("filter", keep)):
        p = sub.add_parser(name)
        p.add_argument("--problems", required=True)
        p.set_defaults(run=run)
        if name in ("solve", "evaluate"):
            p.add_argument("--answers", required=True)
            p.add_argument("--max-repair-turns", type=int, default=3)
            p.add_argument("--capture-code", action="store_true")
        else:
            p.add_argument("--limit", type=int, default=0)
        p.add_argument("--output", required=name not in ("solve", "evaluate"), default="")
        if name != "filter":
            p.add_argument("--memory-mb", type=int, default=1024)
        if name in ("solve", "evaluate", "translate"):
            p.add_argument("--language", default="cpp17")
            p.add_argument("--compiler", default="g++")
        if name == "verify":
            p.add_argument("--max-solutions", type=int, default=3)
        if name == "translate":
            p.add_argument("--responses", required=True)
            p.add_argument("--candidates", type=int, default=2)
    for name, run in (("summarize", summarize), ("analyze", analyze), ("pairs", pairs)):
        p = sub.add_parser(name)
        p.add_argument("--reports", nargs="+", required=True)
        p.add_argument("--output", required=name != "summarize")
        p.set_defaults(run=run)
        if name == "analyze":
            p.add_argument("--examples", type=int, default=5)
        if name == "pairs":
            p.add_argument("--problems", required=True)
            p.add_argument("--reasons", nargs="*", default=list(training.DEFAULT_REASONS))
            p.add_argument("--max-records", type=int, default=0)
    p = sub.add_parser("datasets")
    p.add_argument("--problems", required=True)
    p.add_argument("--output", required=True)
    p.set_defaults(run=datasets)
    p = sub.add_parser("format")
    p.add_argument("--input", required=True)
    p.set_defaults(run=check_format)
    args = parser.parse_args(argv)
    print(json.dumps(args.run(_spark(), args), ensure_ascii=False, default=str))


if __name__ == "__main__":
    main()
