"""The registered queries of the core package, one or more for each operator family, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evalframe.functions import feasibility, semi, text
from evalframe.operators import curate, diagnose, formatcheck, incremental, limits, metrics, training
from evalframe.plans import views
from evalframe.session import table

S, D = SparkSession, DataFrame


# metrics


def metrics_summary(spark: S, d: str) -> D:
    out = metrics.summarize(views.results(spark, d))
    return out.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def per_problem_rates(spark: S, d: str) -> D:
    return metrics.per_problem(views.results(spark, d)).select("problem_id", "first_compiled", "final_compiled", F.round("repair_rate", 9).alias("repair_rate"), F.round("held_out_rate", 9).alias("held_out_rate"), "turns")


def failure_breakdown(spark: S, d: str) -> D:
    return metrics.failure_breakdown(views.results(spark, d), F.col("report_ord"))


def failure_histogram(spark: S, d: str) -> D:
    return metrics.ordered_histogram(diagnose.failures(views.results(spark, d)), "category", F.col("report_ord"))


def failure_totals(spark: S, d: str) -> D:
    return diagnose.totals(views.results(spark, d)).withColumn("verified_success_rate", F.round("verified_success_rate", 9))


def diagnostic_categories(spark: S, d: str) -> D:
    return diagnose.failures(views.results(spark, d)).select("problem_id", "category")


def topk_examples(spark: S, d: str) -> D:
    return diagnose.first_examples(diagnose.failures(views.results(spark, d)), ["report_ord"]).select("category", "example", "problem_id", "diagnostic_summary", "test_id", "expected", "actual", "last_trace")


def agent_failure_reason(spark: S, d: str) -> D:
    return views.results(spark, d).select("problem_id", diagnose.agent_failure_reason(F.col("attempt_records")).alias("reason"))


def held_out_summaries(spark: S, d: str) -> D:
    r = views.results(spark, d).where("held_out_result is not null")
    return r.select("problem_id", diagnose.held_out_summary(F.col("held_out_result")).alias("summary"))


# text


def normalize_output(spark: S, d: str) -> D:
    return table(spark, d, "test_cases").select("case_id", text.normalize_output("expected_stdout").alias("out"), text.normalize_output("stdin").alias("inp"))


def normalize_code(spark: S, d: str) -> D:
    return table(spark, d, "solutions").select("solution_id", F.md5(text.normalize_code("code")).alias("code_md5"))


def slugify(spark: S, d: str) -> D:
    return table(spark, d, "problem_specs").select("spec_id", text.slug("title").alias("slug"))


def trim_text(spark: S, d: str) -> D:
    return table(spark, d, "problem_specs").select("spec_id", text.trim_text("statement", 300).alias("short"), text.single_line("statement").alias("line"))


def constraint_lines(spark: S, d: str) -> D:
    lines = text.constraint_lines(F.concat_ws("\n", F.col("statement"), F.array_join("constraints", "\n")))
    return table(spark, d, "problem_specs").select("spec_id", F.array_join(lines, "|").alias("lines"))


def detect_language(spark: S, d: str) -> D:
    return table(spark, d, "solutions").groupBy(text.detect_language(F.coalesce("code", F.lit(""))).alias("detected"), "language").agg(F.count(F.lit(1)).alias("n"))


def parse_limits(spark: S, d: str) -> D:
    p = table(spark, d, "dpo_pairs")
    limit = lambda label: F.regexp_extract(F.coalesce("prompt", F.lit("")), rf"{label}: ([^\n]*)", 1)
    return p.select("pair_id", text.parse_time_limit(limit("Time limit")).alias("time_limit_sec"), text.parse_memory_limit(limit("Memory limit")).alias("memory_limit_mb"))


def extract_code(spark: S, d: str) -> D:
    r = F.coalesce("rejected", F.lit(""))
    return table(spark, d, "dpo_pairs").select("pair_id", F.md5(text.extract_code(r)).alias("lenient"), F.md5(text.extract_code(r, strict=True)).alias("strict"))


def complexity_fields(spark: S, d: str) -> D:
    time, space = text.complexity_fields(F.coalesce("expected_complexity", F.lit("")))
    return table(spark, d, "oracle_meta").select("oracle_id", time.alias("time_complexity"), space.alias("space_complexity"))


def declared_complexity(spark: S, d: str) -> D:
    c = F.coalesce("chosen", F.lit(""))
    return table(spark, d, "dpo_pairs").select("pair_id", text.extract_complexity(c, "time").alias("time_complexity"), text.extract_complexity(c, "space").alias("space_complexity"))


def output_equality(spark: S, d: str) -> D:
    t = table(spark, d, "test_cases")
    return t.select("case_id", text.tokens_equal(F.coalesce("expected_stdout", F.lit("")), F.coalesce(F.lower("expected_stdout"), F.lit(" "))).alias("same_tokens"))


# format


def format_adherence(spark: S, d: str) -> D:
    return formatcheck.score(table(spark, d, "dpo_pairs").select("pair_id", F.col("rejected").alias("completion"))).select("pair_id", "explanation_field", "chinese_explanation", "complexity_field", "cpp_code_block", "format_valid", F.md5("response_preview").alias("preview_md5"))


def format_rates(spark: S, d: str) -> D:
    out = formatcheck.rates(formatcheck.score(table(spark, d, "dpo_pairs").select("pair_id", F.col("chosen").alias("completion"))))
    return out.select("num_problems", *[F.round(c, 9).alias(c) for c in out.columns[1:]])


def format_reward(spark: S, d: str) -> D:
    return table(spark, d, "dpo_pairs").select("pair_id", F.round(text.format_reward(F.coalesce("chosen", F.lit(""))), 9).alias("reward"))


# feasibility


def variable_bounds(spark: S, d: str) -> D:
    b = table(spark, d, "problem_specs").select("spec_id", F.explode(feasibility.variable_bounds(F.col("constraints"))).alias("variable", "bound"))
    return b


def _estimates(spark: S, d: str) -> D:
    o = views.oracles(spark, d)
    time, space = text.complexity_fields(F.coalesce("expected_complexity", F.lit("")))
    return views.specs(spark, d).join(o, "problem_id").select("problem_id", "constraints", F.coalesce("time_limit_sec", F.lit(2.0)).alias("time_limit_sec"), F.coalesce("memory_limit_mb", F.lit(256)).alias("memory_limit_mb"), time.alias("tc"), space.alias("sc"), F.coalesce("reference_solution", F.lit("")).alias("code"))


def complexity_estimate(spark: S, d: str) -> D:
    e = _estimates(spark, d).withColumn("b", feasibility.variable_bounds(F.col("constraints"))).withColumn("expression", feasibility.expression_of(F.col("tc")))
    return e.select("problem_id", "expression", F.round(feasibility.estimate(F.col("expression"), F.col("b")), 0).alias("operations"))


def resource_verdict(spark: S, d: str) -> D:
    e = feasibility.add_resource_verdict(_estimates(spark, d), "constraints", "time_limit_sec", "memory_limit_mb", "tc", "sc", "code", name="v")
    return e.select("problem_id", "v.time_status", "v.memory_status", "v.operation_budget", "v.memory_budget_bytes", F.size("v.reasons").alias("reasons"))


def code_memory(spark: S, d: str) -> D:
    s = table(spark, d, "solutions").where("language = 'cpp17'")
    b = views.specs(spark, d).select("problem_id", feasibility.variable_bounds(F.col("constraints")).alias("b"))
    return s.join(b, "problem_id").select("solution_id", feasibility.code_memory(F.coalesce("code", F.lit("")), F.col("b")).alias("bytes"))


# curation


def case_ids(spark: S, d: str) -> D:
    """Ids of the tests of a problem's suite, by their place in a run of 32 positions (so that no list is unbounded)."""
    t = table(spark, d, "test_cases").withColumn("run", F.floor(F.coalesce("pos", F.lit(0)) / 32))
    lists = t.groupBy("problem_id", "suite", "run").agg(F.sort_array(F.collect_list(F.struct("case_id", "id", "name"))).alias("cs"))
    named = lists.select(F.arrays_zip(F.col("cs.case_id").alias("case_id"), curate.case_ids(F.col("cs"), "repair").alias("test_id")).alias("z"))
    return named.select(F.explode("z").alias("z")).select("z.case_id", "z.test_id")


def split_repair_eval(spark: S, d: str) -> D:
    t = table(spark, d, "test_cases").where("problem_id is not null")
    n = t.groupBy("problem_id").agg(F.count(F.lit(1)).cast("int").alias("n")).where("n > 1")
    k = curate.split_point(F.col("n"))
    return n.select("problem_id", "n", F.least(k, F.lit(20)).alias("repair"), F.least(F.col("n") - k, F.lit(10)).alias("eval"))


def limit_on_success(spark: S, d: str) -> D:
    s = table(spark, d, "solutions")
    return limits.limit_on_success(s, "solution_id", F.coalesce("verified", F.lit(False)) & F.col("language").eqNullSafe("cpp17"), 50).select("solution_id", "verified")


def verified_filter(spark: S, d: str) -> D:
    return views.picks(spark, d).where("vcpp is not null").select("problem_id", "n")


def best_solution(spark: S, d: str) -> D:
    j = views.picks(spark, d).join(views.oracles(spark, d), "problem_id", "full")
    none = F.lit("")
    return j.select("problem_id", F.md5(F.coalesce("vcpp", "acpp", "reference_solution", none)).alias("best"), F.md5(F.coalesce("vpy", "apy", none)).alias("best_python"), F.md5(F.coalesce("vcpp", "reference_solution", none)).alias("training"))


def tag_union(spark: S, d: str) -> D:
    o = table(spark, d, "oracle_meta")
    return o.select("oracle_id", F.array_join(semi.distinct_union(F.col("tags"), F.array("difficulty"), F.array("source")), "|").alias("tags"))


def convert_manifest(spark: S, d: str) -> D:
    """Every specification with all tests and codes of its problem, and some spoilt rows besides, converted and counted by outcome."""
    return curate.manifest(curate.convert(specification_rows(spark, d)))


def convert_bundles(spark: S, d: str) -> D:
    """What convert() makes of each specification: digests of the tests and solutions of the bundle."""
    c = curate.convert(specification_rows(spark, d)).where("row_index > 0")
    tests = lambda a: F.md5(F.array_join(F.transform(a, lambda t: F.concat(t["stdin"], F.lit("\x1f"), t["expected_stdout"])), "\x1e"))
    codes = F.array_join(F.transform("oracle.solutions", lambda s: F.concat(s["language"], F.lit("\x1f"), s["code"])), "\x1e")
    return c.select(
        (F.col("row_index") - 1).alias("spec_id"), F.coalesce("skip_reason", F.lit("written")).alias("outcome"), F.size("tests.repair_tests").alias("repair"), F.size("tests.eval_tests").alias("eval"), F.size("oracle.solutions").alias("codes"),
        tests("tests.repair_tests").alias("repair_md5"), tests("tests.eval_tests").alias("eval_md5"), F.md5(codes).alias("codes_md5"),
    )


def specification_rows(spark: S, d: str) -> D:
    """The raw dataset shape: one row a specification with all tests and all codes of its problem.

    Besides, every 17th specification has a row whose tests are no JSON and every 19th one of a function task; their index is negative.
    """
    lists = lambda t, order, cols: t.groupBy("problem_id").agg(F.sort_array(F.collect_list(F.struct(order, *cols))).alias("xs"))
    cases = lists(table(spark, d, "test_cases").where("problem_id is not null"), "case_id", ["stdin", "expected_stdout"])
    part = lambda c: F.transform("xs", lambda x: F.coalesce(x[c], F.lit("")))
    cases = cases.select("problem_id", F.to_json(F.struct(part("stdin").alias("inputs"), part("expected_stdout").alias("outputs"))).alias("input_output"))
    codes = lists(table(spark, d, "solutions").where("problem_id is not null and coalesce(code, '') <> ''"), "solution_id", ["code"])
    codes = codes.select("problem_id", F.to_json(part("code")).alias("solutions"))
    p = table(spark, d, "problem_specs").select("spec_id", "problem_id", "title", "statement", "source")
    whole = p.join(cases, "problem_id", "left").join(codes, "problem_id", "left").withColumn("row_index", F.col("spec_id") + 1)
    spoilt = lambda n, io: p.where(F.col("spec_id") % n == 0).withColumns({"input_output": F.lit(io), "solutions": F.lit("[]"), "row_index": -1 - F.col("spec_id")})
    j = whole.unionByName(spoilt(17, "not json")).unionByName(spoilt(19, '{"fn_name": "f", "inputs": [1], "outputs": [2]}'))
    null = F.lit(None).cast("string")
    return j.select(
        "row_index", F.col("title").alias("name"), F.col("statement").alias("question"), F.coalesce("input_output", F.lit('{"inputs": [], "outputs": []}')).alias("input_output"), "solutions",
        null.alias("difficulty"), F.lit('["a", "b"]').alias("tags"), F.lit("b").alias("raw_tags"), null.alias("skill_types"), "source", null.alias("url"), F.lit("1.5 seconds").alias("time_limit"), F.lit("128 megabytes").alias("memory_limit"),
        F.lit("O(n)").alias("Expected Time Complexity"), null.alias("Expected Auxiliary Space"), null.alias("expected_time_complexity"), null.alias("expected_space_complexity"),
    )


# training sets


def prompts(spark: S, d: str) -> D:
    return views.bundles(spark, d).select("problem_id", F.md5("prompt").alias("prompt_md5"))


def generation_prompts(spark: S, d: str) -> D:
    """The prompt of a first and of a later attempt, and that of a format check."""
    b = views.bundles(spark, d)
    first, later = (training.generation_prompt(F.col("prompt"), f, F.lit(i)) for i, f in ((1, F.lit("")), (2, F.repeat("answer", F.lit(20)))))
    return b.select("problem_id", F.md5(first).alias("first_md5"), F.md5(later).alias("later_md5"), F.md5(training.format_prompt(F.col("prompt"))).alias("format_md5"))


def sft_records(spark: S, d: str) -> D:
    return training.sft_records(views.bundles(spark, d)).select("problem_id", F.md5("input").alias("input_md5"), F.md5("output").alias("output_md5"))


def template_dpo_records(spark: S, d: str) -> D:
    return training.template_dpo_records(views.bundles(spark, d)).select("problem_id", F.md5("chosen").alias("chosen_md5"), F.md5("rejected").alias("rejected_md5"))


def grpo_prompts(spark: S, d: str) -> D:
    return training.grpo_records(views.bundles(spark, d)).select("problem_id", "reward_contract", F.md5("prompt").alias("prompt_md5"))


def chat_records(spark: S, d: str) -> D:
    r = training.sft_records(views.bundles(spark, d))
    chat = training.chat_text("Answer with a verified solution.", F.col("instruction"), F.col("input"), F.col("output"))
    return r.select("problem_id", F.md5(chat).alias("chat_md5"))


def _failed(spark: S, d: str) -> D:
    """Failure rows of the pairs table: the rejected answer as the failed attempt of its problem."""
    p = table(spark, d, "dpo_pairs")
    r = F.coalesce("rejected", F.lit(""))
    return p.select("pair_id", "problem_id", "failure_reason", "diagnostic_summary", text.extract_code(r, strict=True).alias("failed_code"), text.extract_complexity(r, "time").alias("time_complexity"), text.extract_complexity(r, "space").alias("space_complexity"))


def dpo_outcomes(spark: S, d: str) -> D:
    return training.failure_pairs(_failed(spark, d), views.bundles(spark, d), ["pair_id"]).select("pair_id", "outcome")


def dpo_skip_stats(spark: S, d: str) -> D:
    return training.outcome_counts(training.failure_pairs(_failed(spark, d), views.bundles(spark, d), ["pair_id"]))


def dpo_records(spark: S, d: str) -> D:
    pairs = training.failure_pairs(_failed(spark, d), views.bundles(spark, d), ["pair_id"]).where("outcome = 'written'")
    return pairs.select("pair_id", "problem_id", "failure_reason", F.md5("chosen").alias("chosen_md5"), F.md5("rejected").alias("rejected_md5"))


def dedupe_keep_first(spark: S, d: str) -> D:
    s = table(spark, d, "solutions").where("code is not null").withColumn("key", F.sha2(text.normalize_code("code"), 256))
    return s.groupBy("problem_id", "key").agg(F.min("solution_id").alias("solution_id")).select("solution_id", "problem_id")


# resume, isolation


def resume_remaining(spark: S, d: str) -> D:
    done = table(spark, d, "dpo_pairs").where("failure_reason = 'COMPILE_FAILED'").select("problem_id")
    return incremental.remaining(views.specs(spark, d).select("problem_id", "spec_id"), done, order="spec_id").select("problem_id", "spec_id")


def resume_merge(spark: S, d: str) -> D:
    r = views.results(spark, d).select("problem_id", "status", "report_ord")
    half = r.where("report_ord % 2 = 0")
    return incremental.merged(half, incremental.remaining(r, half)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def lookup_last_wins(spark: S, d: str) -> D:
    p = table(spark, d, "problem_specs").where("problem_id is not null").groupBy("problem_id").agg(F.max("spec_id").alias("spec_id"))
    return table(spark, d, "dpo_pairs").select("pair_id", "problem_id").join(p, "problem_id", "left").select("pair_id", "spec_id")


def leak_guard(spark: S, d: str) -> D:
    """Bundles whose prompt would show the reference solution or an answer; must be none."""
    b = views.bundles(spark, d)
    return b.where((F.length(text.strip("cpp")) > 0) & F.contains(F.col("prompt"), F.col("cpp"))).select("problem_id")


def _nations(spark: S, d: str) -> D:
    """Small problems of our own over the nation table: add the two keys. Programs of data tables are never run."""
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("problem_id"), F.col("n_nationkey").cast("long").alias("k"), F.col("n_regionkey").cast("long").alias("r"))
    none = F.lit(None)
    case = lambda i, x, y: F.struct(F.lit(i).alias("id"), none.cast("string").alias("name"), F.concat_ws(" ", x.cast("string"), y.cast("string")).alias("stdin"), (x + y).cast("string").alias("expected_stdout"), F.lit(2.0).alias("timeout_sec"))
    k, r = F.col("k"), F.col("r")
    return n.withColumns({"repair_tests": F.array(case("repair-0001", k, r)), "eval_tests": F.array(case("eval-0001", k + 1, r + 5))})


GOOD, BAD = "print(sum(map(int, input().split())))", "print('no')"


def run_python_oracles(spark: S, d: str) -> D:
    """A program of our own for each row of the nation table, of a kind chosen by its key, through the sandbox."""
    from evalframe.operators import sandbox

    kinds = [GOOD, "import sys\nsys.stdout.write(input())\nwhile True:\n    pass", "print(", BAD, GOOD + "\nraise SystemExit(3)", "while True:\n    print('x' * 99)", "import sys\nsys.stdout.buffer.write(b'\\xff')"]
    code = F.element_at(F.array(*[F.lit(x) for x in kinds]), (F.col("k") % len(kinds) + 1).cast("int"))
    df = _nations(spark, d).select(F.col("problem_id").alias("candidate_id"), code.alias("code"), F.col("repair_tests").alias("tests"), F.lit(2.0).alias("timeout_sec"), F.lit("repair").alias("suite"))
    first = lambda f: F.expr(f"get(tests, 0).{f}")
    return sandbox.evaluate(df).select("candidate_id", "compiled", first("passed").alias("passed"), (first("timed_out") | (F.length(first("actual")) > 1000)).alias("endless"))


def repair_loop(spark: S, d: str) -> D:
    """The loop over the nation table: answers at once, after a repair, never, overfitted, too slow at first, or none at all."""
    from evalframe.operators import loop

    spec = {"title": F.lit("Sum"), "statement": F.lit("Add two numbers."), "input_format": F.lit(""), "output_format": F.lit(""), "constraints": F.array(F.lit("1 <= n <= 100000")), "language": F.lit("python3"), "time_limit_sec": F.lit(2.0), "memory_limit_mb": F.lit(64)}
    n = _nations(spark, d)
    kind = (F.col("k") % 6).cast("int")
    tries = n.select("problem_id", kind.alias("kind"), F.concat(F.lit("input()\nprint("), (F.col("k") + F.col("r")).cast("string"), F.lit(")")).alias("fixed"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("attempt"))
    code = F.when(F.col("kind") == 3, F.col("fixed")).when((F.col("kind") == 2) | (F.col("kind") == 1) & (F.col("attempt") == 1), BAD).otherwise(GOOD)
    time = F.when((F.col("kind") == 4) & (F.col("attempt") < 3), "O(n^2)").otherwise("O(n)")
    answers = tries.where("kind < 5").select("problem_id", "attempt", code.alias("code"), time.alias("time_complexity"), F.lit("O(1)").alias("space_complexity"))
    out = loop.solve(n.withColumns(spec).drop("k", "r"), loop.table_generator(answers), memory_mb=1024)
    return out.select("problem_id", "status", "attempts", "failure_reason", "diagnostic_summary", F.size("traces").alias("traces"), F.element_at("traces", 1)["message"].alias("opening"))


def _small_bundles(spark: S, d: str) -> D:
    """Bundles over the nation table with two Python solutions, the right one first, second, absent or none at all."""
    n = _nations(spark, d)
    one = lambda language, code: F.struct(F.lit(language).alias("language"), F.lit(code).alias("code"), F.lit(False).alias("verified"))
    kind = F.col("k") % 4
    sols = F.when(kind == 0, F.array(one("python3", GOOD), one("python3", BAD))).when(kind == 1, F.array(one("python3", BAD), one("python3", GOOD))).when(kind == 2, F.array(one("python3", BAD), one("cpp17", "int main(){}"))).otherwise(F.array(one("cpp17", "int main(){}")))
    problem = F.struct(F.col("problem_id").alias("id"), F.lit("Sum").alias("title"), F.lit(2.0).alias("time_limit_sec"))
    return n.select(F.col("k").alias("file_ord"), problem.alias("problem"), F.struct("repair_tests", "eval_tests").alias("tests"), F.struct(sols.alias("solutions"), F.lit("").alias("reference_solution")).alias("oracle"))


def verify_python_oracles(spark: S, d: str) -> D:
    from evalframe.operators import oracles

    v = oracles.verify_python(_small_bundles(spark, d), memory_mb=1024)
    return v.select(F.col("problem.id").alias("problem_id"), "outcome", F.array_join(F.transform("oracle.solutions", lambda s: s["verified"].cast("string")), ",").alias("marks"))


def translate_oracles(spark: S, d: str) -> D:
    """Verified solutions through a stand-in translator; its programs run as Python, as no compiler may be at hand."""
    from evalframe.operators import oracles

    v = oracles.verify_python(_small_bundles(spark, d), memory_mb=1024)
    answer = lambda asked: asked.select("problem_id", "candidate", F.concat(F.lit("```cpp\n"), F.when(F.col("candidate") == 0, BAD).otherwise(GOOD), F.lit("\n```")).alias("response"))
    t = oracles.translate(v, v.select(F.col("problem.id").alias("problem_id"), F.lit("p").alias("prompt")), answer, language="python3")
    kept = oracles.keep_verified(t, limit=5)
    return t.join(kept.select(F.col("problem.id").alias("kept")), F.col("problem.id") == F.col("kept"), "left").select(
        F.col("problem.id").alias("problem_id"), "outcome", F.size("oracle.solutions").alias("solutions"), F.col("oracle.reference_solution").alias("reference"), F.col("kept").isNotNull().alias("kept"))


def resume_stream(spark: S, d: str) -> D:
    from evalframe.streaming.resume import stream_counts

    return stream_counts(spark, f"{d}/events.parquet")
