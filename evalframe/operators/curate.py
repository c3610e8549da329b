"""Raw dataset rows to problem bundles, with every skipped row accounted for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evalframe.functions import semi, text


def split_point(n: Column, ratio: float = 0.7) -> Column:
    """How many of n ordered tests go to the repair side: half-even rounding, at least 1, at most n - 1."""
    return F.least(n - 1, F.greatest(F.lit(1), F.bround(n * F.lit(ratio)).cast("int")))


def split_cases(cases: Column, ratio: float = 0.7, max_repair: int = 20, max_eval: int = 10) -> tuple[Column, Column]:
    """(repair, eval) parts of an ordered array of tests; a cap of 0 or less is none."""
    n = F.size(cases)
    k = F.greatest(split_point(n, ratio), F.lit(0))
    repair = F.slice(cases, F.lit(1), k)
    evals = F.slice(cases, k + 1, F.greatest(n - k, F.lit(0)))
    cut = lambda a, m: F.slice(a, 1, m) if m > 0 else a
    return cut(repair, max_repair), cut(evals, max_eval)


def case_ids(cases: Column, prefix: str) -> Column:
    """A test's id, else its name, else ``prefix-0001`` by its place; empty ids count as missing."""
    return F.transform(cases, lambda c, i: F.coalesce(F.nullif(c["id"], F.lit("")), F.nullif(c["name"], F.lit("")), F.format_string(f"{prefix}-%04d", i + 1)))


def solutions_of(raw: Column) -> Column:
    """Distinct non-empty codes of a JSON list of strings or objects, each with its detected language."""
    v = semi.parse_jsonish(raw)
    items = F.when(semi.variant_kind(v) == "ARRAY", v.try_cast("array<variant>")).otherwise(F.array(v))
    field = lambda x, k: F.nullif(F.get_json_object(F.to_json(x), f"$.{k}"), F.lit(""))
    pick = lambda x: F.when(semi.variant_kind(x) == "STRING", F.try_variant_get(x, "$", "string")).when(semi.variant_kind(x) == "OBJECT", F.coalesce(field(x, "code"), field(x, "solution"), field(x, "text")))
    found = F.when(v.isNull(), F.array(F.when(text.strip(raw) != "", raw))).otherwise(F.transform(items, pick))
    codes = F.array_distinct(F.filter(found, lambda s: F.coalesce(s, F.lit("")) != ""))
    return F.transform(codes, lambda s: F.struct(text.detect_language(s).alias("language"), s.alias("code"), F.lit(False).alias("verified")))


def tags_of(*raw: Column) -> Column:
    """The ordered union of several JSON-ish tag columns."""
    return semi.distinct_union(*[semi.list_text(c) for c in raw])


def from_offset(df: DataFrame, offset: int, index: str = "row_index") -> DataFrame:
    """Raw rows from an index on; the indices stay."""
    return df.where(F.col(index) >= offset)


def convert(df: DataFrame, index: str = "row_index", ratio: float = 0.7, min_tests: int = 2, max_repair: int = 20, max_eval: int = 10, prefix: str = "set", default_source: str = "raw", include_function_tasks: bool = False, target_language: str = "cpp17") -> DataFrame:
    """Row index, skip_reason (null: kept) and the bundle structs problem, tests, oracle.

    The rules are asked in order: tests that are no JSON object, function tasks, too few or unequal
    tests, no solution. Missing columns of the raw schema must be supplied as nulls. A row that fails
    otherwise is skipped as conversion_error (C5): tests too deeply nested to be read, or limits that name a
    number which is none for its type.
    """
    io = semi.parse_jsonish(F.col("input_output"))
    raw = lambda k: F.get_json_object(F.col("input_output"), f"$.{k}")
    part = lambda k: F.coalesce(semi.texts_of_json_array(raw(k)), F.array().cast("array<string>"))
    staged = df.select(
        "*", (semi.variant_kind(io) == "OBJECT").alias("_is_object"), F.coalesce(F.get_json_object("input_output", "$.fn_name"), F.lit("")).alias("_fn"),
        part("inputs").alias("_in"), part("outputs").alias("_out"), semi.json_size(raw("inputs")).alias("_ni"), semi.json_size(raw("outputs")).alias("_no"), solutions_of(F.col("solutions")).alias("_sol"),
    )
    reason = (
        F.when(~F.coalesce("_is_object", F.lit(False)), "bad_tests")
        .when((F.col("_fn") != "") & F.lit(not include_function_tasks), "function_task")
        .when((F.col("_ni") < min_tests) | (F.col("_ni") != F.col("_no")), "bad_tests")
        .when(F.coalesce(F.size("_sol"), F.lit(0)) < 1, "no_solution")
        .when(F.col("_ni") < 2, "bad_tests")
        .when((F.size("_in") != F.col("_ni")) | (F.size("_out") != F.col("_no")) | text.limit_overflows("time_limit", "double") | text.limit_overflows("memory_limit", "int"), "conversion_error")
    )
    repair, evals = split_cases(semi.zip_cases(F.col("_in"), F.col("_out")), ratio, max_repair, max_eval)
    title = F.coalesce(F.nullif("name", F.lit("")), F.format_string("Problem %d", F.col(index)))
    verified = F.filter("_sol", lambda s: (s["language"] == "cpp17") & s["verified"])
    statement = F.coalesce("question", F.lit(""))
    problem = F.struct(
        text.slug(F.concat(F.lit(f"{prefix}_"), F.col(index).cast("string"), F.lit("_"), title)).alias("id"), title.alias("title"), statement.alias("statement"), F.lit("").alias("input_format"), F.lit("").alias("output_format"),
        text.constraint_lines(statement).alias("constraints"), F.lit(target_language).alias("language"), text.parse_time_limit("time_limit").alias("time_limit_sec"), text.parse_memory_limit("memory_limit").alias("memory_limit_mb"),
    )
    oracle = F.struct(
        F.coalesce("difficulty", F.lit("")).alias("difficulty"), tags_of(F.col("tags"), F.col("raw_tags"), F.col("skill_types")).alias("tags"),
        text.expected_complexity(text.first_non_empty("Expected Time Complexity", "expected_time_complexity"), text.first_non_empty("Expected Auxiliary Space", "expected_space_complexity")).alias("expected_complexity"),
        F.coalesce(F.try_element_at(verified, F.lit(1))["code"], F.lit("")).alias("reference_solution"), F.col("_sol").alias("solutions"), F.coalesce(F.nullif("source", F.lit("")), F.lit(default_source)).alias("source"), F.coalesce("url", F.lit("")).alias("url"),
    )
    out = staged.select(index, reason.alias("skip_reason"), problem.alias("problem"), F.struct(repair.alias("repair_tests"), evals.alias("eval_tests")).alias("tests"), oracle.alias("oracle"))
    kept = F.col("skip_reason").isNull()
    return out.select(index, "skip_reason", *[F.when(kept, F.col(c)).alias(c) for c in ("problem", "tests", "oracle")])


OUTCOMES = ("written", "function_task", "bad_tests", "no_solution", "conversion_error")


def manifest(converted: DataFrame) -> DataFrame:
    """Written and skipped rows by reason."""
    return converted.groupBy(F.coalesce("skip_reason", F.lit("written")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def coerce_bundle(df: DataFrame) -> DataFrame:
    """S3: defaults of missing optional fields, tests with ids, solutions without code dropped; required fields must be there."""
    p, t, o = F.col("problem"), F.col("tests"), F.col("oracle")
    need = lambda c, n: F.when(c.isNull(), F.raise_error(F.lit(f"missing required field {n}"))).otherwise(c)
    problem = F.struct(
        need(p["id"], "problem.id").alias("id"), need(p["title"], "problem.title").alias("title"), need(p["statement"], "problem.statement").alias("statement"), F.coalesce(p["input_format"], F.lit("")).alias("input_format"), F.coalesce(p["output_format"], F.lit("")).alias("output_format"),
        F.coalesce(p["constraints"], F.array().cast("array<string>")).alias("constraints"), F.coalesce(p["language"], F.lit("cpp17")).alias("language"), F.coalesce(p["time_limit_sec"], F.lit(2.0)).alias("time_limit_sec"), F.coalesce(p["memory_limit_mb"], F.lit(256)).alias("memory_limit_mb"),
    )
    def side(cases: Column, prefix: str) -> Column:
        some = F.coalesce(cases, F.array().cast("array<struct<id:string,name:string,stdin:string,expected_stdout:string,timeout_sec:double>>"))
        return F.transform(F.arrays_zip(some.alias("c"), case_ids(some, prefix).alias("i")), lambda z: F.struct(z["i"].alias("id"), z["c"]["stdin"].alias("stdin"), z["c"]["expected_stdout"].alias("expected_stdout"), z["c"]["timeout_sec"].alias("timeout_sec")))
    sols = F.filter(F.coalesce(o["solutions"], F.array().cast("array<struct<language:string,code:string,verified:boolean>>")), lambda s: F.coalesce(s["code"], F.lit("")) != "")
    sols = F.transform(sols, lambda s: F.struct(F.coalesce(s["language"], F.lit("")).alias("language"), s["code"].alias("code"), F.coalesce(s["verified"], F.lit(False)).alias("verified")))
    text_of = lambda n: F.coalesce(o[n], F.lit("")).alias(n)
    oracle = F.struct(text_of("difficulty"), F.coalesce(o["tags"], F.array().cast("array<string>")).alias("tags"), text_of("expected_complexity"), text_of("reference_solution"), sols.alias("solutions"), text_of("source"), text_of("url"))
    return df.withColumns({"problem": problem, "tests": F.struct(side(t["repair_tests"], "repair").alias("repair_tests"), side(t["eval_tests"], "eval").alias("eval_tests")), "oracle": oracle})


def spec_only(df: DataFrame) -> DataFrame:
    """What a generator may see: the problem and its repair tests; never the oracle, never held-out tests."""
    return df.select("problem", F.col("tests.repair_tests").alias("repair_tests"))


def replace_solutions(df: DataFrame, solutions: Column, reference: Column | None = None) -> DataFrame:
    """New solutions (and reference) in the oracle, everything else as it was."""
    oracle = F.col("oracle").withField("solutions", solutions)
    return df.withColumn("oracle", oracle.withField("reference_solution", reference) if reference is not None else oracle)
