"""Training-set construction: prompts, gold answers, supervised, preference and reward records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evalframe.functions.text import complexity_fields, general_number, normalize_code, strip

# Wording of prompts and records.
INSTRUCTION = (
    "Solve the algorithm problem using C++17 within the stated resource limits. The Solution Explanation section must be written in Chinese. "
    "Use this exact response structure:\nSolution Explanation:\n...\nTime Complexity: O(...)\nSpace Complexity: O(...)\n```cpp\n...\n```"
)
REWARD_CONTRACT = "resource feasibility + compile + repair tests + held-out tests"
CLOSING = "Return a C++17 solution and structured time/space complexity analysis."
PLACEHOLDER_REJECT = (
    "Solution Explanation:\n该候选代码未能稳定通过验证，不应作为优先答案。\nTime Complexity: unknown\nSpace Complexity: unknown\n"
    "```cpp\n#include <bits/stdc++.h>\nusing namespace std;\nint main(){return 0;}\n```"
)
REJECT_EXPLANATION = "该候选代码未通过测试验证，说明其算法、边界处理或输出格式存在问题，不应作为优先答案。"
EXPLAIN_TAGS = ("根据题意分析输入规模和输出要求，结合 ", " 等算法思想设计解法。实现时需要按照题目给定的输入格式读取数据，并严格输出要求的结果。")
EXPLAIN_PLAIN = "根据题意推导需要计算的目标，按照约束选择能在时间和空间限制内通过的方法。实现时需要准确处理输入输出格式和边界情况。"
STRUCTURE = "Use this exact response structure:\nWrite Solution Explanation in Chinese.\nSolution Explanation:\n...\n\nTime Complexity: O(...)\nSpace Complexity: O(...)\n```cpp\n...\n```"
ATTEMPT, FEEDBACK = "\nAttempt: ", "\nPrevious attempt feedback:\n"
DEFAULT_REASONS = ("REPAIR_TEST_FAILED", "COMPILE_FAILED", "REPAIR_TEST_TIMEOUT", "HELD_OUT_TEST_FAILED")


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def prompt(p: dict[str, Column]) -> Column:
    """The prompt of a problem, from its specification only. Nulls take the defaults of the bundle schema."""
    lines = F.array_join(F.transform(F.coalesce(p["constraints"], F.array().cast("array<string>")), lambda c: F.concat(F.lit("- "), c)), "\n")
    return F.concat(
        F.lit("Title: "), _text(p["title"]), F.lit("\n\n"), _text(p["statement"]), F.lit("\n\nInput format:\n"), _text(p["input_format"]),
        F.lit("\n\nOutput format:\n"), _text(p["output_format"]), F.lit("\n\nConstraints:\n"), lines,
        F.lit("\n\nLanguage: "), F.coalesce(p["language"], F.lit("cpp17")), F.lit("\nTime limit: "), general_number(F.coalesce(p["time_limit_sec"], F.lit(2.0))),
        F.lit(" seconds\nMemory limit: "), F.coalesce(p["memory_limit_mb"], F.lit(256)).cast("string"), F.lit(" MB\n\n" + CLOSING),
    )


def generation_prompt(prompt_text: Column, feedback: Column, attempt: Column) -> Column:
    """The prompt of one attempt: the response structure, and at most 4000 characters of feedback."""
    told = F.when(F.coalesce(feedback, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit(FEEDBACK), F.substring(feedback, 1, 4000), F.lit("\n")))
    return F.concat(prompt_text, F.lit(ATTEMPT), attempt.cast("string"), F.lit(f"\n{STRUCTURE}\n"), told)


def format_prompt(prompt_text: Column) -> Column:
    """The prompt of a format check."""
    return F.concat(prompt_text, F.lit(f"\n\n{STRUCTURE}"))


def best_solution(solutions: Column, reference: Column, language: str = "cpp17") -> Column:
    """O3: verified in the language, else any in it, else (C++ only) the reference, else empty."""
    mine = F.filter(solutions, lambda s: s["language"] == language)
    ok = F.filter(mine, lambda s: F.coalesce(s["verified"], F.lit(False)))
    rest = reference if language == "cpp17" else F.lit("")
    return F.coalesce(F.try_element_at(ok, F.lit(1))["code"], F.try_element_at(mine, F.lit(1))["code"], rest, F.lit(""))


def training_solution(solutions: Column, reference: Column) -> Column:
    """Verified C++, else the reference (an unverified C++ solution is passed over)."""
    ok = F.filter(solutions, lambda s: (s["language"] == "cpp17") & F.coalesce(s["verified"], F.lit(False)))
    return F.coalesce(F.try_element_at(ok, F.lit(1))["code"], reference, F.lit(""))


def solution_picks(df: DataFrame, group: str, order: str, language: str = "language", code: str = "code", verified: str = "verified") -> DataFrame:
    """O3, O3b, O3c, F1 over a long table: for each group the first code of each kind, and how many codes there are.

    Columns: group, n, vcpp, acpp (first verified, first C++), vpy, apy. Plain aggregates that combine before
    the shuffle, so a group of any size is no list anywhere. Rows without a group or code are left out.
    """
    rows = df.where(F.col(group).isNotNull() & (F.coalesce(code, F.lit("")) != ""))
    ok = F.coalesce(verified, F.lit(False))
    first = lambda cond: F.min_by(F.when(cond, F.col(code)), F.when(cond, F.col(order)))
    cpp, py = F.col(language).eqNullSafe("cpp17"), F.col(language).eqNullSafe("python3")
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), first(cpp & ok).alias("vcpp"), first(cpp).alias("acpp"), first(py & ok).alias("vpy"), first(py).alias("apy"))


def has_verified_cpp(solutions: Column) -> Column:
    """F1."""
    return F.coalesce(F.exists(solutions, lambda s: (s["language"] == "cpp17") & F.coalesce(s["verified"], F.lit(False))), F.lit(False))


def explanation(tags: Column) -> Column:
    """P7."""
    joined = F.array_join(F.coalesce(tags, F.array().cast("array<string>")), ", ")
    return F.when(joined != "", F.concat(F.lit(EXPLAIN_TAGS[0]), joined, F.lit(EXPLAIN_TAGS[1]))).otherwise(F.lit(EXPLAIN_PLAIN))


def render_answer(why: Column, time: Column, space: Column, code: Column) -> Column:
    return F.concat(F.lit("Solution Explanation:\n"), why, F.lit("\n\nTime Complexity: "), time, F.lit("\nSpace Complexity: "), space, F.lit("\n```cpp\n"), code, F.lit("\n```"))


def gold_answer(tags: Column, expected: Column, code: Column) -> Column:
    """P6."""
    time, space = complexity_fields(F.coalesce(expected, F.lit("")))
    return render_answer(explanation(tags), time, space, code)


def rejected_answer(time: Column, space: Column, code: Column) -> Column:
    """P8."""
    known = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown"))
    return render_answer(F.lit(REJECT_EXPLANATION), known(time), known(space), strip(code))


def sft_records(bundles: DataFrame) -> DataFrame:
    """problem_id, instruction, input, output of bundles (prompt, answer, cpp) with C++ code."""
    return bundles.where(F.coalesce("cpp", F.lit("")) != "").select("problem_id", F.lit(INSTRUCTION).alias("instruction"), F.col("prompt").alias("input"), F.col("answer").alias("output"))


def template_dpo_records(bundles: DataFrame) -> DataFrame:
    """The gold answer against a constant placeholder."""
    return bundles.where(F.coalesce("cpp", F.lit("")) != "").select("problem_id", "prompt", F.col("answer").alias("chosen"), F.lit(PLACEHOLDER_REJECT).alias("rejected"))


def grpo_records(bundles: DataFrame) -> DataFrame:
    """P5: all bundles."""
    return bundles.select("problem_id", "prompt", F.lit(REWARD_CONTRACT).alias("reward_contract"))


def chat_text(system: str, instruction: Column, input_text: Column, output: Column) -> Column:
    """P10."""
    return F.concat(F.lit(f"<|im_start|>system\n{system}<|im_end|>\n<|im_start|>user\n"), instruction, F.lit("\n"), input_text, F.lit("<|im_end|>\n<|im_start|>assistant\n"), output, F.lit("<|im_end|>"))


def failure_pairs(failed: DataFrame, bundles: DataFrame, order: list[str], reasons: tuple[str, ...] = DEFAULT_REASONS) -> DataFrame:
    """Every failure with its ``outcome``: written, or why it was skipped.

    ``failed``: problem_id, failure_reason, failed_code, time_complexity, space_complexity and the order
    columns. ``bundles``: problem_id, bundle_ord, prompt, answer, cpp; of repeated ids the last one holds.
    An empty ``reasons`` lets all through. Outcomes are decided on keys alone: digests of the codes, never
    the texts, are joined and grouped, and only written rows fetch the prompt and the answer. The lookups are
    ordinary joins (their strategy is the planner's choice by size), and only rows that pass all other rules
    compete for keep-first (a minimum, so a group of any size combines before the shuffle). The order must
    be unique.
    """
    key = lambda c: F.sha2(normalize_code(c), 256)
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    of = F.struct(F.when(blank("cpp") != "", key(blank("cpp"))).alias("_cpp_key"), F.col("bundle_ord").alias("_ord"))
    last = bundles.select("problem_id", "bundle_ord", of.alias("of")).groupBy("problem_id").agg(F.max_by("of", "bundle_ord").alias("of")).select("problem_id", "of.*")
    why = blank("failure_reason")
    allowed = why.isin(*reasons) if reasons else F.lit(True)
    mine = failed.withColumns({"problem_id": blank("problem_id"), "_norm_key": F.when(blank("failed_code") != "", key(blank("failed_code"))), "_at": F.struct(*order)})
    outcome = (
        F.when(~allowed, "skipped_failure_reason").when(F.col("_ord").isNull(), "skipped_no_problem").when(F.col("_cpp_key").isNull(), "skipped_no_verified_cpp")
        .when(F.col("_norm_key").isNull(), "skipped_no_failed_code").when(F.col("_norm_key") == F.col("_cpp_key"), "skipped_same_as_chosen")
    )
    keyed = mine.join(last, "problem_id", "left").withColumn("outcome", outcome)
    able = mine.where(allowed & F.col("_norm_key").isNotNull()).select("problem_id", "_norm_key", "_at")
    firsts = able.groupBy("problem_id", "_norm_key").agg(F.min("_at").alias("_first"))
    keyed = keyed.join(firsts, ["problem_id", "_norm_key"], "left")
    final = F.coalesce("outcome", F.when(F.col("_at") == F.col("_first"), F.lit("written")).otherwise(F.lit("skipped_duplicate")))
    decided = keyed.withColumn("outcome", final).withColumn("_ord", F.when(F.col("outcome") == "written", F.col("_ord")))
    texts = bundles.select("problem_id", F.col("bundle_ord").alias("_ord"), "prompt", F.col("answer").alias("chosen"))
    return decided.join(texts, ["problem_id", "_ord"], "left").select(
        *order, "problem_id", "outcome", "prompt", "chosen",
        rejected_answer(F.col("time_complexity"), F.col("space_complexity"), blank("failed_code")).alias("rejected"), why.alias("failure_reason"), blank("diagnostic_summary").alias("diagnostic_summary"),
    )


PAIR_OUTCOMES = ("written", "skipped_no_problem", "skipped_no_verified_cpp", "skipped_no_failed_code", "skipped_duplicate", "skipped_same_as_chosen", "skipped_failure_reason")


def pair_records(pairs: DataFrame) -> DataFrame:
    return pairs.where("outcome = 'written'").select("prompt", "chosen", "rejected", "problem_id", "failure_reason", "diagnostic_summary")


def outcome_counts(df: DataFrame, outcome: str = "outcome") -> DataFrame:
    """One row an outcome."""
    return df.groupBy(outcome).agg(F.count(F.lit(1)).alias("n"))
