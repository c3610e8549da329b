"""Report and manifest sinks, and the Markdown rendering of a failure analysis."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, functions as F

from evalframe.functions.text import single_line
from evalframe.operators import diagnose, metrics


def write_json(payload: dict, path: str) -> None:
    """A small pretty JSON document; parent folders are made."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(payload, f, ensure_ascii=False, indent=2)
        f.write("\n")


def serialized(results: DataFrame) -> DataFrame:
    """Results without code, with the first 500 characters of it as a preview."""
    return results.withColumn("code_preview", F.when(F.coalesce("code", F.lit("")) != "", F.substring("code", 1, 500))).drop("code")


def summary(results: DataFrame) -> dict:
    """The summary document: the metrics and the failure breakdown in order of appearance."""
    row = metrics.summarize(results).first().asDict()
    reasons = metrics.failure_breakdown(results).orderBy("first_seen").collect()
    return row | {"failure_breakdown": {r.failure_reason: r.n for r in reasons}}


def count_table(rows: list[tuple[str, int]], label: str) -> list[str]:
    """A Markdown table of counts; one line of none when empty."""
    return [f"| {label} | Count |", "|---|---:|", *([f"| {k} | {n} |" for k, n in rows] or ["| none | 0 |"])]


def failure_markdown(results: DataFrame, order: list[str], k: int = 5, paths: list[str] | None = None) -> str:
    """Overview, a summary a report, counts by reason and category, and up to k examples a category.

    Only aggregates and examples reach the driver: one row a report, reason and category, k rows a category.
    ``paths`` names the reports by their order.
    """
    failed = diagnose.failures(results).cache()
    total = diagnose.totals(results).first()
    hist = lambda key: [(r[0], r.n) for r in metrics.ordered_histogram(failed.where(F.coalesce(key, F.lit("")) != ""), key, F.struct(*order)).orderBy("rank").collect()]
    name = lambda i: os.path.basename(paths[i]) if paths else str(i)
    categories = hist("category")
    lines = ["# Failure analysis", "", "## Overview", "", f"- Reports: {len(paths) if paths else results.select(order[0]).distinct().count()}", f"- Total problems: {total.total}", f"- Solved: {total.solved}", f"- Failed: {total.failed}"]
    lines += [f"- Verified success rate: {total.verified_success_rate:.3f}", "", "## Report Summaries", "", "| Report | Problems | Verified Success | Compile | Repair Pass | Held-out Pass |", "|---|---:|---:|---:|---:|---:|"]
    for r in metrics.summarize_by(results, order[0]).orderBy(order[0]).collect():
        lines.append(f"| {name(r[0])} | {r.num_problems} | {r.verified_success_rate:.3f} | {r.final_compile_rate:.3f} | {r.repair_test_pass_rate:.3f} | {r.held_out_test_pass_rate:.3f} |")
    lines += ["", "## Failure Reasons", "", *count_table(hist("failure_reason"), "Reason"), "", "## Diagnostic Categories", "", *count_table(categories, "Category"), "", "## Representative Examples", ""]
    flat = lambda c: single_line(F.coalesce(c, F.lit(""))).alias(c)
    shown = diagnose.first_examples(failed, order, k, keep=[order[0]])
    shown = shown.select("category", "example", "problem_id", "failure_reason", "attempts", "test_id", "timed_out", F.col(order[0]).alias("report"), "last_stage", *[flat(c) for c in ("expected", "actual", "stderr", "last_trace")]).orderBy("category", "example").collect()
    for category, _ in categories:
        lines += [f"### {category}", ""]
        for e in (x for x in shown if x.category == category):
            lines += [f"- Problem: `{e.problem_id}`", f"  - Report: `{name(e.report)}`", f"  - Failure reason: `{e.failure_reason}`", f"  - Attempts: `{e.attempts}`"]
            if e.test_id is not None or e.timed_out is not None:
                lines += [f"  - First failed test: `{e.test_id}` timed_out={e.timed_out}", f"  - Expected: `{e.expected}`", f"  - Actual: `{e.actual}`"]
                lines += [f"  - Stderr: `{e.stderr}`"] if e.stderr else []
            if e.last_stage is not None or e.last_trace:
                lines.append(f"  - Last trace: `{e.last_stage}` - {e.last_trace}")
        lines.append("")
    failed.unpersist()
    return "\n".join(lines).rstrip() + "\n"
