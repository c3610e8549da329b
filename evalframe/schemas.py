"""Explicit schemas of the nested documents."""

from __future__ import annotations

from pyspark.sql.types import StructType

_CASE = "ARRAY<STRUCT<id: STRING, name: STRING, stdin: STRING, expected_stdout: STRING, timeout_sec: DOUBLE>>"
_COMPLEXITY = "STRUCT<time_complexity: STRING, space_complexity: STRING, dominant_variables: MAP<STRING, BIGINT>, estimated_operations: DECIMAL(38,0), estimated_memory_bytes: DECIMAL(38,0)>"
_VERDICT = "STRUCT<time_status: STRING, memory_status: STRING, estimated_operations: DECIMAL(38,0), operation_budget: BIGINT, estimated_memory_bytes: DECIMAL(38,0), memory_budget_bytes: BIGINT, reasons: ARRAY<STRING>>"
_RUN = "STRUCT<test_id: STRING, suite: STRING, passed: BOOLEAN, expected: STRING, actual: STRING, stderr: STRING, timed_out: BOOLEAN>"
_CANDIDATE = f"STRUCT<compiled: BOOLEAN, compile_error: STRING, tests: ARRAY<{_RUN}>>"

#: one problem bundle a document
BUNDLE = (
    "problem STRUCT<id: STRING, title: STRING, statement: STRING, input_format: STRING, output_format: STRING, constraints: ARRAY<STRING>, language: STRING, time_limit_sec: DOUBLE, memory_limit_mb: INT>, "
    f"tests STRUCT<repair_tests: {_CASE}, eval_tests: {_CASE}>, "
    "oracle STRUCT<difficulty: STRING, tags: ARRAY<STRING>, expected_complexity: STRING, reference_solution: STRING, "
    "solutions: ARRAY<STRUCT<language: STRING, code: STRING, verified: BOOLEAN>>, source: STRING, url: STRING>"
)
#: one problem of an evaluation report
RESULT = (
    "problem_id STRING, status STRING, attempts INT, explanation STRING, failure_reason STRING, diagnostic_summary STRING, code_preview STRING, "
    f"complexity {_COMPLEXITY}, resource_verdict {_VERDICT}, "
    f"attempt_records ARRAY<STRUCT<attempt: INT, complexity: {_COMPLEXITY}, resource_verdict: {_VERDICT}, generated_code: STRING, repair_result: {_CANDIDATE}>>, "
    f"held_out_result {_CANDIDATE}, traces ARRAY<STRUCT<attempt: INT, stage: STRING, message: STRING>>"
)
REPORT = f"metadata MAP<STRING, STRING>, problems ARRAY<STRUCT<{RESULT}>>"
#: one candidate with its tests, for the sandbox
CANDIDATE = f"candidate_id STRING, code STRING, tests {_CASE}, timeout_sec DOUBLE, suite STRING"
CANDIDATE_RESULT = f"candidate_id STRING, compiled BOOLEAN, compile_error STRING, tests ARRAY<{_RUN}>"


def struct_type(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)
