"""Whole jobs: nothing is cut before the operator sees it."""

import json

import pytest
from pyspark.sql import functions as F

from evalframe.operators import curate
from evalframe.plans import queries, views


@pytest.fixture()
def tables(spark, tmp_path):
    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")

    write("problem_specs", [(i, f"p{i}", "t", "s", "x") for i in (1, 2, 3, 17)] + [(4, None, "t", "s", "x")], "spec_id long, problem_id string, title string, statement string, source string")
    far = [(1000 * i, "p1", f"{i}", f"{i + 1}") for i in range(40)]  # no two in a block of 64 ids
    write("test_cases", far + [(7, "p2", "1", "2"), (900, "p2", "1", "2"), (8, "p3", "1", "2"), (9, "p17", None, "2"), (999, "p17", "1", "2")], "case_id long, problem_id string, stdin string, expected_stdout string")
    write("solutions", [(i, "p1", "java", f"class A{i} {{}}") for i in range(9)] + [(20, "p2", None, '{"a": 1}'), (21, "p17", "cpp17", "")], "solution_id long, problem_id string, language string, code string")
    return str(tmp_path)


def test_specifications_keep_all_tests_and_codes(spark, tables):
    got = {r.spec_id: r for r in queries.convert_bundles(spark, tables).collect()}
    assert {k: r.outcome for k, r in got.items()} == {1: "written", 2: "written", 3: "bad_tests", 4: "bad_tests", 17: "no_solution"}
    assert (got[1].repair, got[1].eval, got[1].codes) == (20, 10, 9)
    assert (got[2].repair, got[2].eval, got[2].codes) == (1, 1, 1)
    row = queries.specification_rows(spark, tables).where("row_index = 2").first()
    assert json.loads(row.input_output)["inputs"] == [str(i) for i in range(40)]
    assert {r.outcome: r.n for r in queries.convert_manifest(spark, tables).collect()} == {"written": 2, "bad_tests": 3, "no_solution": 1}


def test_code_that_is_json_text_is_a_code(spark):
    raw = [(json.dumps(['{"a": 1}', "x", {"text": "y"}, {"a": 1}, 5, "x", ""]),), ("plain {",), ("  ",), (None,)]
    got = [[s.code for s in r.c or []] for r in spark.createDataFrame(raw, "s string").select(curate.solutions_of(F.col("s")).alias("c")).collect()]
    assert got == [['{"a": 1}', "x", "y"], ["plain {"], [], []]


def test_attempts_of_a_run_do_not_depend_on_event_ids(spark, tmp_path):
    rows = [(1000 * i, 5, f"2024-01-{1 + i // 3:02d} 00:00:{59 - i:02d}", "click", 5.0, '{"k": 1}') for i in range(10)]  # within a day, ids against time
    events = spark.createDataFrame(rows, "event_id long, user_id long, t string, event_type string, value double, props string").withColumn("ts", F.to_timestamp("t")).drop("t")
    events.write.parquet(f"{tmp_path}/events.parquet")
    order = [r.event_id for r in events.orderBy("ts", "event_id").collect()]
    got = {(r.problem_id, r.attempt): r.event_id for r in views.attempts(spark, str(tmp_path)).collect()}
    assert got == {(f"u5-{i // 4}", i % 4 + 1): x for i, x in enumerate(order)}
    assert sorted(r.turns for r in queries.per_problem_rates(spark, str(tmp_path)).collect()) == [1, 3, 3]


def test_offset_skips_by_index(spark):
    assert [r.row_index for r in curate.from_offset(spark.range(5).withColumnRenamed("id", "row_index"), 3).collect()] == [3, 4]
