import json

import pytest
from pyspark.sql import functions as F

from evalframe.operators import curate, diagnose, formatcheck, incremental, limits, loop, metrics, sandbox, training
from evalframe.schemas import RESULT, struct_type
from evalframe.sources import bundles as src, reports


def run(test_id="t", passed=False, expected="1", actual="2", timed_out=False):
    return {"test_id": test_id, "suite": "repair", "passed": passed, "expected": expected, "actual": actual, "stderr": "", "timed_out": timed_out}


def cand(compiled=True, *tests):
    return {"compiled": compiled, "compile_error": None, "tests": list(tests)}


def result(i, status="FAILED", reason=None, cands=(), held=None, attempts=None, time="PASS", memory="PASS", explanation=None, code=None):
    records = [{"attempt": k + 1, "complexity": None, "resource_verdict": {"time_status": time, "memory_status": memory}, "generated_code": code, "repair_result": c} for k, c in enumerate(cands)]
    return {"problem_id": i, "status": status, "attempts": len(records) if attempts is None else attempts, "explanation": explanation, "failure_reason": reason, "diagnostic_summary": "d", "resource_verdict": {"time_status": time, "memory_status": memory}, "attempt_records": records, "held_out_result": held, "traces": []}


@pytest.fixture(scope="module")
def frame(spark):
    schema = struct_type(RESULT)
    return lambda rows: spark.read.schema(schema).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows] or ["x"]), mode="DROPMALFORMED") if rows else spark.createDataFrame([], schema)


def test_summary(frame):
    rows = [
        result("a", "SOLVED", cands=[cand(False), cand(True, run(passed=True))], held=cand(True, run(passed=True), run()), explanation="x"),
        result("b", reason="COMPILE_FAILED", cands=[None, cand(False)], time="FAIL"),
        result("c", status=None, time="UNKNOWN", memory="FAIL"),
        result("d", "SOLVED", cands=[cand(True)], attempts=None),
    ]
    s = metrics.summarize(frame(rows)).first()
    assert (s.num_problems, s.initial_compile_rate, s.final_compile_rate) == (4, 0.25, 0.5)
    assert (s.repair_test_pass_rate, s.held_out_test_pass_rate, s.verified_success_rate, s.avg_repair_turns) == (0.25, 0.125, 0.5, 0.5)
    assert (s.theoretical_tle_rate, s.theoretical_mle_rate, s.complexity_unknown_rate, s.explanation_success_rate) == (0.25, 0.25, 0.25, 0.5)
    assert {r.failure_reason: r.n for r in metrics.failure_breakdown(frame(rows)).collect()} == {"COMPILE_FAILED": 1}


def test_empty_summary(frame):
    s = metrics.summarize(frame([])).first()
    assert s.num_problems == 0 and all(v == 0 for v in s)


@pytest.mark.parametrize("row, want", [
    (dict(reason="THEORETICAL_TLE"), "THEORETICAL_TLE"), (dict(), "NO_CANDIDATE"), (dict(reason="X"), "X"), (dict(cands=[cand(False)]), "COMPILE_ERROR"),
    (dict(cands=[cand(True, run(), run(timed_out=True))]), "TIMEOUT"), (dict(reason="HELD_OUT_TEST_FAILED", cands=[cand(True, run(passed=True))]), "HELD_OUT_FAILED"),
    (dict(cands=[cand(True)], held=cand(True, run(timed_out=True))), "HELD_OUT_TIMEOUT"), (dict(cands=[cand(True)], held=cand(True, run())), "HELD_OUT_FAILED"), (dict(cands=[cand(True)]), "UNKNOWN_FAILURE"),
    (dict(cands=[cand(True, run(actual=""))]), "EMPTY_OUTPUT"), (dict(cands=[cand(True, run(expected=""))]), "EXTRA_OUTPUT"), (dict(cands=[cand(True, run(expected="1 2", actual="1\n2"))]), "OUTPUT_FORMAT"),
    (dict(cands=[cand(True, run())]), "WRONG_ANSWER"), (dict(cands=[cand(True, run(expected="1", actual="1"))]), "WRONG_ANSWER"), (dict(cands=[cand(True, run(actual="")), None]), "EMPTY_OUTPUT"),
])
def test_category(frame, row, want):
    assert diagnose.failures(frame([result("a", **row)])).first().category == want


def test_examples_and_histogram(frame):
    rows = [result(f"p{i}", cands=[cand(i % 2 == 0, run())]) for i in range(8)]
    failed = diagnose.failures(frame(rows))
    ex = diagnose.first_examples(failed, ["problem_id"], 2).collect()
    assert sorted((e.category, e.example, e.problem_id) for e in ex) == [("COMPILE_ERROR", 1, "p1"), ("COMPILE_ERROR", 2, "p3"), ("WRONG_ANSWER", 1, "p0"), ("WRONG_ANSWER", 2, "p2")]
    hist = metrics.ordered_histogram(failed, "category", F.col("problem_id")).orderBy("rank").collect()
    assert [(h.category, h.n) for h in hist] == [("WRONG_ANSWER", 4), ("COMPILE_ERROR", 4)]
    text = reports.failure_markdown(frame(rows), ["problem_id"])
    assert "| WRONG_ANSWER | 4 |" in text and "- Failed: 8" in text


@pytest.mark.parametrize("row, want", [
    (dict(), "NO_CANDIDATE"), (dict(cands=[None], time="FAIL"), "THEORETICAL_TLE"), (dict(cands=[None], memory="FAIL"), "THEORETICAL_MLE"), (dict(cands=[None]), "RESOURCE_CHECK_FAILED"), (dict(cands=[cand(False)]), "COMPILE_FAILED"),
    (dict(cands=[cand(True, run(timed_out=True))]), "REPAIR_TEST_TIMEOUT"), (dict(cands=[cand(True, run())]), "REPAIR_TEST_FAILED"),
])
def test_agent_reason(frame, row, want):
    assert frame([result("a", **row)]).select(diagnose.agent_failure_reason(F.col("attempt_records")).alias("x")).first().x == want


@pytest.mark.parametrize("n, k", [(2, 1), (3, 2), (5, 4), (10, 7), (15, 10), (100, 70)])
def test_split_point(spark, n, k):
    assert spark.range(1).select(curate.split_point(F.lit(n)).alias("k")).first().k == k


RAW = "row_index long, name string, question string, input_output string, solutions string, difficulty string, tags string, raw_tags string, skill_types string, source string, url string, time_limit string, memory_limit string, `Expected Time Complexity` string, `Expected Auxiliary Space` string, expected_time_complexity string, expected_space_complexity string"


def raw(i, io, sols, **kw):
    base = dict(name="N", question="Q\n1 <= n <= 5", difficulty=None, tags='["a","b"]', raw_tags="b", skill_types=None, source=None, url=None, time_limit="1.5 s", memory_limit="", ett=None, eas=None, et="O(n)", es="O(1)") | kw
    return (i, base["name"], base["question"], io, sols, *[base[k] for k in ("difficulty", "tags", "raw_tags", "skill_types", "source", "url", "time_limit", "memory_limit", "ett", "eas", "et", "es")])


def test_convert(spark):
    io = lambda n, m=None, fn=None: json.dumps({"inputs": [str(i) for i in range(n)], "outputs": [[i] for i in range(n if m is None else m)]} | ({"fn_name": fn} if fn else {}))
    sols = json.dumps(["#include <x>", "#include <x>", {"code": "def f(): pass"}, {"code": "", "text": "t"}, ""])
    rows = [raw(0, io(10), sols), raw(1, "nope", sols), raw(2, io(3, fn="f"), sols), raw(3, io(1), sols), raw(4, io(3, 2), sols), raw(5, io(3), "[]"), raw(6, None, sols), raw(7, io(2), "int main(){}", name=None, tags="x,y")]
    out = {r.row_index: r for r in curate.convert(spark.createDataFrame(rows, RAW)).collect()}
    assert [out[i].skip_reason for i in range(8)] == [None, "bad_tests", "function_task", "bad_tests", "bad_tests", "no_solution", "bad_tests", None]
    b = out[0]
    assert (b.problem.id, b.problem.time_limit_sec, b.problem.memory_limit_mb, b.problem.constraints) == ("set_0_n", 1.5, 256, ["1 <= n <= 5"])
    assert len(b.tests.repair_tests) == 7 and len(b.tests.eval_tests) == 3 and b.tests.eval_tests[0].expected_stdout == "[7]"
    assert [(s.language, s.code) for s in b.oracle.solutions] == [("cpp17", "#include <x>"), ("python3", "def f(): pass"), ("unknown", "t")]
    assert b.oracle.tags == ["a", "b"] and b.oracle.expected_complexity == "O(n), O(1)" and b.oracle.source == "raw"
    assert out[7].problem.title == "Problem 7" and out[7].oracle.tags == ["x,y", "b"] and out[7].oracle.solutions[0].code == "int main(){}"
    assert {r.outcome: r.n for r in curate.manifest(curate.convert(spark.createDataFrame(rows, RAW))).collect()} == {"written": 2, "bad_tests": 4, "function_task": 1, "no_solution": 1}


def test_bundles_round_trip(spark, tmp_path):
    full = {"problem": {"id": "b", "title": "T", "statement": "S"}, "tests": {"repair_tests": [{"stdin": "1", "expected_stdout": "1"}, {"id": "", "name": "x", "stdin": "", "expected_stdout": ""}]}, "oracle": {"solutions": [{"language": "cpp17", "code": ""}, {"code": "c", "language": "cpp17"}]}}
    for name, doc in (("b.json", full), ("a.json", full | {"problem": full["problem"] | {"id": "a"}}), ("_manifest.json", {"n": 1})):
        (tmp_path / name).write_text(json.dumps(doc))
    rows = src.read_bundles(spark, str(tmp_path)).orderBy("file_ord").collect()
    assert [(r.file_name, r.file_ord, r.problem.id) for r in rows] == [("a.json", 1, "a"), ("b.json", 2, "b")]
    assert [t.id for t in rows[0].tests.repair_tests] == ["repair-0001", "x"] and len(rows[0].oracle.solutions) == 1 and rows[0].problem.time_limit_sec == 2.0 and rows[0].tests.eval_tests == []
    src.write_bundles(src.read_bundles(spark, str(tmp_path)), str(tmp_path / "out"))
    again = src.read_bundles(spark, str(tmp_path / "out")).orderBy("file_ord").collect()
    assert [(r.problem, r.tests, r.oracle) for r in again] == [(r.problem, r.tests, r.oracle) for r in rows]
    (tmp_path / "c.json").write_text(json.dumps({"problem": {"id": "c", "title": "T"}}))
    with pytest.raises(Exception, match="problem.statement"):
        src.read_bundles(spark, str(tmp_path / "c.json")).collect()
    assert curate.spec_only(src.read_bundles(spark, str(tmp_path / "b.json"))).columns == ["problem", "repair_tests"]


def test_reports(spark, tmp_path):
    for i, rows in enumerate(([result("a", "SOLVED")], [result("b"), None, result("c", reason="X")])):
        (tmp_path / f"r{i}.json").write_text(json.dumps({"problems": rows}))
    got = src.read_reports(spark, [str(tmp_path / "r1.json"), str(tmp_path / "r0.json")])
    assert [(r.report_ord, r.prob_pos, r.problem_id) for r in got.orderBy("report_ord", "prob_pos").collect()] == [(0, 0, "b"), (0, 2, "c"), (1, 0, "a")]
    assert reports.summary(got)["failure_breakdown"] == {"X": 1}


def test_failure_pairs(spark):
    b = spark.createDataFrame([("p", 1, "old", "A", "good"), ("p", 2, "P", "A", "good"), ("q", 3, "P", "A", "")], "problem_id string, bundle_ord int, prompt string, answer string, cpp string")
    rows = [(1, "p", "COMPILE_FAILED", "bad"), (2, "p", "COMPILE_FAILED", "bad  \n"), (3, "p", "OTHER", "bad"), (4, "z", "COMPILE_FAILED", "bad"), (5, "q", "COMPILE_FAILED", "bad"), (6, "p", "COMPILE_FAILED", ""), (7, "p", "COMPILE_FAILED", "good \n"), (8, None, "COMPILE_FAILED", "x"), (9, "p", "COMPILE_FAILED", "new")]
    f = spark.createDataFrame(rows, "ord int, problem_id string, failure_reason string, failed_code string").withColumns({"time_complexity": F.lit(""), "space_complexity": F.lit("O(1)"), "diagnostic_summary": F.lit(None).cast("string")})
    out = training.failure_pairs(f, b, ["ord"])
    assert {r.ord: r.outcome for r in out.collect()} == {1: "written", 2: "skipped_duplicate", 3: "skipped_failure_reason", 4: "skipped_no_problem", 5: "skipped_no_verified_cpp", 6: "skipped_no_failed_code", 7: "skipped_same_as_chosen", 8: "skipped_no_problem", 9: "written"}
    first = training.pair_records(out).where("rejected like '%bad%'").first()
    assert first.prompt == "P" and "Time Complexity: unknown\nSpace Complexity: O(1)\n```cpp\nbad\n```" in first.rejected


def test_solution_picks(spark):
    df = spark.sql("select array(named_struct('language','cpp17','code','u','verified',false), named_struct('language','python3','code','p','verified',true), named_struct('language','cpp17','code','v','verified',true)) s, 'ref' r")
    row = df.select(training.best_solution(F.col("s"), F.col("r")).alias("a"), training.best_solution(F.slice("s", 1, 2), F.col("r")).alias("b"), training.training_solution(F.slice("s", 1, 2), F.col("r")).alias("c"), training.best_solution(F.col("s"), F.col("r"), "java").alias("d"), training.has_verified_cpp(F.slice("s", 1, 2)).alias("e")).first()
    assert tuple(row) == ("v", "u", "ref", "", False)


@pytest.mark.parametrize("limit, want", [(1, [0, 1]), (2, [0, 1, 2, 3]), (9, list(range(10))), (0, list(range(10)))])
def test_limit_on_success(spark, limit, want, monkeypatch):
    monkeypatch.setattr(limits, "BLOCK", 3)
    got = limits.limit_on_success(spark.range(10), "id", F.col("id") % 2 == 1, limit).orderBy("id").collect()
    assert [r.id for r in got] == want


def test_resume(spark, tmp_path):
    assert incremental.load_results(spark, str(tmp_path / "none"), "problem_id string").count() == 0
    todo = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "problem_id string, o int")
    incremental.append(spark.createDataFrame([("a",), (None,)], "problem_id string"), str(tmp_path / "done"))
    done = incremental.load_results(spark, str(tmp_path / "done"), "problem_id string")
    assert [r.problem_id for r in incremental.remaining(todo, done, order="o", limit=2).collect()] == ["b"]
    assert incremental.merged(done, todo).count() == 5


def test_format_rates(spark):
    df = spark.createDataFrame([("a", "Solution Explanation:中\nTime Complexity:\nSpace Complexity:\n```cpp\n```"), ("b", None)], "problem_id string, completion string")
    r = formatcheck.rates(formatcheck.score(df)).first()
    assert tuple(r) == (2, 0.5, 0.5, 0.5, 0.5)
    assert formatcheck.rates(formatcheck.score(df.limit(0))).first().format_valid_rate == 0.0


CASES = "array(named_struct('id','a','name',cast(null as string),'stdin','2\\n','expected_stdout','4\\n','timeout_sec',cast(null as double)))"


@pytest.mark.parametrize("code, want", [
    ("print(int(input())**2)", (True, True, False)), ("print('4  ')", (True, True, False)), ("import sys; sys.stdout.buffer.write(b'\\xff')", (True, False, False)), ("print(4)\nraise SystemExit(1)", (True, False, False)),
    ("print(", (False, None, None)), ("print('part', flush=True)\nwhile True: pass", (True, False, True)), (None, (True, False, False)),
])
def test_sandbox(spark, code, want):
    df = spark.createDataFrame([("c", code)], "candidate_id string, code string").select("*", F.expr(CASES).alias("tests"), F.lit(1.0).alias("timeout_sec"), F.lit("repair").alias("suite"))
    r = sandbox.evaluate(df, memory_mb=1024).first()
    assert (r.compiled, r.tests[0].passed if r.tests else None, r.tests[0].timed_out if r.tests else None) == want


def test_missing_compiler(spark):
    df = spark.createDataFrame([("c", "int main(){}")], "candidate_id string, code string").select("*", F.expr(CASES).alias("tests"), F.lit(1.0).alias("timeout_sec"), F.lit("repair").alias("suite"))
    r = sandbox.evaluate(df, language="cpp17", compiler="no-such-compiler").first()
    assert not r.compiled and r.tests == [] and r.compile_error


def test_first_passing(spark):
    rows = [("g", 1, "g1", "print(0)"), ("g", 2, "g2", "print(4)"), ("g", 3, "g3", "print(4)"), ("h", 1, "h1", "print(1)")]
    df = spark.createDataFrame(rows, "grp string, pos int, candidate_id string, code string").select("*", F.expr(CASES).alias("tests"), F.lit(1.0).alias("timeout_sec"))
    got = sandbox.first_passing(df, "grp", "pos", rounds=2, memory_mb=1024)
    assert {r.grp: r.passed_at for r in got.collect()} == {"g": 2, "h": None}


def test_repair_loop(spark):
    rows = {r.problem_id: r for r in loop.demonstration(spark).collect()}
    assert {k: (r.status, r.attempts, r.failure_reason) for k, r in rows.items()} == {
        "first": ("SOLVED", 1, None), "second": ("SOLVED", 2, None), "never": ("FAILED", 4, "REPAIR_TEST_FAILED"), "overfit": ("FAILED", 1, "HELD_OUT_TEST_FAILED"), "slow": ("SOLVED", 3, None), "untested": ("FAILED", 0, "MISSING_REPAIR_TESTS"),
    }
    assert all(r.code is None for r in rows.values() if r.status == "FAILED")
    assert "2 5" not in rows["overfit"].diagnostic_summary and "1/1" in rows["overfit"].diagnostic_summary
