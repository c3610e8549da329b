"""The command line end to end, and the sources and sinks below it."""

import json
import os
import stat

import pytest
from pyspark.sql import functions as F

from evalframe import cli
from evalframe.operators import loop, metrics, sandbox
from evalframe.sources import bundles as src, reports

GOOD, BAD = "print(sum(map(int, input().split())))", "print(0)"


def case(i, a, b):
    return {"id": i, "stdin": f"{a} {b}", "expected_stdout": str(a + b)}


def bundle(name, *solutions):
    return {
        "problem": {"id": name, "title": name, "statement": "Add."}, "tests": {"repair_tests": [case("r1", 1, 2)], "eval_tests": [case("e1", 2, 5)]},
        "oracle": {"solutions": [{"language": lang, "code": code, "verified": ok} for lang, code, ok in solutions]},
    }


@pytest.fixture()
def run(spark, capsys, monkeypatch):
    monkeypatch.setattr(cli, "_spark", lambda: spark)

    def go(*args):
        cli.main([str(a) for a in args])
        return json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    return go


@pytest.fixture()
def problems(tmp_path):
    folder = tmp_path / "problems"
    folder.mkdir()
    for name, sols in {"a": [("python3", GOOD, False)], "b": [("python3", BAD, False), ("python3", GOOD, True)], "c": [("cpp17", "int main(){}", True)], "d": []}.items():
        (folder / f"{name}.json").write_text(json.dumps(bundle(name, *sols), indent=1))
    (folder / "_manifest.json").write_text('{"kept": "as it is"}')
    return folder


def test_convert_with_options(run, tmp_path):
    tests = lambda n: json.dumps({"inputs": [str(i) for i in range(n)], "outputs": ["1"] * n})
    rows = [{"name": "first", "input_output": tests(4), "solutions": '["x"]'}, {"name": "none", "input_output": "[]", "solutions": '["x"]'}, {"name": "deep", "input_output": tests(4), "solutions": '["x"]', "memory_limit": "99999999999999999999 MB"}]
    rows += [{"name": f"n{i}", "input_output": tests(30), "solutions": '["x"]'} for i in range(3)]
    (tmp_path / "raw.jsonl").write_text("\n".join(map(json.dumps, rows)))
    got = run("convert", "--input", tmp_path / "raw.jsonl", "--output", tmp_path / "out", "--offset", 1, "--limit", 2, "--max-repair-tests", 3, "--target-language", "python3")
    assert (got["written"], got["skipped"]) == (2, {"function_task": 0, "bad_tests": 1, "no_solution": 0, "conversion_error": 1})
    assert json.loads((tmp_path / "out" / "_manifest.json").read_text()) == got and got["offset"] == 1 and got["repair_ratio"] == 0.7
    made = json.loads((tmp_path / "out" / "set_3_n0.json").read_text())
    assert made["problem"]["language"] == "python3" and len(made["tests"]["repair_tests"]) == 3 and len(made["tests"]["eval_tests"]) == 9


def test_row_index_is_file_order(spark, tmp_path):
    for kind in ("json", "parquet"):
        for i in range(4):
            part = spark.createDataFrame([(10 * i + j,) for j in range(3 + i)], "x long").coalesce(1)
            getattr(part.write, kind)(str(tmp_path / f"{kind}{i}"))
        os.makedirs(tmp_path / f"all-{kind}")
        for i in range(4):
            name = next(n for n in os.listdir(tmp_path / f"{kind}{i}") if n.startswith("part"))
            os.rename(tmp_path / f"{kind}{i}" / name, tmp_path / f"all-{kind}" / f"f{i}.{kind}")
        want = [(n, x) for n, x in enumerate(10 * i + j for i in range(4) for j in range(3 + i))]
        for size in ("1000000", "134217728"):
            spark.conf.set("spark.sql.files.openCostInBytes", size)
            assert sorted((r.row_index, r.x) for r in src.read_raw(spark, str(tmp_path / f"all-{kind}")).collect()) == want
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_filter_copies_bytes(run, problems, tmp_path):
    got = run("filter", "--problems", problems, "--output", tmp_path / "kept")
    assert got == {"total": 4, "copied": 1, "skipped_no_verified_cpp": 3, "copied_manifests": 1}
    assert (tmp_path / "kept" / "c.json").read_bytes() == (problems / "c.json").read_bytes() and (tmp_path / "kept" / "_manifest.json").read_text() == '{"kept": "as it is"}'
    assert sorted(p.name for p in (tmp_path / "kept").iterdir()) == ["_manifest.json", "_verified_cpp_filter_manifest.json", "c.json"]


def test_verify_and_translate(run, problems, tmp_path):
    got = run("verify", "--problems", problems, "--output", tmp_path / "v")
    assert got == {"total": 4, "verified": 2, "no_python_solution": 2, "failed_python_solution": 0, "copied_manifests": 1}
    (tmp_path / "r.jsonl").write_text("\n".join(json.dumps({"problem_id": p, "candidate": i, "response": f"```cpp\n{c}\n```"}) for p, i, c in (("a", 0, BAD), ("a", 1, GOOD), ("b", 0, BAD))))
    got = run("translate", "--problems", tmp_path / "v", "--responses", tmp_path / "r.jsonl", "--output", tmp_path / "t", "--language", "python3")
    assert (got["attempted"], got["translated"], got["failed_translation"], got["no_verified_python"]) == (2, 1, 1, 2)
    assert json.loads((tmp_path / "t" / "a.json").read_text())["oracle"]["reference_solution"] == GOOD


def test_solve_and_evaluate(run, problems, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps({"problem_id": p, "attempt": i, "code": c, "time_complexity": "O(1)", "space_complexity": "O(1)"}) for p, i, c in (("a", 1, GOOD), ("b", 1, BAD), ("b", 2, GOOD), ("c", 1, BAD))))
    args = ("--problems", problems, "--answers", tmp_path / "a.jsonl", "--language", "python3", "--max-repair-turns", 1)
    got = run("solve", *args)
    assert {k: v["status"] for k, v in got.items()} == {"a": "SOLVED", "b": "SOLVED", "c": "FAILED", "d": "FAILED"} and got["a"]["code"] == GOOD and "code" not in got["c"]
    got = run("evaluate", *args, "--output", tmp_path / "e")
    assert got["num_problems"] == 4 and got["verified_success_rate"] == 0.5 and got["failure_breakdown"] == {"COMPILE_FAILED": 2}
    assert json.loads((tmp_path / "e" / "summary.json").read_text()) == got


def test_pairs_and_report(run, problems, tmp_path, spark):
    tests = [{"test_id": "r1", "suite": "repair", "passed": False, "expected": "3", "actual": "4", "stderr": "oh", "timed_out": False}]
    record = lambda code: [{"attempt": 1, "generated_code": code, "repair_result": {"compiled": True, "tests": tests}}]
    one = [{"problem_id": "c", "status": "FAILED", "attempts": 1, "failure_reason": "REPAIR_TEST_FAILED", "attempt_records": record(f"x{i}"), "traces": [{"attempt": 1, "stage": "repair_tests", "message": "m\nn"}]} for i in (1, 1, 2, 3)]
    (tmp_path / "one.json").write_text(json.dumps({"problems": one}))
    (tmp_path / "two.json").write_text(json.dumps({"problems": [{"problem_id": "a", "status": "SOLVED", "attempts": 1}, one[3] | {"failure_reason": "OTHER"}]}))
    got = run("pairs", "--problems", problems, "--reports", tmp_path / "one.json", tmp_path / "two.json", "--output", tmp_path / "p", "--max-records", 2)
    assert got == {"scanned_failures": 3, "written": 2, "skipped_no_problem": 0, "skipped_no_verified_cpp": 0, "skipped_no_failed_code": 0, "skipped_duplicate": 1, "skipped_same_as_chosen": 0, "skipped_failure_reason": 0}
    assert src.read_training(spark, str(tmp_path / "p" / "dpo_failures"), "prompt string, chosen string, rejected string").count() == 2
    run("analyze", "--reports", tmp_path / "one.json", tmp_path / "two.json", "--output", tmp_path / "report.md", "--examples", 1)
    text = (tmp_path / "report.md").read_text()
    for line in ("- Reports: 2", "- Verified success rate: 0.167", "| two.json | 2 | 0.500 | 0.500 | 0.000 | 0.000 |", "| REPAIR_TEST_FAILED | 4 |", "### WRONG_ANSWER", "  - First failed test: `r1` timed_out=False", "  - Stderr: `oh`", "  - Last trace: `repair_tests` - m n"):
        assert line in text.splitlines(), line


def test_compiled_programs_with_a_stand_in_compiler(spark, tmp_path):
    """A script that stands for the compiler: the 'program' is a shell script, bad source is refused."""
    fake = tmp_path / "compiler"
    fake.write_text('#!/bin/sh\ngrep -q bad "$4" && { echo "error: bad" >&2; exit 1; }\n(echo "#!/bin/sh"; cat "$4") > "$6"\nchmod +x "$6"\n')
    fake.chmod(fake.stat().st_mode | stat.S_IEXEC)
    cases = "array(named_struct('id','a','name',cast(null as string),'stdin','4\\n','expected_stdout','4','timeout_sec',cast(1 as double)))"
    df = spark.createDataFrame([("ok", "cat"), ("no", "bad"), ("wrong", "echo 5"), ("exit", "cat; exit 2")], "candidate_id string, code string").select("*", F.expr(cases).alias("tests"), F.lit(1.0).alias("timeout_sec"), F.lit("repair").alias("suite"))
    got = {r.candidate_id: (r.compiled, [t.passed for t in r.tests]) for r in sandbox.evaluate(df, "cpp17", 1024, str(fake)).collect()}
    assert got == {"ok": (True, [True]), "no": (False, []), "wrong": (True, [False]), "exit": (True, [False])}


def test_endless_output_and_children_end(tmp_path):
    code, out, _ = sandbox._call(["/bin/sh", "-c", "yes"], str(tmp_path), b"", 5.0, 512, 1)
    assert code not in (0, None) and len(out) <= 1 << 20
    mark = tmp_path / "late"
    code, _, _ = sandbox._call(["/bin/sh", "-c", f"(sleep 2; echo x > {mark}) & sleep 9"], str(tmp_path), b"", 0.3, 512)
    assert code is None
    import time

    time.sleep(2.5)
    assert not mark.exists()


def test_generator_that_says_nothing_or_too_much(spark):
    base = loop.demonstration(spark).select("problem_id")
    one = spark.createDataFrame([("p",), ("q",)], "problem_id string").select("problem_id", *[F.lit("").alias(c) for c in ("title", "statement", "input_format", "output_format")], F.array().cast("array<string>").alias("constraints"), F.lit("python3").alias("language"), F.lit(1.0).alias("time_limit_sec"), F.lit(64).alias("memory_limit_mb"), F.expr("array(named_struct('id','r','name',cast(null as string),'stdin','1 2','expected_stdout','3','timeout_sec',cast(1 as double)))").alias("repair_tests"))
    one = one.withColumn("eval_tests", F.col("repair_tests"))
    twice = lambda asked: asked.where("problem_id = 'p'").select("problem_id", F.explode(F.array(F.lit(GOOD), F.lit(GOOD + " "))).alias("code"), F.lit("O(1)").alias("time_complexity"), F.lit("O(1)").alias("space_complexity"))
    got = {r.problem_id: (r.status, r.attempts, r.failure_reason) for r in loop.solve(one, twice, max_repair_turns=1, memory_mb=1024).collect()}
    assert got == {"p": ("SOLVED", 1, None), "q": ("FAILED", 2, "COMPILE_FAILED")} and base.count() == 6


def test_summary_by_report(spark):
    df = loop.demonstration(spark).withColumn("k", F.lit(3))
    assert metrics.summarize_by(df, "k").first().num_problems == 6
    assert reports.serialized(df).where("code_preview is not null").count() == 3
