import json

import pytest
from pyspark.sql import functions as F

from evalframe.operators import loop, oracles
from evalframe.sources import bundles as src

GOOD, BAD = "print(int(input()) * 2)", "print(1)"


@pytest.fixture(scope="module")
def bundles(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("bundles")
    py = lambda code, verified=False: {"language": "python3", "code": code, "verified": verified}
    for name, sols in {"a": [py(BAD), {"language": "java", "code": "x"}, py(GOOD), py(GOOD, True)], "b": [py(BAD), py(BAD, True), py(BAD), py(GOOD)], "c": [{"language": "cpp17", "code": "y", "verified": True}], "d": [py(GOOD, True)]}.items():
        doc = {"problem": {"id": name, "title": "T", "statement": "S", "time_limit_sec": 1.0}, "tests": {"repair_tests": [{"stdin": "2", "expected_stdout": "4"}], "eval_tests": [{"stdin": "3", "expected_stdout": "6"}]}, "oracle": {"solutions": sols, "reference_solution": "r"}}
        (d / f"{name}.json").write_text(json.dumps(doc))
    return src.read_bundles(spark, str(d))


def test_verify(bundles):
    rows = {r.problem.id: r for r in oracles.verify_python(bundles, memory_mb=1024).collect()}
    assert {k: r.outcome for k, r in rows.items()} == {"a": "verified", "b": "failed_python_solution", "c": "no_python_solution", "d": "verified"}
    assert [s.verified for s in rows["a"].oracle.solutions] == [False, False, True, True]
    assert [s.verified for s in rows["b"].oracle.solutions] == [False, False, False, False]
    assert rows["c"].oracle.solutions[0].verified and rows["a"].oracle.reference_solution == "r"


def test_translate_and_keep(spark, bundles):
    prompts = bundles.select(F.col("problem.id").alias("problem_id"), F.lit("P").alias("prompt"))
    answers = spark.createDataFrame([("a", 0, f"```cpp\n{BAD}\n```"), ("a", 1, f"```cpp\n{GOOD}\n```"), ("d", 0, "no code"), ("d", 1, f"```cpp\n{BAD}\n```"), ("b", 0, f"```\n{BAD}\n```")], "problem_id string, candidate int, response string")

    def translator(asked):
        assert set(asked.columns) == {"problem_id", "candidate", "request"}
        return asked.join(answers, ["problem_id", "candidate"])
    out = oracles.translate(bundles, prompts, translator, language="python3")
    rows = {r.problem.id: r for r in out.collect()}
    assert {k: r.outcome for k, r in rows.items()} == {"a": "translated", "b": "failed_translation", "c": "no_verified_python", "d": "failed_translation"}
    assert rows["a"].oracle.reference_solution == GOOD and rows["a"].oracle.solutions[-1].verified and len(rows["a"].oracle.solutions) == 5
    kept = oracles.keep_verified(out)
    assert sorted(r.problem.id for r in kept.collect()) == ["a", "c"]
    assert [r.problem.id for r in oracles.keep_verified(out, 1).collect()] == ["a"]


def test_payload(spark):
    rows = {r.problem_id: json.loads(r.payload) for r in oracles.solve_payload(loop.demonstration(spark)).collect()}
    assert rows["first"]["code"] and "code" not in rows["never"] and rows["never"]["failure_reason"] == "REPAIR_TEST_FAILED"
