"""The registered queries run the dealt operators."""

import pytest
from pyspark.sql import functions as F

from evalframe.llm import queries, quota_sample as qs
from evalframe.llm.source_parse import parse_failure

META, TARGETS = "oracle_id long, difficulty string, source string, tags array<string>", "dimension string, category string, target_share double, min_rows long"


def test_p2_found_draws_the_sample(spark, tmp_path, monkeypatch):
    rows = [(i, "easy" if i % 2 else "hard", "x", ["t"]) for i in range(100)]
    spark.createDataFrame(rows, META).write.parquet(f"{tmp_path}/oracle_meta.parquet")
    spark.createDataFrame([("difficulty", "easy", 0.5, 0), ("difficulty", "none", 0.1, 1)], TARGETS).write.parquet(f"{tmp_path}/sample_targets.parquet")
    calls, drawn, quotas, counts = [], [], qs.quotas, qs._counts
    monkeypatch.setattr(qs, "quotas", lambda *a: calls.append(1) or quotas(*a))
    monkeypatch.setattr(qs, "_counts", lambda df: drawn.append(sum((got := counts(df)).values())) or got)
    assert [tuple(r) for r in queries.p2_found(spark, str(tmp_path)).collect()] == [("difficulty", "none")]
    assert calls and drawn == [100, 20]


def test_counted_report_is_of_drawn_rows(spark):
    df = spark.createDataFrame([(i, "easy", "x", ["t"]) for i in range(50)], META).withColumn("oracle_id", F.when(F.col("oracle_id") < 5, F.col("oracle_id")))
    targets = spark.createDataFrame([("difficulty", "easy", 1.0, 0)], TARGETS)
    assert [(r.need, r.sampled, r.met) for r in qs.quota_sample(df, targets, counted=True)[1].collect()] == [(10, 5, False)]


@pytest.mark.parametrize("code, at", [("try:\n    x\nexcept A, B:\n    y\n", None), ("x = 1\nf() = 2\n", 6), ("x = 1\r\nf() = 2\r\n", 7), ("def f(a=1, b):\n    pass\n", None), ("x = f'{a b}'\n", None)])
def test_python_that_the_grammar_lets_pass(code, at):
    got = parse_failure(code, "python3")
    assert got and (at is None or got == (at, False))


def test_java_try_needs_a_handler():
    body = lambda s: f"class A {{ void f() {{ {s} }} }}"
    assert parse_failure(body("try { }"), "java")
    for good in ("try { } finally { }", "try { } catch (E | F e) { }", "try { } catch (E e) { } finally { }", "try (R r = g()) { }"):
        assert parse_failure(body(good), "java") is None
