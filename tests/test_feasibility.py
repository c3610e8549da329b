import pytest
from pyspark.sql import functions as F

from evalframe.functions import feasibility as f


@pytest.mark.parametrize("lines, bounds", [
    (["1 <= n <= 100000"], {"n": 100000}), (["n <= 2e5", "n <= 10"], {"n": 200000}), (["1 <= n m <= 7"], {"n": 7, "m": 7}), (["n <= 100,000"], {"n": 100}), (["n <= 10^5"], {"n": 10}), (["n ≤ 5", "n < 5"], {}), (None, {}),
    (["n <= m <= 100"], {"m": 100}),
])
def test_bounds(spark, lines, bounds):
    df = spark.createDataFrame([(lines,)], "c array<string>")
    assert df.select(f.variable_bounds(F.col("c")).alias("b")).first().b == bounds


@pytest.mark.parametrize("complexity, value", [
    ("O(1)", 1), ("O(n)", 1000), ("O(n^2)", 10**6), ("O(n log n)", 9966), ("O(n²)", 10**6), ("O(n + m)", 1020), ("O(n * m)", 20000), ("O(2^m)", 2**20), ("O(m!)", 2432902008176640000), ("O(n!)", None), ("O(2^n)", None),
    ("O(k)", None), ("O(log k)", None), ("O(sqrt(n))", None), ("unknown", None), ("O(3 n)", 3000), ("time O(n)", 1000),
])
def test_estimate(spark, complexity, value):
    df = spark.createDataFrame([(complexity, {"n": 1000, "m": 20})], "c string, b map<string,bigint>").withColumn("e", f.expression_of(F.col("c")))
    got = df.select(f.estimate(F.col("e"), F.col("b")).alias("x")).first().x
    assert got == value if value is None else got == pytest.approx(value)


@pytest.mark.parametrize("code, size", [
    ("int a[100][n];", 4 * 100 * 1000), ("vector<long long> v(n);", 8000), ("vector<vector<int>> d(n, vector<int>(m, 0));", 4 * 1000 * 20), ("int a[k];", None), ("int x;", None), ("char s[10]; double d[2];", 26),
])
def test_code_memory(spark, code, size):
    df = spark.createDataFrame([(code, {"n": 1000, "m": 20})], "c string, b map<string,bigint>")
    assert df.select(f.code_memory(F.col("c"), F.col("b")).alias("x")).first().x == size


@pytest.mark.parametrize("bound, complexity, code, want", [
    ("n <= 10000", "O(n^2)", "", ("PASS", "UNKNOWN")), ("n <= 100000", "O(n^2)", "", ("FAIL", "UNKNOWN")), ("n <= 5", "unknown", "int a[10000][10000];", ("UNKNOWN", "FAIL")), ("n <= 5", "O(log q)", "", ("UNKNOWN", "UNKNOWN")),
    ("n <= 100000", "O(n^99)", "", ("FAIL", "UNKNOWN")),
])
def test_verdict(spark, bound, complexity, code, want):
    df = spark.createDataFrame([([bound], 1.0, 256, complexity, "unknown", code)], "c array<string>, t double, m int, tc string, sc string, code string")
    v = f.add_resource_verdict(df, "c", "t", "m", "tc", "sc", "code").first().resource_verdict
    assert (v.time_status, v.memory_status) == want and v.operation_budget == 100_000_000
    assert len(v.reasons) == sum(x != "PASS" for x in want)


def test_declared_values_win(spark):
    df = spark.createDataFrame([(["n <= 10"], 1.0, 1, "O(n)", "O(n)", "", {"N": 10**9})], "c array<string>, t double, m int, tc string, sc string, code string, d map<string,bigint>")
    v = f.add_resource_verdict(df, "c", "t", "m", "tc", "sc", "code", declared_bounds="d").first().resource_verdict
    assert (v.time_status, v.memory_status) == ("FAIL", "FAIL")
