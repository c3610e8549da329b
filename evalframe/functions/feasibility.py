"""Theoretical resource feasibility: bounds from constraints, estimates from complexity strings and code.

All of it is Column expressions over a map of variable bounds; an unknown bound stays null through every
step, so it ends as UNKNOWN and never as PASS. Estimates are doubles while they are computed and compared,
so that an overflow is larger than any budget (FAIL), and decimals where they are reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

OPS_PER_SECOND = 100_000_000

# Patterns of bounds and declarations, and the bytes of each element type.
BOUND = r"\b([a-z][a-z0-9_]*)\s*<=\s*([0-9]+(?:e[0-9]+)?)"
BOUND_LIST = r"(?:[0-9]+(?:e[0-9]+)?\s*<=\s*)?([a-z][a-z0-9_]*(?:\s+[a-z][a-z0-9_]*)*)\s*<=\s*([0-9]+(?:e[0-9]+)?)"
TYPES = r"(char|bool|short|int|float|long long|double)"
STATIC_ARRAY = rf"(?i)\b{TYPES}\s+\w+\s*((?:\[[a-z0-9_]+\])+)"
VECTOR = rf"(?i)\bvector\s*<\s*{TYPES}\s*>\s+\w+\s*\(\s*([a-z0-9_]+)\s*\)"
MATRIX = rf"(?i)vector\s*<\s*vector\s*<\s*{TYPES}\s*>\s*>\s+\w+\s*\(\s*([a-z0-9_]+)\s*,\s*vector\s*<[^>]+>\s*\(\s*([a-z0-9_]+)"
TYPE_BYTES = {"char": 1, "bool": 1, "short": 2, "int": 4, "float": 4, "long long": 8, "double": 8}


def _number(s: Column) -> Column:
    return s.cast("double").cast("bigint")


def _pairs(text: Column, pattern: str) -> Column:
    names, values = (F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in (1, 2))
    return F.zip_with(names, values, lambda n, v: F.struct(n.alias("names"), _number(v).alias("value")))


def variable_bounds(constraints: Column) -> Column:
    """M4: MAP of variable to bound from an array of constraint lines; the greatest bound of a repeated one.

    Commas are blanks, only ``<=`` counts, and in a chain the last list of names before a number is bound.
    """
    lines = F.transform(F.coalesce(constraints, F.array().cast("array<string>")), lambda c: F.translate(F.lower(c), ",", " "))
    found = F.flatten(F.transform(lines, lambda t: F.concat(_pairs(t, BOUND), _pairs(t, BOUND_LIST))))
    each = F.flatten(F.transform(found, lambda p: F.transform(F.split(p["names"], r"\s+"), lambda n: F.struct(n.alias("k"), p["value"].alias("v")))))
    names = F.array_distinct(F.transform(each, lambda e: e["k"]))
    top = lambda n: F.array_max(F.transform(F.filter(each, lambda e: e["k"] == n), lambda e: e["v"]))
    return F.map_from_arrays(names, F.transform(names, top))


def expression_of(complexity: Column) -> Column:
    """M6: what stands in the first ``o( )`` in lower case; empty if there is none."""
    low = F.replace(F.replace(F.lower(complexity), F.lit("²"), F.lit("^2")), F.lit("³"), F.lit("^3"))
    low = F.replace(F.replace(low, F.lit("time")), F.lit("space"))
    return F.regexp_replace(F.trim(F.regexp_extract(low, r"o\s*\(([^)]+)\)", 1)), r"\blog\s+([a-z])", "log($1)")


def _token(bounds: Column, t: Column) -> Column:
    """One factor of a product; null if its variable has no bound."""
    log_var = F.regexp_extract(t, r"\Alog2?\(?([a-z][a-z0-9_]*)\)?\z", 1)
    base, power = F.regexp_extract(t, r"\A([a-z][a-z0-9_]*)\^([0-9]+)\z", 1), F.regexp_extract(t, r"\A([a-z][a-z0-9_]*)\^([0-9]+)\z", 2)
    b = lambda name: F.try_element_at(bounds, name).cast("double")
    log_bound = b(log_var)
    return (
        F.when((t == "") | (t == "1"), F.lit(1.0))
        .when(log_var != "", F.when(log_bound.isNotNull(), F.greatest(F.lit(1.0), F.log2(F.greatest(F.lit(2.0), log_bound)))))
        .when(base != "", F.pow(b(base), power.cast("double")))
        .when(F.regexp_like(t, F.lit(r"\A[0-9]+\z")), t.cast("double"))
        .otherwise(b(t))
    )


def _product(bounds: Column, term: Column) -> Column:
    flat = F.regexp_replace(F.regexp_replace(F.replace(F.trim(term), F.lit(" "), F.lit("*")), r"\*+", "*"), r"\A\*+|\*+\z", "")
    value = F.aggregate(F.split(flat, r"\*"), F.lit(1.0), lambda a, t: a * _token(bounds, t))
    return F.when(flat != "", _ceil(value))


def _ceil(x: Column) -> Column:
    """The ceiling as a double, whatever its size (beyond 2^53 a double is whole)."""
    return F.when(x < F.lit(9.0e15), F.ceil(x).cast("double")).otherwise(x)


def estimate(e: Column, bounds: Column) -> Column:
    """M7: operations or units of an expression (``expression_of``) as a double; null where it cannot be told.

    ``e`` and ``bounds`` are used many times: pass columns of an earlier projection, not expressions.
    """
    names = F.regexp_extract_all(e, F.lit(r"([a-z][a-z0-9_]*)"), F.lit(1))
    first = F.try_element_at(bounds, F.try_element_at(F.filter(names, lambda n: F.map_contains_key(bounds, n)), F.lit(1)))
    two = F.try_element_at(bounds, F.regexp_extract(e, r"2\^([a-z][a-z0-9_]*)", 1))
    total = F.aggregate(F.split(e, r"\+"), F.lit(0.0), lambda a, t: a + _product(bounds, t))
    return (
        F.when(e == "", F.lit(None).cast("double"))
        .when(e == "1", F.lit(1.0))
        .when(F.contains(e, F.lit("!")), F.when(first <= 20, F.factorial(first.cast("int")).cast("double")))
        .when(F.regexp_like(e, F.lit(r"2\^([a-z][a-z0-9_]*)")), F.when(two <= 60, F.pow(F.lit(2.0), two.cast("double"))))
        .otherwise(total)
    )


def _size(bounds: Column, s: Column) -> Column:
    return F.when(F.regexp_like(s, F.lit(r"\A[0-9]+\z")), s.cast("double")).otherwise(F.try_element_at(bounds, F.lower(s)).cast("double"))


def _bytes(t: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, size in TYPE_BYTES.items():
        out = F.when(F.lower(t) == name, F.lit(float(size))).otherwise(out)
    return out


def code_memory(code: Column, bounds: Column) -> Column:
    """Bytes of static arrays, vectors and matrices whose sizes are known; null if there is none."""
    group = lambda p, i: F.regexp_extract_all(code, F.lit(p), F.lit(i))
    dims = lambda d: F.transform(F.regexp_extract_all(F.lower(d), F.lit(r"\[([a-z0-9_]+)\]"), F.lit(1)), lambda s: _size(bounds, s))
    static = F.zip_with(group(STATIC_ARRAY, 1), group(STATIC_ARRAY, 2), lambda t, d: _bytes(t) * F.nullif(F.aggregate(dims(d), F.lit(1.0), lambda a, x: a * x), F.lit(0.0)))
    vector = F.zip_with(group(VECTOR, 1), group(VECTOR, 2), lambda t, d: _bytes(t) * _size(bounds, d))
    cells = F.zip_with(group(MATRIX, 2), group(MATRIX, 3), lambda a, b: _size(bounds, a) * _size(bounds, b))
    matrix = F.zip_with(group(MATRIX, 1), cells, lambda t, n: _bytes(t) * n)
    known = F.filter(F.concat(static, vector, matrix), lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x))


def status(value: Column, budget: Column) -> Column:
    """M3: UNKNOWN, PASS (up to and with the budget) or FAIL."""
    return F.when(value.isNull(), "UNKNOWN").when(value <= budget, "PASS").otherwise("FAIL")


def add_resource_verdict(
    df: DataFrame, constraints: str, time_limit_sec: str, memory_limit_mb: str, time_complexity: str, space_complexity: str, code: str,
    declared_bounds: str | None = None, declared_ops: str | None = None, declared_bytes: str | None = None, name: str = "resource_verdict", ops_per_second: int = OPS_PER_SECOND,
) -> DataFrame:
    """M1: adds the verdict struct. Declared values win over derived ones; memory is the greatest known estimate.

    Each step is a projection of its own, so nothing is computed twice.
    """
    bounds = variable_bounds(F.col(constraints))
    if declared_bounds:
        low = F.transform_keys(F.coalesce(declared_bounds, F.create_map().cast("map<string,bigint>")), lambda k, v: F.lower(k))
        bounds = F.map_zip_with(bounds, low, lambda k, x, y: F.coalesce(y, x))
    staged = df.withColumns({"_b": bounds, "_te": expression_of(F.col(time_complexity)), "_se": expression_of(F.col(space_complexity)), "_budget": F.floor(F.col(time_limit_sec) * ops_per_second).cast("bigint"), "_room": F.col(memory_limit_mb).cast("bigint") * 1024 * 1024})
    ops, size = estimate(F.col("_te"), F.col("_b")), F.greatest(code_memory(F.col(code), F.col("_b")), estimate(F.col("_se"), F.col("_b")) * 8)
    if declared_ops:
        ops = F.coalesce(F.col(declared_ops).cast("double"), ops)
    if declared_bytes:
        size = F.coalesce(F.col(declared_bytes).cast("double"), size)
    staged = staged.withColumns({"_ops": ops, "_size": size})
    staged = staged.withColumns({"_ts": status(F.col("_ops"), F.col("_budget")), "_ms": status(F.col("_size"), F.col("_room"))})
    shown = lambda c: F.coalesce(F.col(c).try_cast("decimal(38,0)").cast("string"), F.lit("overflow"))
    # The wording of the reasons.
    reasons = F.array_compact(F.array(
        F.when(F.col("_ts") == "FAIL", F.concat(F.lit("THEORETICAL_TLE: estimated "), shown("_ops"), F.lit(" operations exceeds budget "), F.col("_budget").cast("string"), F.lit(".")))
        .when(F.col("_ts") == "UNKNOWN", F.concat(F.lit("Time complexity could not be estimated from '"), F.col(time_complexity), F.lit("'."))),
        F.when(F.col("_ms") == "FAIL", F.concat(F.lit("THEORETICAL_MLE: estimated "), shown("_size"), F.lit(" bytes exceeds budget "), F.col("_room").cast("string"), F.lit(".")))
        .when(F.col("_ms") == "UNKNOWN", F.concat(F.lit("Memory usage could not be estimated from '"), F.col(space_complexity), F.lit("'."))),
    ))
    verdict = F.struct(
        F.col("_ts").alias("time_status"), F.col("_ms").alias("memory_status"), F.col("_ops").try_cast("decimal(38,0)").alias("estimated_operations"), F.col("_budget").alias("operation_budget"),
        F.col("_size").try_cast("decimal(38,0)").alias("estimated_memory_bytes"), F.col("_room").alias("memory_budget_bytes"), reasons.alias("reasons"),
    )
    return staged.withColumn(name, verdict).drop("_b", "_te", "_se", "_budget", "_room", "_ops", "_size", "_ts", "_ms")


def unknown_verdict(time_limit_sec: Column, memory_limit_mb: Column, ops_per_second: int = OPS_PER_SECOND) -> Column:
    """Nothing was evaluated."""
    none = F.lit(None).cast("decimal(38,0)")
    return F.struct(
        F.lit("UNKNOWN").alias("time_status"), F.lit("UNKNOWN").alias("memory_status"), none.alias("estimated_operations"), F.floor(time_limit_sec * ops_per_second).cast("bigint").alias("operation_budget"),
        none.alias("estimated_memory_bytes"), (memory_limit_mb.cast("bigint") * 1024 * 1024).alias("memory_budget_bytes"), F.array(F.lit("No candidate was evaluated.")).alias("reasons"),
    )


def verdict_failed(v: Column) -> Column:
    """F6."""
    return (v["time_status"] == "FAIL") | (v["memory_status"] == "FAIL")


def verdict_unknown(v: Column) -> Column:
    """F6."""
    return (v["time_status"] == "UNKNOWN") | (v["memory_status"] == "UNKNOWN")
