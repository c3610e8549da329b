import pytest
from pyspark.sql import functions as F

from evalframe.functions import semi, text


@pytest.mark.parametrize("raw, out", [("a \r\nb\t\r\n\r\n", "a\nb"), ("", ""), ("\n\n", ""), ("a\rb", "a\nb"), ("x　\n y", "x\n y"), ("a\x1f\n", "a"), (None, None)])
def test_normalize_output(one, raw, out):
    assert one(text.normalize_output, raw) == out


@pytest.mark.parametrize("raw, out", [("  a \n b \n", "a\n b"), ("", ""), ("\n\nx\x0cy  ", "x\ny"), (None, None)])
def test_normalize_code(one, raw, out):
    assert one(text.normalize_code, raw) == out


@pytest.mark.parametrize("raw, lenient, strict", [
    ("say ```cpp\nint x;\n``` end", "int x;", "int x;"), ("```C++ a```", "a", "a"), ("so #include <x>\n", "#include <x>", "#include <x>"), (" plain ", "plain", ""), ("```cpp\nopen", "```cpp\nopen", ""),
])
def test_extract_code(one, raw, lenient, strict):
    assert one(text.extract_code, raw) == lenient
    assert one(lambda c: text.extract_code(c, strict=True), raw) == strict


@pytest.mark.parametrize("raw, time, space", [
    ("time: O(n log n), space: O(n)", "O(n log n)", "O(n)"), ("O(n), O(1)", "O(n)", "O(1)"), ("O(n)", "O(n)", "unknown"), ("Time：O(m) ", "O(m)", "unknown"), ("", "unknown", "unknown"), ("space: O(1)", "O(1)", "O(1)"),
])
def test_complexity_fields(one, raw, time, space):
    assert one(lambda c: text.complexity_fields(c)[0], raw) == time
    assert one(lambda c: text.complexity_fields(c)[1], raw) == space


@pytest.mark.parametrize("raw, out", [("Two Sum!", "two_sum"), ("__", "problem"), ("É", "problem"), ("a" * 130, "a" * 120)])
def test_slug(one, raw, out):
    assert one(text.slug, raw) == out


def test_trim_and_single_line(one):
    assert one(lambda c: text.trim_text(c, 5), "abcdef") == "ab..."
    assert one(lambda c: text.trim_text(c, 5), "a\r\nb") == "a\nb"
    assert one(text.single_line, "  a\n\n`b`  ") == "a 'b'"


@pytest.mark.parametrize("raw, out", [("#include <x>", "cpp17"), ("USING NAMESPACE STD;", "cpp17"), ("def f():", "python3"), ("int x;", "unknown")])
def test_detect_language(one, raw, out):
    assert one(text.detect_language, raw) == out


def test_constraint_lines(one):
    assert one(text.constraint_lines, "Constraints:\n 1 <= n \nx\n≤ 3\n\n") == ["Constraints:", "1 <= n", "≤ 3"]


@pytest.mark.parametrize("raw, t, m", [("1.5 seconds", 1.5, 1), ("2 MB", 2.0, 2), ("", 2.0, 256), (None, 2.0, 256), ("none", 2.0, 256)])
def test_limits(one, raw, t, m):
    assert one(text.parse_time_limit, raw) == t
    assert one(text.parse_memory_limit, raw) == m


@pytest.mark.parametrize("raw, flags", [
    ("Solution Explanation:\n中文\nTime Complexity: O(1)\nSpace Complexity: O(1)\n```cpp\nx\n```", (True, True, True, True)),
    ("## Solution Explanation\n中\n### Time Complexity\nO(1)\n## Space Complexity\n```c++\n```", (True, True, True, True)),
    ("Solution Explanation:\nplain\nTime Complexity: 中", (True, False, False, False)),
    ("**Solution Explanation**: 中\n```cpp\nopen", (False, False, False, False)),
    ("Solution Explanation:中\n```\nx\n```", (True, True, False, False)),
])
def test_format_predicates(one, raw, flags):
    for fn, want in zip((text.has_explanation, text.has_chinese_explanation, text.has_complexities, text.has_cpp_block), flags):
        assert one(fn, raw) == want


@pytest.mark.parametrize("value, out", [(2.0, "2"), (1.5, "1.5"), (0.25, "0.25"), (10.0, "10")])
def test_general_number(spark, value, out):
    assert spark.range(1).select(text.general_number(F.lit(value)).alias("x")).first().x == out


def test_reward(one):
    assert one(text.format_reward, "```cpp\n#include <x>\nint main\n``` Complexity:") == 0.2 + 0.2 + 0.2
    assert one(text.format_reward, "") == 0.0


@pytest.mark.parametrize("raw, out", [(None, []), (" ", []), ("[1, \"a\", [2]]", ["1", "a", "[2]"]), ("\"x\"", ["x"]), ("['a']", ["['a']"]), ("null", []), ("5", ["5"])])
def test_list_text(one, raw, out):
    assert one(semi.list_text, raw) == out


@pytest.mark.parametrize("raw, out", [("[\"1 2\", [3,4], {\"a\":1}]", ["1 2", "[3, 4]", '{"a": 1}']), ("[]", []), (None, [])])
def test_json_texts(one, raw, out):
    assert one(semi.texts_of_json_array, raw) == out
    assert one(semi.json_size, raw) == len(out)


def test_maps_and_unions(spark):
    df = spark.sql("select map('a', 1, 'b', 2) x, map('b', 3, 'c', 4) y, array('p', '', 'q') l, array('q', null, 'r') m")
    row = df.select(semi.merge_maps(F.col("x"), F.col("y")).alias("u"), semi.distinct_union(F.col("l"), F.col("m")).alias("d")).first()
    assert row.u == {"a": 1, "b": 3, "c": 4} and row.d == ["p", "q", "r"]
