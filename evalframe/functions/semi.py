"""Functions on JSON-ish strings, arrays and maps."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, StringType

from evalframe.functions.text import strip


def parse_jsonish(c: Column) -> Column:
    """The parsed value as VARIANT; null for null and blank text, null for text that is no JSON (see ``is_json``)."""
    return F.try_parse_json(F.nullif(strip(c), F.lit("")))


def is_json(c: Column) -> Column:
    return parse_jsonish(c).isNotNull()


def variant_kind(v: Column) -> Column:
    """ARRAY, OBJECT, STRING, BIGINT, ...; null for null."""
    return F.regexp_extract(F.schema_of_variant(v), r"^\w+", 0)


def list_text(c: Column) -> Column:
    """N2 over a JSON-ish string, each element as text (strings bare, others as JSON).

    Null and blank give no element, a scalar or object one, text that is no JSON itself.
    """
    v = parse_jsonish(c)
    many = F.from_json(F.to_json(v), "array<string>")
    none = F.array().cast("array<string>")
    kind = variant_kind(v)
    one = F.array(F.when(kind == "OBJECT", F.to_json(v)).otherwise(F.try_variant_get(v, "$", "string")))
    return F.when(c.isNull() | (strip(c) == ""), none).when(v.isNull(), F.array(c)).when(kind == "ARRAY", many).when(kind == "VOID", none).otherwise(one)


@F.pandas_udf(ArrayType(StringType()))
def texts_of_json_array(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The elements of a JSON array, strings as they are, others as JSON with a blank after comma and colon.

    An array too deeply nested to be read gives no elements."""
    def one(text: str | None) -> list[str] | None:
        try:
            value = json.loads(text) if text else None
        except ValueError:
            return [text]
        except RecursionError:
            return []
        if value is None:
            return []
        values = value if isinstance(value, list) else [value]
        return [x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in values]
    for s in batches:
        yield s.map(one)


def json_size(c: Column) -> Column:
    """How many elements ``texts_of_json_array`` gives, told by the JVM alone."""
    return F.coalesce(F.json_array_length(c), F.when(c.isNull() | c.isin("", "null"), F.lit(0)).otherwise(F.lit(1)))


def distinct_union(*arrays: Column) -> Column:
    """One list of the non-empty items of all, each where it first stands."""
    return F.array_distinct(F.filter(F.concat(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrays]), lambda x: x.isNotNull() & (x != "")))


def merge_maps(a: Column, b: Column) -> Column:
    """The union of two maps, the second one's values win."""
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(y, x))


def zip_cases(inputs: Column, outputs: Column) -> Column:
    """Inputs and outputs by position; null unless equally many."""
    return F.when(F.size(inputs) == F.size(outputs), F.transform(F.arrays_zip(inputs.alias("i"), outputs.alias("o")), lambda z: F.struct(z["i"].alias("stdin"), z["o"].alias("expected_stdout"))))
