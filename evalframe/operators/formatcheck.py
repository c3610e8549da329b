"""Format adherence of completions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evalframe.functions import text
from evalframe.operators.metrics import rate


def score(df: DataFrame, completion: str = "completion") -> DataFrame:
    """Four predicates, their conjunction and a preview of 1000 characters; a null completion has nothing."""
    c = F.coalesce(F.col(completion), F.lit(""))
    flags = {"explanation_field": text.has_explanation(c), "chinese_explanation": text.has_chinese_explanation(c), "complexity_field": text.has_complexities(c), "cpp_code_block": text.has_cpp_block(c)}
    scored = df.withColumns(flags)
    valid = F.col("explanation_field") & F.col("chinese_explanation") & F.col("complexity_field") & F.col("cpp_code_block")
    return scored.withColumn("format_valid", valid).withColumn("response_preview", F.substring(c, 1, 1000)).drop(completion)


def rates(scored: DataFrame) -> DataFrame:
    """A17."""
    return scored.agg(F.count(F.lit(1)).alias("num_problems"), *[rate(F.col(a)).alias(b) for a, b in (("format_valid", "format_valid_rate"), ("chinese_explanation", "chinese_explanation_rate"), ("complexity_field", "complexity_field_rate"), ("cpp_code_block", "cpp_code_block_rate"))])
