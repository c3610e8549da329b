"""Resuming: what is done is not done again, and the report is the union."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from evalframe.operators.limits import limit_on_scanned


def load_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Earlier results; a missing path is an empty table, any other trouble is an error."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def remaining(problems: DataFrame, done: DataFrame, key: str = "problem_id", order: str | None = None, limit: int = 0) -> DataFrame:
    """The problems without a result; a head limit counts before the done ones are taken out."""
    ids = done.where(F.col(key).isNotNull()).select(key)
    return limit_on_scanned(problems, order or key, limit).join(ids, key, "left_anti")


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """U4: earlier results then new ones."""
    return old.unionByName(new, allowMissingColumns=True)


def append(new: DataFrame, path: str) -> None:
    """Append-only result table."""
    new.write.mode("append").parquet(path)
