"""Problem bundles and reports: JSON scans with explicit schemas and ordinals, and their sinks."""

from __future__ import annotations

import os
import shutil

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from evalframe.operators.curate import coerce_bundle
from evalframe.schemas import BUNDLE, REPORT


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """file_name, file_ord, problem, tests, oracle.

    A directory gives its ``*.json`` files (not deeper ones, none that start with ``_``), a file itself.
    A document that is no JSON, or lacks a required field, fails with a message naming the field.
    """
    reader = spark.read.schema(BUNDLE).option("multiLine", True).option("mode", "FAILFAST").option("recursiveFileLookup", False)
    raw = reader.json(path) if os.path.isfile(path) else reader.option("pathGlobFilter", "*.json").json(path)
    named = raw.withColumn("file_name", F.col("_metadata.file_name"))
    ranks = named.select("file_name").distinct().withColumn("file_ord", F.row_number().over(Window.orderBy("file_name")))
    return coerce_bundle(named).join(ranks, "file_name").select("file_name", "file_ord", "problem", "tests", "oracle")


def read_reports(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The problems of several reports, in the order of the paths: report, report_ord, prob_pos and the result fields.

    Entries that are no objects are dropped; missing fields are null.
    """
    frames = []
    for i, path in enumerate(paths):
        one = spark.read.schema(REPORT).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
        frames.append(one.select(F.lit(path).alias("report"), F.lit(i).alias("report_ord"), F.posexplode("problems").alias("prob_pos", "p")))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.where("p is not null").select("report", "report_ord", "prob_pos", "p.*")


def read_training(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON Lines training set."""
    return spark.read.schema(schema).json(path)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """A local export of a raw dataset (Parquet or JSON Lines), with row_index counted in file order.

    The index depends on the files alone, not on how they are packed into tasks: a row's place in its file (in
    its split, for JSON Lines) plus the rows of all files and splits before it. Only one count a split is
    put in order.
    """
    parquet = path.endswith(".parquet") or os.path.isdir(path) and not any(n.endswith((".json", ".jsonl")) for n in os.listdir(path))
    df = spark.read.parquet(path) if parquet else spark.read.json(path)
    if parquet:
        placed = df.withColumns({"_file": F.col("_metadata.file_path"), "_start": F.lit(0).cast("long"), "_at": F.col("_metadata.row_index")})
    else:
        within = Window.partitionBy("_file", "_start").orderBy("_seen")
        placed = df.withColumns({"_file": F.col("_metadata.file_path"), "_start": F.col("_metadata.file_block_start"), "_seen": F.monotonically_increasing_id()})
        placed = placed.withColumn("_at", (F.row_number().over(within) - 1).cast("long")).drop("_seen")
    where = [F.col("_metadata.file_path").alias("_file"), (F.lit(0).cast("long") if parquet else F.col("_metadata.file_block_start")).alias("_start")]
    sizes = df.select(*where).groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_file", "_start", (F.sum("_n").over(Window.orderBy("_file", "_start")) - F.col("_n")).alias("_before"))
    return placed.join(before, ["_file", "_start"]).withColumn("row_index", F.col("_before") + F.col("_at")).drop("_file", "_start", "_at", "_before")


def copy_files(df: DataFrame, source: str, target: str) -> None:
    """Byte copies of the files named in ``file_name``, made by the executors between shared folders."""
    def put(rows) -> None:
        os.makedirs(target, exist_ok=True)
        for r in rows:
            shutil.copy2(os.path.join(source, r.file_name), os.path.join(target, r.file_name))
    df.select("file_name").foreachPartition(put)


def copy_manifests(source: str, target: str) -> int:
    """The ``_*.json`` files of a folder of bundles, copied as they are; how many there were."""
    names = sorted(n for n in os.listdir(source) if n.startswith("_") and n.endswith(".json"))
    os.makedirs(target, exist_ok=True)
    for n in names:
        shutil.copy2(os.path.join(source, n), os.path.join(target, n))
    return len(names)


def bundle_json(df: DataFrame) -> DataFrame:
    """Problem id and the whole bundle as JSON, defaulted fields included."""
    return df.select(F.col("problem.id").alias("problem_id"), F.to_json(F.struct("problem", "tests", "oracle"), {"ignoreNullFields": "false", "pretty": "true"}).alias("json"))


def write_bundles(df: DataFrame, path: str) -> None:
    """One pretty JSON document a problem, written by the executors into a shared folder."""
    def put(rows) -> None:
        os.makedirs(path, exist_ok=True)
        for r in rows:
            temp = os.path.join(path, f".{r.problem_id}.tmp")
            with open(temp, "w", encoding="utf-8") as f:
                f.write(r.json + "\n")
            os.replace(temp, os.path.join(path, f"{r.problem_id}.json"))
    bundle_json(df).foreachPartition(put)


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON Lines."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
