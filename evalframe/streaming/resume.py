"""Incremental reports as a stream: new result files are read once, summaries follow (W9 on Structured Streaming)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from evalframe.session import ensure_checkpoint_dir


def append_stream(source: DataFrame, out: str, checkpoint: str) -> None:
    """Write what is new in a streaming DataFrame to an append-only table, exactly once, then stop."""
    source.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def windowed_counts(events: DataFrame, ts: str = "ts", late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Attempts by day and kind with a watermark, for a stream or a table alike."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("day"), "event_type", "n")


def stream_counts(spark: SparkSession, path: str) -> DataFrame:
    """Run the events table through a stream into an append-only table of the shared folder, then count by kind."""
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    folder, name = os.path.split(path)
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder) if not os.path.isdir(path) else spark.readStream.schema(schema).parquet(path)
    append_stream(stream.select("event_id", "event_type"), f"{base}/out", f"{base}/state")
    return spark.read.parquet(f"{base}/out").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("distinct_events"))
