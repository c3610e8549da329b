"""Session helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory (a Parquet file or a directory of them)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for ``checkpoint()``: the cluster's ``spark.checkpoint.dir`` if named.

    Only a local session (tests) may leave it unset and gets a temporary folder of this machine; on a
    cluster such a folder would be lost with its machine, so there an unset setting is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        named = os.path.join(tempfile.gettempdir(), "evalframe-checkpoints")
    sc.setCheckpointDir(named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` through the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def clear_checkpoints(spark: SparkSession) -> None:
    """Delete this application's checkpoints and stream tables; results that still rest on them are lost.

    ``spark.cleaner.referenceTracking.cleanCheckpoints=true`` lets Spark delete a checkpoint as soon as no
    DataFrame refers to it.
    """
    folder = spark.sparkContext.getCheckpointDir()
    if folder:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for status in fs.listStatus(path) if fs.exists(path) else []:
            fs.delete(status.getPath(), True)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for an expensive per-row stage that follows a scan of few splits.

    A scan with fewer splits than cores is at most (cores x maxPartitionBytes) large, so the added
    shuffle is bounded; larger scans pass unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df
