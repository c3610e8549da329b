"""Order-dependent limits without a window over all rows: prefix sums over blocks of positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: positions a block
BLOCK = 65_536


def running_successes(df: DataFrame, order: str, ok: Column) -> DataFrame:
    """Adds ``before``: the number of successes at earlier positions (``order``: unique whole numbers).

    Sums of blocks of positions are prefixed (one row a block), then each block counts within itself.
    """
    marked = df.withColumn("_ok", F.coalesce(ok, F.lit(False)).cast("int")).withColumn("_block", F.floor(F.col(order) / BLOCK))
    sums = marked.groupBy("_block").agg(F.sum("_ok").alias("_s"))
    base = sums.select("_block", (F.sum("_s").over(Window.orderBy("_block")) - F.col("_s")).alias("_base"))
    within = F.coalesce(F.sum("_ok").over(Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return marked.withColumn("_within", within).join(base, "_block").withColumn("before", F.col("_base") + F.col("_within")).drop("_ok", "_block", "_within", "_base")


def limit_on_success(df: DataFrame, order: str, ok: Column, limit: int) -> DataFrame:
    """The scanned prefix: rows up to and with the one that completes ``limit`` successes; all if limit <= 0."""
    if limit <= 0:
        return df
    return running_successes(df, order, ok).where(F.col("before") < limit).drop("before")


def limit_on_scanned(df: DataFrame, order: str, limit: int) -> DataFrame:
    """The first ``limit`` rows in order; all if limit <= 0."""
    return df.orderBy(order).limit(limit) if limit > 0 else df


def rank_within(df: DataFrame, group: str, block: Column, order: list[str]) -> DataFrame:
    """Adds ``rank``: how many rows of the group come earlier in order; ``block`` must not fall along the order.

    Counts of a group's blocks are prefixed (one row a group and block), then each block ranks within itself.
    """
    marked = df.withColumn("_block", block)
    counts = marked.groupBy(group, "_block").agg(F.count(F.lit(1)).alias("_n"))
    base = counts.select(group, "_block", (F.sum("_n").over(Window.partitionBy(group).orderBy("_block")) - F.col("_n")).alias("_base"))
    within = F.row_number().over(Window.partitionBy(group, "_block").orderBy(*order)) - 1
    return marked.withColumn("_within", within).join(base, [group, "_block"]).withColumn("rank", F.col("_base") + F.col("_within")).drop("_block", "_within", "_base")
