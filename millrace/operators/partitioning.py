"""How rows are dealt out: by columns, by equal shares, and by ranges inside large groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_columns(df: DataFrame, columns: Sequence[str], parts: int | None = None) -> DataFrame:
    """df with all rows of a key in one partition; the number of partitions is left to the planner unless given."""
    return df.repartition(parts, *columns) if parts else df.repartition(*columns)


def share_buckets(df: DataFrame, key: Column, buckets: int) -> DataFrame:
    """(key, n, bucket): keys in order, dealt into buckets by the share of rows that come before them.

    Meant for few keys: the running total is over a row per key."""
    n = df.groupBy(key.alias("key")).agg(F.count("*").alias("n"))
    earlier = Window.orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(earlier), F.lit(0))
    total = n.agg(F.sum("n").alias("total"))
    return n.withColumn("before", before).crossJoin(F.broadcast(total)).select("key", "n", F.floor(F.col("before") * buckets / F.col("total")).cast("int").alias("bucket"))  # total is one row


def spread_running_sum(df: DataFrame, group: str, order: Sequence[str], value: str, name: str) -> DataFrame:
    """df with the running total of value in each group, where a group may hold any part of all rows.

    Rows are dealt out by ranges of (group, order), totalled by group and range, and summed inside each; a task sees one
    range of a group, and the only rows that meet per group are the ranges' totals."""
    dealt = df.repartitionByRange(group, *order).withColumn("_range", F.spark_partition_id()).persist()
    totals = dealt.groupBy(group, "_range").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(group, "_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return dealt.join(base, [group, "_range"]).withColumn(name, F.col("_base") + F.sum(value).over(inside)).drop("_range", "_base")
