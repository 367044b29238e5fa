"""Ranking, runs, cumulative and variable-length windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key. Spark keeps n rows of a key per task before it shuffles."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def all_and_first_others(df: DataFrame, always: Column, key: str, order: Sequence[Column]) -> DataFrame:
    """All rows where `always` holds, and of the others the first of each key."""
    return df.where(always).unionByName(first_per_key(df.where(~always), [key], order))


def runs(df: DataFrame, keys: Sequence[str], day: str, status: str, wanted: object, least: int) -> DataFrame:
    """The rows that belong to a run of at least so many consecutive days with the wanted status.

    Days of a run differ from their rank by the same number of days; so one window finds all runs."""
    of = df.where(F.col(status) == wanted)
    island = F.date_sub(F.col(day), F.row_number().over(Window.partitionBy(*keys).orderBy(day)))
    marked = of.withColumn("_island", island)
    length = F.count("*").over(Window.partitionBy(*keys, "_island"))
    return marked.withColumn("run_length", length).where(F.col("run_length") >= least).drop("_island")


def cumulative(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str) -> DataFrame:
    """Adds rank, running (sum up to and with the row) and total (of the key)."""
    by = Window.partitionBy(*keys)
    upto = by.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("rank", F.row_number().over(by.orderBy(*order))).withColumn("running", F.sum(value).over(upto)).withColumn("total", F.sum(value).over(by))


def forward_sum(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, n: str, most: int | None = None) -> DataFrame:
    """Adds forward_sum: the sum of value over the row and those after it, n rows in all, n being a column.

    Differences of running sums would round; so the values ahead are listed and added. With a bound on n, each list is at
    most that long, and the work is linear in the rows."""
    ahead = Window.partitionBy(*keys).orderBy(*order).rowsBetween(0, Window.unboundedFollowing if most is None else most - 1)
    listed = df.withColumn("_ahead", F.collect_list(value).over(ahead))
    total = F.aggregate(F.slice("_ahead", F.lit(1), F.greatest(F.col(n), F.lit(0))), F.lit(0.0), lambda acc, x: acc + x)
    return listed.withColumn("forward_sum", total).drop("_ahead")


def status_change(df: DataFrame, keys: Sequence[str], order: Sequence[Column], status: str) -> DataFrame:
    """Adds previous (the status of the row before, of the row itself at the start) and changed."""
    before = F.lag(status).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("previous", F.coalesce(before, F.col(status))).withColumn("changed", ~F.col("previous").eqNullSafe(F.col(status)))


def range_count(df: DataFrame, keys: Sequence[str], number: str, back: int, flag: Column) -> DataFrame:
    """Adds in_range: how many rows with number - back to number have the flag."""
    frame = Window.partitionBy(*keys).orderBy(F.col(number)).rangeBetween(-back, 0)
    return df.withColumn("in_range", F.sum(F.when(flag, 1).otherwise(0)).over(frame))
