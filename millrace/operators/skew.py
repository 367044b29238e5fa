"""Salted aggregation and joins that survive a key with any share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How partial results of an aggregate merge (fixed values).
MERGE = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}


def salt(n: int, *columns: str | Column) -> Column:
    """A number from 0 to n - 1: the same for equal values of the columns, so that a repeated task gives it again."""
    if n < 1:
        raise ValueError("n must be at least 1")
    return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")


def salted_group_by(df: DataFrame, keys: Sequence[str], metrics: dict[str, tuple[str, str]], n: int, by: Sequence[str]) -> DataFrame:
    """Groups in two steps, over (keys, salt) and then keys; metrics: name -> (aggregate, column or '*').

    The salt comes from the columns `by`. Averages are sums over counts; distinct counts cannot be merged and are rejected."""
    first, second = [], []
    for name, (kind, column) in metrics.items():
        value = F.lit(1) if column == "*" else F.col(column)
        if kind == "avg":
            first += [F.sum(value).alias(f"_s_{name}"), F.count(value).alias(f"_n_{name}")]
            second.append(F.try_divide(F.sum(f"_s_{name}"), F.sum(f"_n_{name}")).alias(name))
        elif kind in MERGE:
            first.append(getattr(F, kind)(value).alias(f"_{name}"))
            second.append(MERGE[kind](f"_{name}").alias(name))
        else:
            raise ValueError(f"{kind} cannot be merged from partial results")
    return df.withColumn("_salt", salt(n, *by)).groupBy(*keys, "_salt").agg(*first).groupBy(*keys).agg(*second)


def salted_distinct(df: DataFrame, n: int) -> DataFrame:
    """The distinct rows. Equal rows get equal salts; the salt only makes the exchange's key more even."""
    return df.withColumn("_salt", salt(n, *df.columns)).distinct().drop("_salt").distinct()


def null_skew_left_join(left: DataFrame, right: DataFrame, column: str, buckets: int = 10_000) -> DataFrame:
    """left.join(right, column, 'left') where rows without a key are dealt out over all tasks.

    They get a second key from -buckets to -1, by a hash of the row; rows with a key have 0 there, as all of right. Right
    rows without a key match nothing and go first."""
    if buckets < 1:
        raise ValueError("buckets must be at least 1")
    spread = F.when(F.col(column).isNull(), -1 - salt(buckets, *left.columns)).otherwise(F.lit(0))
    keyed = left.withColumn("_key", F.coalesce(F.col(column).cast("string"), F.lit(""))).withColumn("_spread", spread)
    other = right.where(F.col(column).isNotNull()).withColumn("_key", F.col(column).cast("string")).withColumn("_spread", F.lit(0)).drop(column)
    return keyed.join(other, ["_key", "_spread"], "left").drop("_key", "_spread")
