"""Usage statistics over sliding periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The periods that are reported, in days (fixed values).
PERIODS = (1, 3, 7, 14, 30, 90, 180, 365)


def daily(events: DataFrame, day: str, user: str, account: str, activity: str, module: str) -> DataFrame:
    """(day, level, id, activities, modules): counts per user and per account, in one pass over the events."""
    both = events.select(day, activity, module, F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.col(c).cast("string").alias("id")) for k, c in (("user", user), ("account", account))])).alias("who"))
    return both.groupBy(F.col(day).alias("day"), "who.level", "who.id").agg(F.count(activity).alias("activities"), F.count(module).alias("modules"))


def period(days: DataFrame, last: str, n: int) -> DataFrame:
    """(level, id, activities, modules) over the n days up to and with the last."""
    inside = F.col("day").between(F.date_sub(F.lit(last).cast("date"), n - 1), F.lit(last).cast("date"))
    return days.where(inside).groupBy("level", "id").agg(F.sum("activities").alias("activities"), F.sum("modules").alias("modules"))


def slide(state: DataFrame, days: DataFrame, leaving: str, arriving: str | None) -> DataFrame:
    """The next day's state of a period: less the day that leaves it, with the day that arrives; those at zero go."""
    names = ["activities", "modules"]
    old = days.where(F.col("day") == F.lit(leaving).cast("date")).select("level", "id", *[(-F.col(c)).alias(c) for c in names])
    parts = state.select("level", "id", *names).unionByName(old)
    if arriving is not None:
        parts = parts.unionByName(days.where(F.col("day") == F.lit(arriving).cast("date")).select("level", "id", *names))
    sums = parts.groupBy("level", "id").agg(*[F.sum(c).alias(c) for c in names])
    return sums.where((F.col("activities") != 0) | (F.col("modules") != 0))


def multi_period(events: DataFrame, day: str, user: str, account: str, last: str, periods: Sequence[int] = PERIODS) -> DataFrame:
    """(account, period, activities, users) for every period, from one pass.

    A user's day counts for each period that reaches back to it: per user and account the events of each age are summed
    first, so that distinct users need no second shuffle of events."""
    age = F.datediff(F.lit(last).cast("date"), F.col(day).cast("date"))
    rows = events.withColumn("_age", age).where((F.col("_age") >= 0) & (F.col("_age") < max(periods)))
    per_user = rows.groupBy(account, user).agg(*[F.sum(F.when(F.col("_age") < p, 1).otherwise(0)).alias(f"p{p}") for p in periods])
    long = per_user.select(account, user, F.explode(F.array(*[F.struct(F.lit(p).alias("period"), F.col(f"p{p}").alias("n")) for p in periods])).alias("e")).where("e.n > 0")
    return long.groupBy(F.col(account).alias("account"), F.col("e.period").alias("period")).agg(F.sum("e.n").alias("activities"), F.count("*").alias("users"))
