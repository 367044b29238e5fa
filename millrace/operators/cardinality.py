"""Limits on how many distinct values of a field may be told apart: gray lists, and their enforcement."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.skew import salt
from millrace.operators.windows import first_per_key


@dataclass(frozen=True)
class GrayField:
    """A limited field: its threshold, what takes the place of values beyond it, the columns of its key, and how it is matched."""

    name: str
    threshold: int = 3000
    replacement: str = "other"
    key: tuple[str, ...] = ("app_id", "media_source")
    ignore_case: bool = False

    def matched(self, column: str | None = None) -> Column:
        value = F.col(column or self.name).cast("string")
        return F.lower(value) if self.ignore_case else value


@dataclass(frozen=True)
class GrayConfig:
    fields: tuple[GrayField, ...]
    days: int = 7
    hash_values: bool = False
    extra: dict = field(default_factory=dict)


def latest(df: DataFrame, keys: Sequence[str], day: str, upto: object) -> DataFrame:
    """The latest row of each key that is not after a day; of equal days the greatest by the other columns. Rows with a null key don't count."""
    known = df.where(F.col(day) <= F.lit(upto))
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    return first_per_key(known, keys, [F.desc(day), *[F.desc(c) for c in df.columns if c not in (day, *keys)]])


def gray_list(df: DataFrame, value: str, keys: Sequence[str], order: Sequence[Column], threshold: int, bins: int = 100) -> DataFrame:
    """(keys, value): the first `threshold` values of those keys that have more.

    First each of `bins` parts of a key is cut to threshold + 1 rows, so that no task sees a whole key; the value ends the
    order, so that the result depends on neither bins nor ties."""
    total = [*order, F.col(value)]
    cut = first_per_key(df.withColumn("_bin", salt(bins, value)), [*keys, "_bin"], total, threshold + 1).drop("_bin")
    by = Window.partitionBy(*keys)
    ranked = cut.withColumn("_row", F.row_number().over(by.orderBy(*total)))
    most = F.max("_row").over(by)
    return ranked.withColumn("_most", most).where((F.col("_most") > threshold) & (F.col("_row") <= threshold)).select(*keys, value)


def event_gray_list(df: DataFrame, app: str, event: str, day: str, count: str, upto: object, threshold: int) -> DataFrame:
    """The gray list of each app's events, latest and then most frequent first."""
    return gray_list(latest(df, [app, event], day, upto), event, [app], [F.desc(day), F.desc(count)], threshold)


def key_of(columns: Sequence[str | Column]) -> Column:
    """One key for lists and rows alike: values between bars, with bars and backslashes inside them escaped and nulls as \\N, so
    that no two different rows of values have the same."""
    texts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    return F.concat_ws("|", *[F.coalesce(F.replace(F.replace(t, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), F.lit("\\N")) for t in texts])


def list_sets(lists: DataFrame, limited: GrayField, day: str, hash_values: bool = False) -> DataFrame:
    """(gray_key, gray_set) of a field's lists; with hash_values the set holds 64-bit hashes."""
    value = limited.matched()
    value = F.xxhash64(value) if hash_values else value
    return lists.groupBy(key_of([*limited.key, F.col(day).cast("string")]).alias("gray_key")).agg(F.sort_array(F.collect_set(value)).alias("gray_set"))


def enforce(df: DataFrame, config: GrayConfig, load: Callable[[GrayField], DataFrame], day: str) -> DataFrame:
    """df with values that their day's list lacks replaced; keys without a list stay as they are.

    load gives a field's lists for the days of df, as (key columns, day, field). A list has at most threshold values, so
    that a set stays small; the join's strategy is left to the planner, which broadcasts the sets while they are."""
    for limited in config.fields:
        sets = list_sets(load(limited), limited, day, config.hash_values)
        value = F.xxhash64(limited.matched()) if config.hash_values else limited.matched()
        joined = df.withColumn("gray_key", key_of([*limited.key, F.col(day).cast("string")])).join(sets, "gray_key", "left")
        beyond = F.col(limited.name).isNotNull() & F.col("gray_set").isNotNull() & ~F.array_contains("gray_set", value)
        df = joined.withColumn(limited.name, F.when(beyond, F.lit(limited.replacement)).otherwise(F.col(limited.name))).drop("gray_key", "gray_set")
    return df
