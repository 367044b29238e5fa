"""Arrays, maps and structs, by name and without leaving the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_top_n(columns: list[str], n: int, largest: bool = True) -> Column:
    """array<struct<value, name>> of the n largest (or smallest) of some columns, nulls left out; ties by name."""
    entries = F.array(*[F.struct(F.col(c).cast("double").alias("value"), F.lit(c).alias("name")) for c in columns])
    entries = F.filter(entries, lambda x: x["value"].isNotNull())

    def order(x: Column, y: Column) -> Column:
        ahead = (x["value"] > y["value"]) if largest else (x["value"] < y["value"])
        behind = (x["value"] < y["value"]) if largest else (x["value"] > y["value"])
        return F.when(ahead, -1).when(behind, 1).when(x["name"] < y["name"], -1).when(x["name"] > y["name"], 1).otherwise(0)

    return F.slice(F.array_sort(entries, order), 1, n)


def union_maps(maps: Column) -> Column:
    """One map of an array of maps; of equal keys the last counts."""
    entries = F.flatten(F.transform(maps, F.map_entries))
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)))


def merge_sum(df: DataFrame, key: str, maps: str, field: str) -> DataFrame:
    """(key, map) where the values of equal map keys, or their field, are summed over all rows of the key."""
    rows = df.select(key, F.explode(maps).alias("k", "v"))
    value = F.col("v")[field] if field else F.col("v")
    sums = rows.groupBy(key, "k").agg(F.sum(value).alias("s"))
    return sums.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "s")))).alias(maps))


def first_present(values: str | Column) -> Column:
    """The first element that is not null, or null."""
    return F.try_element_at(F.array_compact(values), F.lit(1))


def nest(groups: dict[str, list[str]]) -> list[Column]:
    """A struct column for each group of flat columns."""
    return [F.struct(*names).alias(name) for name, names in groups.items()]
