"""Grouping, pivots and text statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pivot(df: DataFrame, keys: Sequence[str], by: str, values: Sequence[object], aggregates: Sequence[Column]) -> DataFrame:
    """A row per key and a column per value (and aggregate). The values are given, so that no job has to find them."""
    return df.groupBy(*keys).pivot(by, list(values)).agg(*aggregates)


def rename_columns(df: DataFrame, keep: set[str], suffix: str) -> DataFrame:
    """All columns but those to keep with a suffix."""
    return df.toDF(*[c if c in keep else f"{c}{suffix}" for c in df.columns])


def key_values(df: DataFrame, key: str, text: str, names: Sequence[str], between: str = r"\|\|", equals: str = "=") -> DataFrame:
    """Texts like 'a=1 || b=2' as a column for each of names; the last of a repeated name counts, malformed parts none."""
    parts = F.filter(F.transform(F.split(text, between), F.trim), lambda p: F.size(F.split(p, equals, 2)) == 2)
    pairs = F.transform(parts, lambda p: F.struct(F.trim(F.split(p, equals, 2)[0]).alias("k"), F.trim(F.split(p, equals, 2)[1]).alias("v")))

    def value(name: str) -> Column:
        return F.try_element_at(F.filter(pairs, lambda p: p["k"] == name), F.lit(-1))["v"].alias(name)

    return df.select(key, *map(value, names))


def by_composite_key(df: DataFrame, keys: Sequence[str], aggregates: Sequence[Column], between: str = ", ", name: str = "key") -> DataFrame:
    return df.groupBy(F.concat_ws(between, *keys).alias(name)).agg(*aggregates)


def rows_as_list(df: DataFrame, key: str, columns: Sequence[str], name: str) -> DataFrame:
    """(key, array<struct>) with the rows of each key in ascending order of their columns."""
    return df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))


def children_by_parent(parents: DataFrame, children: DataFrame, on: Column, key: str, child_key: str, child: Column, name: str) -> DataFrame:
    """Each parent's children in a map by child key; of repeated keys the greatest child counts."""
    pairs = parents.join(children, on).groupBy(key, F.col(child_key).alias("_k")).agg(F.max(child).alias("_v"))
    return pairs.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_k", "_v")))).alias(name))


def tf_idf(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, token, tf, df, weight) with weight = tf * ln(documents / df); tokens are runs of ASCII word characters in lower case."""
    tokens = docs.select(doc_id, F.explode(F.split(F.lower(text), r"\W+")).alias("token")).where("token != ''")
    tf = tokens.groupBy(doc_id, "token").agg(F.count("*").alias("tf"))
    df = tf.groupBy("token").agg(F.count("*").alias("df"))
    n = docs.count()
    return tf.join(df, "token").select(doc_id, "token", "tf", "df", (F.col("tf") * F.log(F.lit(float(n)) / F.col("df"))).alias("weight"))
