"""Batch scans and sinks."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def rows(spark: SparkSession, values: list, schema: str | StructType) -> DataFrame:
    """A table of literal rows; of none, an empty one."""
    return spark.createDataFrame(values, schema)


def csv(spark: SparkSession, path: str, schema: str | StructType | None = None, null: str | None = None, mode: str = "PERMISSIVE") -> DataFrame:
    """A CSV with a header. Without a schema all columns are strings; in PERMISSIVE mode only a malformed field is null."""
    reader = spark.read.option("header", True).option("mode", mode)
    reader = reader.option("nullValue", null) if null is not None else reader
    return (reader.schema(schema) if schema else reader).csv(path)


def delimited_text(spark: SparkSession, path: str, delimiter: str) -> DataFrame:
    """A row (value) per record of a text file with its own record delimiter."""
    return spark.read.option("lineSep", delimiter).text(path)


def xml(df: DataFrame, column: str, schema: str) -> DataFrame:
    """df with the column parsed; attributes have names with a leading underscore."""
    return df.withColumn(column, F.from_xml(column, schema))


def json_lines(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def dates(start: dt.date, days: int) -> list[dt.date]:
    """start and the days before it, so many in all."""
    return [start - dt.timedelta(days=i) for i in range(days)]


def millis(day: dt.date) -> int:
    """The start of a day in UTC, in milliseconds."""
    return int(dt.datetime(day.year, day.month, day.day, tzinfo=dt.UTC).timestamp() * 1000)


def load_date_range(spark: SparkSession, base: str, name: str, start: dt.date, days: int, schema: str | StructType | None = None) -> DataFrame:
    """The rows of <base>/dt=<day>/field_name=<name>/ for the days up to start, with their day in dt; one pruned scan."""
    reader = spark.read.schema(schema) if schema else spark.read
    found = reader.parquet(base)
    return found.where(F.col("dt").cast("date").isin(dates(start, days)) & (F.col("field_name") == name)).drop("field_name")


def write_partitioned(df: DataFrame, path: str, by: list[str], form: str = "csv") -> None:
    writer = df.write.mode("overwrite").partitionBy(*by)
    (writer.option("header", True) if form == "csv" else writer).format(form).save(path)


def write_bucketed(df: DataFrame, name: str, column: str, buckets: int) -> None:
    """A table whose rows are dealt out and sorted by a column; joins of two such tables need no exchange."""
    df.write.mode("overwrite").bucketBy(buckets, column).sortBy(column).saveAsTable(name)


def tables(spark: SparkSession) -> list[str]:
    return [t.name for t in spark.catalog.listTables()]


def sensors(spark: SparkSession, n: int = 100_000, seed: int = 1) -> DataFrame:
    """A reference table of sensors with a type, unit and range each."""
    kinds = ["temperature", "pressure", "humidity", "light", "sound", "motion", "gas", "water"]
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.floor(F.rand(seed) * len(kinds)) + 1).cast("int"))
    low = F.round(F.rand(seed + 1) * 50, 2)
    return spark.range(n).select(F.col("id").alias("sensorId"), kind.alias("sensorType"), F.lit("unit").alias("unit"), low.alias("minRange"), (low + F.round(F.rand(seed + 2) * 100, 2)).alias("maxRange"))


def scores(spark: SparkSession, n: int = 300, seed: int = 1) -> DataFrame:
    """Random scores of elements in three groups."""
    draw = lambda k, most: (F.floor(F.rand(seed + k) * most)).cast("int")
    return spark.range(n).select((draw(0, 3) + 1).alias("group_id"), draw(1, 1000).alias("element_id"), (draw(2, 50) + 1).alias("score"))


def shifted_to(df: DataFrame, ts: str, now: dt.datetime) -> DataFrame:
    """df with all times moved by one distance, so that the earliest is now."""
    first = df.agg(F.min(ts)).first()[0]
    return df if first is None else df.withColumn(ts, F.col(ts) + F.lit(now - first.replace(tzinfo=now.tzinfo)))


def json_rows(df: DataFrame) -> Iterator[str]:
    """The rows as JSON texts, a partition at a time."""
    return (r[0] for r in df.select(F.to_json(F.struct("*"))).toLocalIterator())
