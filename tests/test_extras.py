"""Keys without clashes, ties, replayable offsets, options and running totals of large groups."""

import datetime as dt

from pyspark.sql import functions as F

from millrace.operators import cardinality, partitioning
from millrace.sources import readings


def test_keys_tell_nulls_and_bars_apart(spark):
    rows = [("a", None), (None, "a"), ("x|m", "n"), ("x", "m|n"), ("\\N", "a"), ("a", ""), ("a\\", "b"), ("a", "b")]
    got = [r["k"] for r in spark.createDataFrame(rows, "x string, y string").select(cardinality.key_of(["x", "y"]).alias("k")).collect()]
    assert len(set(got)) == len(rows) and got[-1] == "a|b"


def test_latest_breaks_ties(spark):
    day = dt.date(2024, 1, 1)
    rows = [("k", day, 1), ("k", day, 3), ("k", day, 2)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "key string, day date, n int").repartition(2)
        assert [r["n"] for r in cardinality.latest(df, ["key"], "day", day).collect()] == [3]


def test_offsets_give_the_same_rows_again():
    reader = readings.ReadingsReader(250, 7)
    spans = reader.partitions({"row": 100}, {"row": 200})
    first = [row for s in spans for row in reader.read(s)]
    assert first == [row for s in readings.ReadingsReader(250, 7).partitions({"row": 100}, {"row": 200}) for row in reader.read(s)]
    assert [r[0] for r in first] == list(range(100, 200)) and all(0 <= r[2] < 1 for r in first)
    assert readings.ReadingsReader(250, 7).latestOffset() == {"row": 100} and reader.latestOffset() == {"row": 250}


def test_running_totals_of_one_group(spark):
    df = spark.range(1000).select(F.lit("g").alias("g"), "id", (F.col("id") % 5).alias("v"))
    got = {r["id"]: r["t"] for r in partitioning.spread_running_sum(df, "g", ["id"], "v", "t").collect()}
    total, want = 0, {}
    for i in range(1000):
        total += i % 5
        want[i] = total
    assert got == want


def test_jdbc_ranges():
    assert readings.jdbc_options("jdbc:x:", "t") == {"url": "jdbc:x:", "dbtable": "t"}
    assert readings.jdbc_options("jdbc:x:", "t", "id", 0, 9, 3)["numPartitions"] == "3"
