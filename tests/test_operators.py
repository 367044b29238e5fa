"""Worked examples and invariants of the operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace.functions import exprs, nested
from millrace.functions.udt import FastString, FastStringType
from millrace.operators import aggregates, cardinality, skew, usage, windows
from millrace.sources import files, kafka


def test_bucket_edges(spark):
    df = spark.createDataFrame([(None,), (-1,), (0,), (10,), (11,), (99,)], "x int")
    got = [r[0] for r in df.select(exprs.case_bucket("x", [(0, 10), (11, 20)], "20+")).collect()]
    assert got == ["none", "none", "0-10", "0-10", "11-20", "20+"]


def test_three_valued_logic(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",)], "x string")
    assert df.where(exprs.differs_or_null("x", "a")).count() == 2
    assert exprs.optional_filter(df, None) is df


def test_week_range(spark):
    df = spark.createDataFrame([("201849 - 201903",), ("x",), (None,), ("201903 - 201849",)], "w string")
    got = [r[0] for r in df.select(exprs.week_range("w")).collect()]
    assert got == [["201849", "201850", "201851", "201852", "201901", "201902", "201903"], [], [], []]


def test_text_functions(spark):
    df = spark.createDataFrame([("ZER987", "naïve")], "a string, b string")
    r = df.select(exprs.sort_chars("a"), exprs.escape_unicode("b")).first()
    assert tuple(r) == ("789ERZ", "na\\u00efve")


def test_invalid_timestamps(spark):
    df = spark.createDataFrame([("2019-10-41 10:00:00",), (None,), ("2019-10-04 10:00:00",)], "t string")
    now = F.lit("2020-01-01").cast("timestamp")
    got = [str(r[0])[:10] for r in df.select(exprs.timestamp_or("t", "yyyy-MM-dd HH:mm:ss", now)).collect()]
    assert got == ["2020-01-01", "2020-01-01", "2019-10-04"]


def test_key_values(spark):
    df = spark.createDataFrame([(1, "a=1 || b=2 || a=3 || bad"), (2, None)], "id int, vals string")
    got = [tuple(r) for r in aggregates.key_values(df, "id", "vals", ["a", "b"]).orderBy("id").collect()]
    assert got == [(1, "3", "2"), (2, None, None)]


def test_row_top_n(spark):
    df = spark.createDataFrame([(0.1, 0.3, 0.4), (None, 2.0, 2.0)], "a double, b double, c double")
    got = [[x["name"] for x in r[0]] for r in df.select(nested.row_top_n(["a", "b", "c"], 2)).collect()]
    assert got == [["c", "b"], ["b", "c"]]
    assert df.select(nested.row_top_n(["a", "b", "c"], 1, largest=False)).first()[0][0]["name"] == "a"


def test_union_maps_last_wins(spark):
    df = spark.range(1).select(nested.union_maps(F.array(F.create_map(F.lit("a"), F.lit(1)), F.create_map(F.lit("a"), F.lit(2), F.lit("b"), F.lit(3)))).alias("m"))
    assert df.first()[0] == {"a": 2, "b": 3}


def test_forward_sum_variable_length(spark):
    rows = [(1, i, 1.0 * i, n) for i, n in enumerate([1, 2, 3, 9], 1)]
    df = spark.createDataFrame(rows, "k int, i int, v double, n int")
    want = {1: 1.0, 2: 5.0, 3: 7.0, 4: 4.0}
    for most in (None, 9):
        assert {r["i"]: r["forward_sum"] for r in windows.forward_sum(df, ["k"], [F.col("i")], "v", "n", most).collect()} == want


def test_runs_need_consecutive_days(spark):
    days = [dt.date(2024, 1, d) for d in (1, 2, 3, 5, 6)]
    df = spark.createDataFrame([(1, d, "ok") for d in days], "k int, day date, status string")
    got = windows.runs(df, ["k"], "day", "status", "ok", 3)
    assert sorted(r["day"].day for r in got.collect()) == [1, 2, 3]


def test_gray_list_does_not_depend_on_bins(spark):
    df = spark.createDataFrame([("a", i % 7, i % 5) for i in range(40)] + [("b", 1, 1)], "k string, v int, n int").distinct()
    results = [sorted(map(tuple, cardinality.gray_list(df, "v", ["k"], [F.desc("n")], 3, bins).collect())) for bins in (1, 5, 100)]
    assert results[0] == results[1] == results[2]
    assert {r[0] for r in results[0]} == {"a"} and len(results[0]) == 3


@pytest.mark.parametrize("hashed", [False, True])
def test_enforcement(spark, hashed):
    day = dt.date(2024, 1, 1)
    df = spark.createDataFrame([("x", "m", day, "A"), ("x", "m", day, "b"), ("y", "m", day, "c"), ("x", "m", day, None)], "app_id string, media_source string, day date, campaign string")
    listed = spark.createDataFrame([("x", "m", day, "a")], df.schema)
    field = cardinality.GrayField("campaign", ignore_case=True)
    got = cardinality.enforce(df, cardinality.GrayConfig((field,), hash_values=hashed), lambda f: listed, "day")
    assert sorted((r["campaign"] or "" for r in got.collect())) == ["", "A", "c", "other"]


def test_salted_group_by_equals_plain(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id", (F.col("id") * 0.5).alias("v"))
    metrics = {"n": ("count", "*"), "s": ("sum", "v"), "a": ("avg", "v"), "lo": ("min", "id"), "hi": ("max", "id")}
    got = skew.salted_group_by(df, ["k"], metrics, 7, ["id"]).orderBy("k").collect()
    want = df.groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.avg("v").alias("a"), F.min("id").alias("lo"), F.max("id").alias("hi")).orderBy("k").collect()
    assert got == want
    with pytest.raises(ValueError):
        skew.salted_group_by(df, ["k"], {"d": ("count_distinct", "v")}, 7, ["id"])
    with pytest.raises(ValueError):
        skew.salt(0, "id")


def test_null_skew_join_equals_left_join(spark):
    left = spark.range(500).select("id", F.when(F.col("id") % 3 == 0, F.col("id") % 10).alias("k"))
    right = spark.createDataFrame([(0, "a"), (3, "b"), (3, "c"), (None, "never")], "k long, name string")
    got = skew.null_skew_left_join(left, right, "k", 20).select("id", "k", "name")
    want = left.join(right, "k", "left").select("id", "k", "name")
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_sliding_period_equals_recount(spark):
    events = spark.range(300).select(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 20).cast("int")).alias("d"), (F.col("id") % 7).alias("u"), (F.col("id") % 2).alias("a"), F.lit("x").alias("act"), F.lit("y").alias("mod"))
    days = usage.daily(events, "d", "u", "a", "act", "mod")
    moved = usage.slide(usage.period(days, "2024-01-10", 5), days, "2024-01-06", "2024-01-11")
    again = usage.period(days, "2024-01-11", 5)
    assert sorted(map(tuple, moved.collect())) == sorted(map(tuple, again.collect()))


def test_pivot_keeps_the_total(spark):
    df = spark.range(100).select((F.col("id") % 4).alias("k"), (F.col("id") % 3).cast("string").alias("p"), "id")
    wide = aggregates.rename_columns(aggregates.pivot(df, ["k"], "p", ["0", "1", "2"], [F.sum("id")]), {"k"}, "_sum")
    assert wide.columns == ["k", "0_sum", "1_sum", "2_sum"]
    assert sum(x or 0 for r in wide.collect() for x in r[1:]) == sum(range(100))


def test_user_defined_type(spark):
    from pyspark.sql.types import StructField, StructType

    df = spark.createDataFrame([(FastString("x"),), (FastString("y"),)], StructType([StructField("s", FastStringType())]))
    assert [str(r[0]) for r in df.collect()] == ["x", "y"]
    assert FastString("a") < FastString("b")


def test_kafka_options():
    got = kafka.source_options("h:1", subscribe="t", startingOffsets="earliest", kafka__security__protocol="SSL")
    assert got["kafka.security.protocol"] == "SSL"
    for bad in ({}, {"subscribe": "a", "assign": "b"}, {"subscribe": "a", "nonsense": "b"}):
        with pytest.raises(ValueError):
            kafka.source_options("h:1", **bad)


def test_kafka_sink_needs_one_topic(spark):
    df = spark.range(1).select(F.col("id").alias("k"))
    with_topic = kafka.payload(df, "k", ["k"], "t")
    assert with_topic.columns == ["key", "value", "topic"]
    assert kafka.sink_options("h:1", kafka.payload(df, "k", ["k"]), "t")["topic"] == "t"
    with pytest.raises(ValueError):
        kafka.sink_options("h:1", with_topic, "t")


def test_date_lists():
    assert files.dates(dt.date(2024, 3, 1), 2) == [dt.date(2024, 3, 1), dt.date(2024, 2, 29)]
    assert files.millis(dt.date(1970, 1, 2)) == 86_400_000


def test_generators(spark):
    assert files.sensors(spark, 100).select("sensorType").distinct().count() <= 8
    assert files.sensors(spark, 10).where("maxRange < minRange").count() == 0
    assert files.scores(spark).where("score not between 1 and 50 or group_id not between 1 and 3").count() == 0
    assert files.rows(spark, [], "a int").count() == 0


def test_bucketed_tables_join_without_exchange(spark):
    from millrace.sources.files import write_bucketed

    for name in ("bucket_a", "bucket_b"):
        write_bucketed(spark.range(100), name, "id", 4)
    joined = spark.table("bucket_a").join(spark.table("bucket_b").hint("merge"), "id")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 100
    assert {"bucket_a", "bucket_b"} <= set(files.tables(spark))


def test_scan_is_pushed_down(spark, sf_dir):
    plan = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderstatus = 'F'").select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan and "o_comment" not in plan
