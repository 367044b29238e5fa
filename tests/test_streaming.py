"""Streams: state, timeouts, restarts, monitoring and the replay server."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from millrace.plans import catalog
from millrace.streaming import core, stateful
from millrace.streaming.replay import Replay


def folder(spark, tmp_path, batches, schema):
    """A folder with one file for each batch, in order of time."""
    at = tmp_path / "in"
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(at))
        time.sleep(1.1 if i + 1 < len(batches) else 0)
    return str(at)


T = dt.datetime(2024, 1, 1)
SCHEMA = "key string, ts timestamp, value double"


def at(minute, value, key="a"):
    return (key, T + dt.timedelta(minutes=minute), float(value))


def test_buffer_keeps_the_newest(spark, tmp_path):
    path = folder(spark, tmp_path, [[at(i, i) for i in range(3)], [at(i, i) for i in range(3, 6)]], SCHEMA)
    out = core.to_memory(stateful.count_window(core.files(spark, path, SCHEMA, maxFilesPerTrigger=1), "key", "ts", "value", 4, least=2))
    assert [(r["n"], r["mean"]) for r in out.orderBy("last").collect()] == [(3, 1.0), (4, 3.5)]


def test_silent_keys_time_out(spark, tmp_path):
    path = folder(spark, tmp_path, [[at(0, 4)]], SCHEMA)
    df = stateful.count_window(core.files(spark, path, SCHEMA), "key", "ts", "value", 10, timeout_ms=1000)
    query = df.writeStream.format("memory").queryName("timed_out").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            time.sleep(0.5)
            if spark.table("timed_out").count():
                break
    finally:
        query.stop()
    assert [(r["n"], r["mean"]) for r in spark.table("timed_out").collect()] == [(1, 4.0)]


def test_event_time_timeout_ends_sessions(spark, tmp_path):
    path = folder(spark, tmp_path, [[at(0, 1), at(1, 1)], [at(90, 1, "b")], [at(200, 1, "c")]], SCHEMA)
    df = stateful.sessions_by_event_time(core.files(spark, path, SCHEMA, maxFilesPerTrigger=1), "key", "ts", 600_000, "1 minute")
    out = core.to_memory(df)
    assert {(r["key"], r["n"]) for r in out.collect()} == {("a", 2), ("b", 1)}


def test_late_rows_are_dropped(spark, tmp_path):
    # a row is late by the watermark of the batch before
    path = folder(spark, tmp_path, [[at(0, 1)], [at(60, 1)], [at(61, 1)], [at(1, 1), at(120, 1)]], SCHEMA)
    out = core.to_memory(core.tumbling(core.files(spark, path, SCHEMA, maxFilesPerTrigger=1), "ts", "10 minutes", [], watermark="5 minutes"))
    assert {r["start"].hour * 60 + r["start"].minute: r["n"] for r in out.collect()} == {0: 1, 60: 2}


def test_rate_and_guards(spark):
    stream = core.rate(spark, 5)
    assert stream.isStreaming and stream.columns == ["timestamp", "value"]
    with pytest.raises(AnalysisException):
        stream.count()
    with pytest.raises(ValueError):
        core.files(spark, "x", "a int", nonsense=1)


def test_listener_sees_progress(spark, tmp_path):
    listener = core.Progress()
    core.metrics_on(spark)
    spark.streams.addListener(listener)
    try:
        path = folder(spark, tmp_path, [[at(0, 1)]], SCHEMA)
        core.to_memory(core.files(spark, path, SCHEMA))
        for _ in range(40):
            if listener.ended and listener.progress:
                break
            time.sleep(0.25)
    finally:
        spark.streams.removeListener(listener)
    assert listener.started and listener.ended[-1][1] is None and sum(n for _, _, n in listener.progress) == 1


def test_socket_replay(spark, tmp_path):
    lines = ['{"a": 1}', "nonsense", '{"a": 2}']
    with Replay(lambda: lines, pause=0.01) as server:
        query = core.decode(core.socket(spark, "127.0.0.1", server.port), "a int").where(F.col("a").isNotNull()).writeStream.format("memory").queryName("replayed").option("checkpointLocation", str(tmp_path / "c")).start()
        try:
            for _ in range(60):
                time.sleep(0.25)
                if spark.table("replayed").count() == 2:
                    break
        finally:
            query.stop()
    assert sorted(r[0] for r in spark.table("replayed").collect()) == [1, 2]


@pytest.mark.parametrize("name", ["S_file_source", "S_stream_static_join", "S_dedup", "S_session"])
def test_large_results_stay_out_of_the_driver(name, spark, sf_dir):
    out = catalog.QUERIES[name](spark, sf_dir)
    shared = spark.conf.get("spark.checkpoint.dir")
    assert out.inputFiles() and all(shared in f for f in out.inputFiles()) and out.count()


@pytest.mark.parametrize("mode, want", [("append", {("a", 3), ("b", 1)}), ("complete", {("a", 3), ("b", 1)}), ("update", {("a", 1), ("a", 3), ("b", 1)})])
def test_storage_holds_what_each_mode_writes(mode, want, spark, tmp_path):
    kind = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(kind)
    path = folder(spark, tmp_path, [[at(0, 1)], [at(1, 1), at(2, 1), at(3, 1, "b")], [at(500, 1, "c")]] if mode == "append" else [[at(0, 1)], [at(1, 1), at(2, 1), at(3, 1, "b")]], SCHEMA)
    rows = core.files(spark, path, SCHEMA, maxFilesPerTrigger=1)
    if mode == "append":
        counts = core.tumbling(rows, "ts", "1 hour", ["key"], watermark="5 minutes").select("key", "n")
    else:
        counts = rows.groupBy("key").agg(F.count("*").alias("n"))
    assert set(map(tuple, core.to_storage(counts, mode).collect())) == want
    assert spark.conf.get(kind) == before
    empty = tmp_path / "none"
    empty.mkdir()
    assert core.to_storage(core.files(spark, str(empty), SCHEMA), "append" if mode == "append" else "update").count() == 0
