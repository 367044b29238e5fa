"""Streams over the tables' files, run to their end, and the batch queries they equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.plans.base import Registry, table
from millrace.plans.joining import scratch
from millrace.streaming import core, stateful

R = Registry()
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark, sf_dir, **options):
    return core.files(spark, f"{sf_dir}/event[s].parquet", EVENTS, **options)  # a stream's path is a folder or a pattern


@R.query("select event_id, user_id, value from events")
def S_file_source(spark, sf_dir):
    return core.to_storage(events(spark, sf_dir, maxFilesPerTrigger=1).select("event_id", "user_id", "value"))


@R.query("select time_bucket(interval 5 minute, ts) as start, event_type, count(*) as n from events group by all")
def S_tumbling(spark, sf_dir):
    out = core.to_memory(core.tumbling(events(spark, sf_dir), "ts", "5 minutes", ["event_type"]), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@R.query("""select time_bucket(interval 30 minute, ts) - to_minutes(30 * o) as start, event_type, count(*) as n from events, (select unnest([0, 1]) as o) group by all""")
def S_sliding(spark, sf_dir):
    out = core.to_memory(core.tumbling(events(spark, sf_dir), "ts", "1 hour", ["event_type"], "30 minutes"), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@R.query("""select time_bucket(interval 1 day, ts) as start, count(*) as n from events group by 1 having time_bucket(interval 1 day, ts) + interval 1 day <= (select max(ts) from events) - interval 10 minute""")
def S_late_data(spark, sf_dir):
    """Appended are only windows that the watermark, ten minutes behind the latest event, has passed."""
    out = core.to_memory(core.tumbling(events(spark, sf_dir), "ts", "1 day", [], watermark="10 minutes"), "append")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@R.query("select event_type, count(*) as n from events group by event_type")
def S_output_modes(spark, sf_dir):
    """Update mode: each group's last row is its count."""
    out = core.to_memory(events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n")), "update")
    return out.groupBy("event_type").agg(F.max("n").alias("n"))


@R.query("select props as url, count(*) as n from events group by props order by n desc, url")
def S_url_rank(spark, sf_dir):
    ranked = events(spark, sf_dir).groupBy(F.col("props").alias("url")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "url")
    return core.to_memory(ranked, "complete")


@R.query("""select user_id::varchar as key, round(avg(value), 6) as mean, count(*)::integer as n from
 (select user_id, value from events qualify row_number() over (partition by user_id order by ts desc) <= 10) group by user_id having count(*) = 10""")
def S_count_window(spark, sf_dir):
    timed = events(spark, sf_dir).select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    out = core.to_memory(stateful.count_window(timed, "user_id", "ts", "value", 10))
    return out.select("key", F.round("mean", 6).alias("mean"), "n")


@R.query("""select user_id::varchar as key, round(case when count(*) > 2 then avg(value) else 0 end, 6) as mean, count(*)::integer as n from
 (select user_id, value from events qualify row_number() over (partition by user_id order by ts desc) <= 10) group by user_id""")
def S_count_window_map(spark, sf_dir):
    timed = events(spark, sf_dir).select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    out = core.to_memory(stateful.latest_mean(timed, "user_id", "ts", "value", 10), "update")
    return out.select("key", F.round("mean", 6).alias("mean"), "n")


@R.query("select event_id, user_id from events")
def S_dedup(spark, sf_dir):
    """Every event twice, and once again after deduplication."""
    e = events(spark, sf_dir).select("event_id", "user_id", "ts")
    return core.to_storage(core.deduplicate(e.union(e), ["event_id"], "ts", "1 hour").select("event_id", "user_id"))


@R.query("select e.event_id, round(e.value * (p.p_retailprice - p.p_size) + p.p_size, 6) as reading from events e join part p on e.user_id = p.p_partkey")
def S_stream_static_join(spark, sf_dir):
    sensors = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("user_id"), F.col("p_size").cast("double").alias("minRange"), F.col("p_retailprice").alias("maxRange"))
    out = core.to_storage(core.denormalise(events(spark, sf_dir), sensors, "user_id").select("event_id", "value"))
    return out.select("event_id", F.round("value", 6).alias("reading"))


@R.query("select event_id, event_type from events where event_type = 'error'")
def S_file_sink(spark, sf_dir):
    at = scratch(spark)
    core.to_files(events(spark, sf_dir).where("event_type = 'error'").select("event_id", "event_type"), at, core.checkpoint_folder(spark)).awaitTermination()
    return spark.read.schema("event_id long, event_type string").parquet(at)


@R.query("select event_type, count(*) as n from events group by event_type")
def S_idempotent(spark, sf_dir):
    """A sink that is given each batch twice, as after a failure, and keeps it once."""
    at = scratch(spark)
    folder = lambda number: spark._jvm.org.apache.hadoop.fs.Path(f"{at}/batch={number}/_SUCCESS")

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{at}/batch={number}")

    def done(number):  # the storage knows, also after a restart
        return folder(number).getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder(number))

    sink = core.once_per_batch(write, done)

    def twice(batch, number):
        sink(batch, number)
        sink(batch, number)

    stream = events(spark, sf_dir).select("event_id", "event_type")
    stream.writeStream.foreachBatch(twice).option("checkpointLocation", core.checkpoint_folder(spark)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(at).groupBy("event_type").agg(F.count("*").alias("n"))


@R.query("select event_id from events")
def S_restart(spark, sf_dir):
    """The same stream started twice on one checkpoint: the second run finds nothing new."""
    at, state = scratch(spark), core.checkpoint_folder(spark)
    for _ in range(2):
        core.to_files(events(spark, sf_dir).select("event_id"), at, state).awaitTermination()
    return spark.read.schema("event_id long").parquet(at)


@R.query("select count(*) as n from events")
def S_progress(spark, sf_dir):
    """The rows that a query's own progress reports say it has read."""
    stream = events(spark, sf_dir).select("event_id")
    query = stream.writeStream.format("noop").option("checkpointLocation", core.checkpoint_folder(spark)).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.createDataFrame([(sum(p.numInputRows for p in query.recentProgress),)], "n long")


@R.query()
def S_event_timeout(spark, sf_dir):
    """Sessions of users that ended because nothing came for an hour of event time."""
    timed = events(spark, sf_dir).select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    return core.to_memory(stateful.sessions_by_event_time(timed, "key", "ts", 3_600_000, "10 minutes")).select("key", "first", "last", "n")
