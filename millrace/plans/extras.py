"""Queries on null fills, caching, partitioning, hashes, session windows, user-defined functions and replayable streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import udf
from millrace.operators import partitioning
from millrace.plans.base import Registry, table
from millrace.plans.joining import scratch
from millrace.plans.streams import events
from millrace.sources import files, readings
from millrace.streaming import core

R = Registry()


@R.query("""select c_custkey, coalesce(sum(o_totalprice), 0) as spent, count(o_orderkey) as orders, coalesce(min(o_orderpriority), 'none') as first_priority
 from customer left join orders on c_custkey = o_custkey group by c_custkey""")
def null_fill(spark, sf_dir):
    """Customers without orders get zeros and a word instead of nulls."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("spent"), F.count("*").alias("orders"), F.min("o_orderpriority").alias("first_priority"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left").na.fill(0, ["spent", "orders"]).na.fill("none", ["first_priority"])


@R.query("""select user_id, time_bucket(interval 1 hour, date_trunc('second', ts)) as start, round(sum(value), 4) as total from events group by all""")
def csv_strings_window(spark, sf_dir):
    """A CSV read as strings, its times parsed through seconds of the epoch, and totals per hour."""
    at = scratch(spark)
    e = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy/MM/dd HH:mm:ss").alias("time_stamp"), "user_id", F.format_string("%.17g", "value").alias("value"))
    e.write.option("header", True).csv(at)
    ts = F.unix_timestamp("time_stamp", "yyyy/MM/dd HH:mm:ss").cast("timestamp").alias("ts")
    rows = files.csv(spark, at, "time_stamp string, user_id string, value string").select(ts, F.col("user_id").cast("long").alias("user_id"), F.col("value").cast("double").alias("value"))
    w = rows.groupBy("user_id", F.window("ts", "1 hour").alias("w")).agg(F.round(F.sum("value"), 4).alias("total"))
    return w.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "total")


@R.query("select o_orderkey, o_orderdate::date as day from orders")
def to_date_format(spark, sf_dir):
    text = F.date_format("o_orderdate", "yyyyMMdd")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.to_date(text, "yyyyMMdd").alias("day"))


@R.query()
def murmur3_hash(spark, sf_dir):
    """Values as 32-bit Murmur3 hashes, as lists of values are kept in little room."""
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.sort_array(F.collect_set(F.hash("c_mktsegment"))).alias("segments"))


@R.query("select l_suppkey, count(*) as n, 1::bigint as parts from lineitem group by l_suppkey")
def repartition_by_key(spark, sf_dir):
    """Rows dealt out by a column: each key's rows are in one partition."""
    dealt = partitioning.by_columns(table(spark, sf_dir, "lineitem").select("l_suppkey"), ["l_suppkey"]).withColumn("part", F.spark_partition_id())
    return dealt.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_distinct("part").alias("parts"))


@R.query("select count(*) as n, 8::bigint as parts from orders")
def repartition_round_robin(spark, sf_dir):
    dealt = table(spark, sf_dir, "orders").select("o_orderkey").repartition(8).withColumn("part", F.spark_partition_id())
    return dealt.agg(F.count("*").alias("n"), F.count_distinct("part").alias("parts"))


@R.query("""with g as (select o_orderpriority as key, count(*) as n from orders group by 1),
 s as (select key, n, coalesce(sum(n) over (order by key rows between unbounded preceding and 1 preceding), 0) as before, sum(n) over () as total from g)
 select key, n, floor(before * 4 / total)::integer as bucket from s""")
def share_buckets(spark, sf_dir):
    """Keys in four buckets of about equal numbers of rows, in their order."""
    return partitioning.share_buckets(table(spark, sf_dir, "orders"), F.col("o_orderpriority"), 4)


@R.query("""select g, e, s, sum(s) over (partition by g order by e, i, s rows unbounded preceding) as total from
 (select l_linenumber as g, l_partkey as e, l_orderkey as i, l_quantity::bigint as s from lineitem)""")
def shared_window(spark, sf_dir):
    """Running totals of few large groups, each spread over several tasks by ranges of its order."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("g"), F.col("l_partkey").alias("e"), F.col("l_orderkey").alias("i"), F.col("l_quantity").cast("long").alias("s"))
    return partitioning.spread_running_sum(rows, "g", ["e", "i", "s"], "s", "total").select("g", "e", "s", "total")


@R.query("select event_id, p_size, p_retailprice from events join part on user_id = p_partkey")
def cached_reference(spark, sf_dir):
    """A reference side that is kept for several joins and let go of by its owner."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("user_id"), "p_size", "p_retailprice").cache()
    return table(spark, sf_dir, "events").join(part, "user_id").select("event_id", "p_size", "p_retailprice")


@R.query("""with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 1 hour then 0 else 1 end as new from events),
 s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from e)
 select user_id, min(ts) as start, max(ts) + interval 1 hour as stop, count(*) as n from s group by user_id, k""")
def session_windows(spark, sf_dir):
    """Sessions that end after an hour without events."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    w = e.groupBy("user_id", F.session_window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("stop"), "n")


@R.query("select o_orderkey, a, b from (select o_orderkey, unnest(range(1, (o_orderkey % 3) + 2)) as a from orders) t, (select unnest([10, 20]) as b) u")
def two_generators(spark, sf_dir):
    """Two lists of a row against each other, by two lateral generators."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.sequence(F.lit(1).cast("long"), F.col("o_orderkey") % 3 + 1).alias("xs"))
    return o.select("o_orderkey", F.explode("xs").alias("a")).select("o_orderkey", "a", F.explode(F.array(F.lit(10), F.lit(20))).alias("b"))


@R.query("select p_partkey, upper(p_brand[1:1]) || p_brand[2:] || '!' as shouted from part")
def registered_udf(spark, sf_dir):
    """A function registered by name and used in SQL; batches go through Arrow."""
    udf.register(spark)
    table(spark, sf_dir, "part").createOrReplaceTempView("millrace_part")
    return spark.sql("select p_partkey, millrace_shout(p_brand) as shouted from millrace_part")


@R.query("select l_returnflag, round(exp(avg(ln(l_extendedprice))), 4) as geometric from lineitem group by 1")
def registered_udaf(spark, sf_dir):
    """An aggregate of one's own over whole groups, by Arrow; the built-in way is exp(avg(ln(x)))."""
    parts = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", (F.col("l_orderkey") % 64).alias("part")).agg(F.sum(F.log("l_extendedprice")).alias("s"), F.count("*").alias("n"))
    return parts.groupBy("l_returnflag").agg(udf.exp_mean("s", "n").alias("g")).select("l_returnflag", F.round("g", 4).alias("geometric"))


@R.query("select o_orderkey, unnest(string_split(o_orderpriority, '-')) as piece from orders")
def table_function(spark, sf_dir):
    """A table function of one's own, lateral to each row."""
    udf.register(spark)
    table(spark, sf_dir, "orders").createOrReplaceTempView("millrace_orders")
    return spark.sql("select o_orderkey, piece from millrace_orders, lateral millrace_pieces(o_orderpriority, '-')")


@R.query("select count(*) as n, sum(event_id) as total from events")
def counters(spark, sf_dir):
    """Counters that the workers add to while they read, observed beside a query."""
    seen = core.observed(table(spark, sf_dir, "events"), F.count("*").alias("n"), F.sum("event_id").alias("total"))
    return spark.createDataFrame([(seen["n"], seen["total"])], "n long, total long")


@R.query("select count(*) as n from events")
def S_console(spark, sf_dir):
    """A stream to the console, and how many rows it has read."""
    return spark.createDataFrame([(core.to_console(events(spark, sf_dir).select("event_id"), rows=1),)], "n long")


@R.query("select range as id, range % 7 as sensor from range(0, 500)")
def S_replayable(spark, sf_dir):
    """A source that gives the same rows for the same offsets, read to its end."""
    return core.to_memory(readings.stream(spark, 500, 7).select("id", "sensor"), trigger={"processingTime": "100 milliseconds"}, rows=500)


@R.query("""with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 1 hour then 0 else 1 end as new from events),
 s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from e)
 select user_id, min(ts) as start, count(*) as n from s group by user_id, k having max(ts) + interval 1 hour <= (select max(ts) from events) - interval 10 minute""")
def S_session(spark, sf_dir):
    """Session windows of a stream; appended are those that the watermark has passed."""
    e = events(spark, sf_dir).select("user_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", "10 minutes")
    w = e.groupBy("user_id", F.session_window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return core.to_storage(w.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n"))


@R.query("select range as id, 's' || range % 5 as stationId from range(0, 200)")
def weather_readings(spark, sf_dir):
    """Generated weather events; what is random in them is left out here."""
    return readings.weather(spark, 200, 5).select("id", "stationId")


@R.query("""select user_id, event_type, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as r from events) where r = 1""")
def latest_total_order(spark, sf_dir):
    """The latest event of each kind; of equal times the greatest id."""
    w = Window.partitionBy("user_id", "event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf_dir, "events").withColumn("r", F.row_number().over(w)).where("r = 1").select("user_id", "event_type", "value")
