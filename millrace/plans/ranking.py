"""Windows, gray lists and usage statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import cardinality as C
from millrace.operators import usage as U
from millrace.operators import windows as W
from millrace.plans.base import Registry, table

R = Registry()
FIRST = """select o_orderkey, o_custkey, o_orderstatus, o_orderdate from orders where o_orderstatus = 'F' union all
 select o_orderkey, o_custkey, o_orderstatus, o_orderdate from orders where o_orderstatus <> 'F'
 qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1"""


@R.query(FIRST)
def first_row_cond(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    return W.all_and_first_others(o, F.col("o_orderstatus") == "F", "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")])


@R.query(FIRST)
def first_row_sql(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("millrace_orders")
    return spark.sql("""select o_orderkey, o_custkey, o_orderstatus, o_orderdate from millrace_orders where o_orderstatus = 'F' union all
      select o_orderkey, o_custkey, o_orderstatus, o_orderdate from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn
      from millrace_orders where o_orderstatus <> 'F') where rn = 1""")


@R.query("""select user_id, event_type, event_id, ts from events where ts <= timestamp '2024-01-20' qualify row_number() over (partition by user_id, event_type order by ts desc) = 1""")
def latest_event(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    return C.latest(e, ["user_id", "event_type"], "ts", "2024-01-20")


DAILY = """select user_id, ts::date as day, case when max(case when event_type = 'error' then 1 else 0 end) = 1 then 'failed' else 'complete' end as status from events group by all"""


@R.query(f"""with d as ({DAILY}), r as (select *, day - row_number() over (partition by user_id order by day)::integer as island from d where status = 'complete')
 select user_id, day, status, count(*) over (partition by user_id, island) as run_length from r qualify run_length >= 4""")
def consecutive_status(spark, sf_dir):
    """Users' days in runs of four or more complete days."""
    failed = F.max(F.when(F.col("event_type") == "error", 1).otherwise(0))
    days = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.when(failed == 1, "failed").otherwise("complete").alias("status"))
    return W.runs(days, ["user_id"], "day", "status", "complete", 4)


@R.query("""select conv_id, turn, role, coalesce(lag(role) over (partition by conv_id order by turn), role) as previous,
 coalesce(lag(role) over (partition by conv_id order by turn), role) is distinct from role as changed from conversations""")
def status_change(spark, sf_dir):
    return W.status_change(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id"], [F.col("turn")], "role")


@R.query("""select conv_id, turn, sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn range between 7 preceding and current row)::bigint as in_range from conversations""")
def range_frame(spark, sf_dir):
    return W.range_count(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", 7, F.col("role") == "user").select("conv_id", "turn", "in_range")


KEYS = "l_orderkey, l_linenumber, l_suppkey"


@R.query(f"""select l_partkey, {KEYS}, row_number() over o as rank, round(sum(l_quantity) over (o rows between unbounded preceding and current row), 4) as running,
 round(sum(l_quantity) over (partition by l_partkey), 4) as total from lineitem window o as (partition by l_partkey order by l_shipdate, {KEYS})""")
def cum_sum(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_quantity")
    rows = W.cumulative(l, ["l_partkey"], [F.col(c) for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey")], "l_quantity")
    return rows.select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "rank", F.round("running", 4).alias("running"), F.round("total", 4).alias("total"))


@R.query("""with a as (select l_orderkey, l_linenumber, sum(l_quantity) as q from lineitem group by all)
 select l_orderkey, l_linenumber, round(sum(q) over (partition by l_orderkey order by l_linenumber rows between current row and (l_linenumber % 3) following), 4) as forward_sum from a""")
def rolling_sum_var(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("q")).withColumn("n", 1 + F.col("l_linenumber") % 3)
    return W.forward_sum(a, ["l_orderkey"], [F.col("l_linenumber")], "q", "n", most=3).select("l_orderkey", "l_linenumber", F.round("forward_sum", 4).alias("forward_sum"))


COUNTS = "select l_partkey, l_suppkey, count(*) as n from lineitem group by all"
GRAY = "select {k}, {v} from c qualify count(*) over (partition by {k}) > 3 and row_number() over (partition by {k} order by {o}, {v}) <= 3"


@R.query(f"with c as ({COUNTS}) " + GRAY.format(k="l_partkey", v="l_suppkey", o="n desc"))
def gray_list(spark, sf_dir):
    counts = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    return C.gray_list(counts, "l_suppkey", ["l_partkey"], [F.desc("n")], 3)


EVENTS = """select user_id % 5 as app, props as event, ts::date as day, count(*) as n from events group by all"""


@R.query(f"""with e as ({EVENTS}), c as (select app, event, day, n from e where day <= date '2024-01-20' qualify row_number() over (partition by app, event order by day desc) = 1) """ + GRAY.format(k="app", v="event", o="day desc, n desc"))
def events_gray_list(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 5).alias("app"), F.col("props").alias("event"), F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return C.event_gray_list(e, "app", "event", "day", "n", "2024-01-20", 3)


LISTS = """select ts::date as day, user_id % 5 as app_id, event_type as media_source, 'e' || (event_id % 7) as campaign from events"""


def lists(spark, sf_dir):
    """What each day's list lets through: the campaigns of even events."""
    e = table(spark, sf_dir, "events")
    return e.select(F.to_date("ts").alias("day"), (F.col("user_id") % 5).alias("app_id"), F.col("event_type").alias("media_source"), F.concat(F.lit("e"), (F.col("event_id") % 7).cast("string")).alias("campaign"), "event_id")


FIELD = C.GrayField("campaign", 3)


@R.query(f"""with l as (select *, row_number() over () as rn from ({LISTS}) where campaign < 'e3' and app_id <> 4)
 select app_id::varchar || '|' || media_source || '|' || day::varchar as gray_key, string_agg(distinct campaign, ',' order by campaign) as values from l group by 1""")
def gray_list_sets(spark, sf_dir):
    listed = lists(spark, sf_dir).where("campaign < 'e3' and app_id != 4").select("day", "app_id", "media_source", "campaign")
    return C.list_sets(listed, FIELD, "day").select("gray_key", F.array_join("gray_set", ",").alias("values"))


@R.query(f"""with r as (select ts::date as day, user_id % 5 as app_id, event_type as media_source, 'e' || (event_id % 7) as campaign, event_id from events),
 l as (select distinct day, app_id, media_source, campaign from r where campaign < 'e3' and app_id <> 4), k as (select distinct day, app_id, media_source from l)
 select r.event_id, case when k.day is not null and l.day is null then 'other' else r.campaign end as campaign from r left join k using (day, app_id, media_source)
 left join l on r.day = l.day and r.app_id = l.app_id and r.media_source = l.media_source and r.campaign = l.campaign""")
def enforce_cardinality(spark, sf_dir):
    rows = lists(spark, sf_dir)
    load = lambda f: rows.where("campaign < 'e3' and app_id != 4").select("day", "app_id", "media_source", f.name)
    return C.enforce(rows, C.GrayConfig((FIELD,)), load, "day").select("event_id", "campaign")


BOTH = """with e as (select ts::date as day, user_id, user_id % 5 as account, event_type, props from events),
 d as (select day, 'user' as level, user_id::varchar as id, count(event_type) as activities, count(props) as modules from e group by all
 union all select day, 'account', account::varchar, count(event_type), count(props) from e group by all)"""


def days(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.to_date("ts").alias("d"), "user_id", (F.col("user_id") % 5).alias("account"), "event_type", "props")
    return U.daily(e, "d", "user_id", "account", "event_type", "props")


@R.query(BOTH + " select day, level, id, activities, modules from d")
def usage_daily(spark, sf_dir):
    return days(spark, sf_dir)


PERIOD = " select level, id, sum(activities)::bigint as activities, sum(modules)::bigint as modules from d where day between date '{0}' and date '{1}' group by all"


@R.query(BOTH + PERIOD.format("2024-01-14", "2024-01-20"))
def usage_period(spark, sf_dir):
    return U.period(days(spark, sf_dir), "2024-01-20", 7)


@R.query(BOTH + PERIOD.format("2024-01-15", "2024-01-21"))
def usage_evict_delta(spark, sf_dir):
    """Yesterday's week moved on by a day."""
    d = days(spark, sf_dir)
    return U.slide(U.period(d, "2024-01-20", 7), d, "2024-01-14", "2024-01-21")


@R.query("""with e as (select date '2024-01-30' - ts::date as age, user_id % 5 as account, user_id from events where ts::date <= date '2024-01-30'),
 p as (select unnest([1, 3, 7, 14, 30, 90, 180, 365]) as period) select account, period, count(*) as activities, count(distinct user_id) as users from e join p on age < period group by all""")
def usage_multi_period(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("ts", "user_id", (F.col("user_id") % 5).alias("acc"))
    return U.multi_period(e, "ts", "user_id", "acc", "2024-01-30")


URLS = "regexp_replace(url, '^https?://[^/]+', '')"


@R.query(f"""with p as (select {URLS} as url, row_number() over (order by page_id, {URLS}) - 1 as page, count(*) over () as pages from pages where page_id is not null),
 r as (select day(e.ts)::integer as day, p.url from events e join p on e.event_id % p.pages = p.page)
 select day, url, count(*) as n from r group by all""")
def top_urls_daily(spark, sf_dir):
    """Requests by day of the month, the most asked first; events stand in for visits to pages, spread over all of them by rank."""
    path = F.regexp_replace("url", "^https?://[^/]+", "")
    p = table(spark, sf_dir, "pages").where("page_id is not null").select("page_id", path.alias("url"), F.floor(F.col("page_id") / 4096).alias("range"))
    # ranks without one task that sees all pages: those of smaller ranges, and the place within the range
    sizes = p.groupBy("range").agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("range").orderBy("page_id", "url"))
    p = p.withColumn("place", place).join(sizes.select("range", before.alias("before")), "range").select((F.col("before") + F.col("place") - 1).alias("page"), "url")
    total = sizes.agg(F.sum("size").alias("pages"))
    e = table(spark, sf_dir, "events").select(F.dayofmonth("ts").alias("day"), "event_id").crossJoin(F.broadcast(total))  # one row
    e = e.select("day", F.pmod("event_id", "pages").alias("page"))
    return e.join(p, "page").groupBy("day", "url").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "day", "url")


@R.query("""select time_bucket(interval 5 minute, ts) as start, user_id % 5 as host, count(*) as n, round(max(value), 6) as top, round(100 - (100 - max(value) + 2) / 100 * 100, 6) as used from events group by all""")
def server_kpi_window(spark, sf_dir):
    """Five-minute KPIs per host, gathered as maps and united; the last of a repeated key counts."""
    from millrace.functions import exprs, nested

    e = table(spark, sf_dir, "events").select("ts", (F.col("user_id") % 5).alias("host"), "value")
    by = e.groupBy(F.window("ts", "5 minutes").alias("w"), "host")
    values = by.agg(F.count("*").alias("n"), F.sort_array(F.collect_list("value")).alias("vs"))
    rows = values.select("w", "host", "n", nested.union_maps(F.transform("vs", lambda x: F.create_map(F.lit("top"), x))).alias("kpi"))
    used = exprs.used_memory(F.lit(100.0), F.col("kpi")["top"], F.lit(1.0), F.lit(1.0))
    return rows.select(F.col("w.start").alias("start"), "host", "n", F.round(F.col("kpi")["top"], 6).alias("top"), F.round(used, 6).alias("used"))


@R.query("select time_bucket(interval 5 minute, ts) as start, event_type, count(*) as n from events group by all")
def tumbling_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.window("ts", "5 minutes").alias("w"), "event_type").agg(F.count("*").alias("n")).select("w.start", "event_type", "n")


@R.query("""select time_bucket(interval 30 minute, ts) - to_minutes(30 * o) as start, event_type, count(*) as n from events, (select unnest([0, 1]) as o) group by all""")
def sliding_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour", "30 minutes").alias("w"), "event_type").agg(F.count("*").alias("n")).select("w.start", "event_type", "n")
