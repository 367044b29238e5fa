"""Projections, predicates, conditional columns and scalar functions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import exprs, nested
from millrace.plans.base import Registry, table

R = Registry()
#: Customers with manufactured nulls: the tables have none.
SPARSE = """select c_custkey as id, nullif(c_mktsegment, 'BUILDING') as name, case when c_nationkey % 3 = 0 then null else c_nationkey end as city,
 case when c_custkey % 4 = 0 then null else 'S' || cast(c_custkey % 7 as varchar) end as state from customer"""


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("id"),
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("name"),
        F.when(F.col("c_nationkey") % 3 != 0, F.col("c_nationkey")).alias("city"),
        F.when(F.col("c_custkey") % 4 != 0, F.concat(F.lit("S"), (F.col("c_custkey") % 7).cast("string"))).alias("state"),
    )


@R.query(f"with p as ({SPARSE}) select id, name, city, state from p where state is null and (city is null or name is null)")
def filter_sql_string(spark, sf_dir):
    return sparse(spark, sf_dir).filter("State IS NULL AND (City IS NULL OR Name IS NULL)")


@R.query(f"with p as ({SPARSE}) select id, state from p where state is distinct from 'S3'")
def eq_null_safe(spark, sf_dir):
    return sparse(spark, sf_dir).where(exprs.differs_or_null("state", "S3")).select("id", "state")


@R.query("select o_orderkey, o_orderstatus from orders where o_orderstatus = 'F'")
def optional_filter(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return exprs.optional_filter(exprs.optional_filter(orders, None), "o_orderstatus = 'F'")


@R.query("select o_orderkey, case when o_orderpriority = '1-URGENT' then o_orderpriority end as urgent, case when o_custkey % 5 = 2 then 2 end as two from orders")
def null_unless_equal(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", (F.col("o_custkey") % 5).cast("int").alias("two"))
    return o.select("o_orderkey", exprs.null_unless_equal("o_orderpriority", "1-URGENT").alias("urgent"), exprs.null_unless_equal("two", 2).alias("two"))


@R.query("""select p_partkey, case when p_size is null then 'none' when p_size between 0 and 10 then '0-10' when p_size between 11 and 20 then '11-20'
 when p_size between 21 and 30 then '21-30' when p_size between 31 and 40 then '31-40' when p_size > 40 then '40+' else 'none' end as bucket from part""")
def case_bucket(spark, sf_dir):
    bucket = exprs.case_bucket("p_size", [(0, 10), (11, 20), (21, 30), (31, 40)], "40+")
    return table(spark, sf_dir, "part").select("p_partkey", bucket.alias("bucket"))


@R.query("select event_id, value from events where try_cast(regexp_extract(props, '[0-9]+') as integer) between 10 and 19")
def option_filter(spark, sf_dir):
    k = F.regexp_extract("props", "[0-9]+", 0).try_cast("int")
    return table(spark, sf_dir, "events").withColumn("k", F.when(k.between(10, 19), k)).where("k is not null").select("event_id", "value")


@R.query("select s_suppkey, s_name from supplier where s_name like '%7'")
def typed_filter(spark, sf_dir):
    return table(spark, sf_dir, "supplier").where(F.col("s_name").endswith("7")).select("s_suppkey", "s_name")


@R.query("""select event_id as sensor_id, round(value, 6) as reading from events where event_id % 3 <> 0""")
def parse_or_drop(spark, sf_dir):
    """Texts of a sensor's readings, every third one malformed."""
    line = F.when(F.col("event_id") % 3 == 0, F.concat_ws(",", F.lit("x"), F.col("value").cast("string"))).otherwise(F.concat_ws(",", F.col("event_id").cast("string"), F.col("value").cast("string")))
    part = F.split("line", ",")
    rows = table(spark, sf_dir, "events").select(line.alias("line")).select(F.try_element_at(part, F.lit(1)).try_cast("long").alias("sensor_id"), F.round(F.try_element_at(part, F.lit(2)).try_cast("double"), 6).alias("reading"))
    return rows.dropna()


@R.query("select c_custkey, (c_name || ' ' || c_mktsegment || ' ') as text from customer")
def template_replace(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("template", F.lit("Name + Segment + Unknown"))
    return c.select("c_custkey", exprs.template_replace("template", {"Name": "c_name", "Segment": "c_mktsegment"}).alias("text"))


@R.query("select c_custkey, c_name as line_name, c_nationkey as line_nation, c_acctbal as line_balance from customer")
def nest_struct(spark, sf_dir):
    groups = nested.nest({"line": ["c_name", "c_nationkey", "c_acctbal"]})
    rows = table(spark, sf_dir, "customer").select("c_custkey", *groups)
    return rows.select("c_custkey", F.col("line.c_name").alias("line_name"), F.col("line.c_nationkey").alias("line_nation"), F.col("line.c_acctbal").alias("line_balance"))


@R.query("select event_id, user_id, event_type from events")
def struct_expand(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.struct("event_id", "user_id", "event_type").alias("value")).select("value.*")


@R.query("select r_regionkey, 1 as a, 2 as b from region")
def typed_literal(spark, sf_dir):
    pair = F.struct(F.lit(1).alias("a"), F.lit(2).alias("b"))
    return table(spark, sf_dir, "region").select("r_regionkey", pair.alias("pair")).select("r_regionkey", "pair.*")


@R.query("""select p_partkey, list_reduce(list_sort(string_split(p_name, '')), lambda x, y: x || y) as sorted from part where length(p_name) > 0""")
def sort_chars(spark, sf_dir):
    return table(spark, sf_dir, "part").where("length(p_name) > 0").select("p_partkey", exprs.sort_chars("p_name").alias("sorted"))


@R.query("""select doc_id, array_to_string(list_transform(string_split(text, ''), lambda c: case when ord(c) > 127
 then '\\u' || lpad(lower(to_hex(ord(c))), 4, '0') else c end), '') as escaped from documents""")
def escape_unicode(spark, sf_dir):
    """The whole texts of documents in ASCII."""
    return table(spark, sf_dir, "documents").select("doc_id", exprs.escape_unicode("text").alias("escaped"))


@R.query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '.00Z' as iso from orders")
def iso_format(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", exprs.iso_format("o_orderdate").alias("iso"))


@R.query("""select o_orderkey, case when o_orderkey % 3 = 0 then timestamp '2020-01-01 00:00:00' else date_trunc('second', o_orderdate) end as ts from orders""")
def invalid_ts_default(spark, sf_dir):
    day = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    text = F.when(F.col("o_orderkey") % 3 != 0, day).when(F.col("o_orderkey") % 2 == 0, F.lit("2019-10-41 10:00:00"))
    now = F.lit(dt.datetime(2020, 1, 1, tzinfo=dt.UTC)).cast("timestamp")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))
    return rows.select("o_orderkey", exprs.timestamp_or("text", "yyyy-MM-dd HH:mm:ss", now).cast("timestamp_ntz").alias("ts"))


@R.query("""with o as (select o_orderkey, date_trunc('week', o_orderdate)::date as a, (date_trunc('week', o_orderdate) + to_days(7 * (o_orderkey % 5)::integer))::date as b from orders)
 select o_orderkey, array_to_string(list_transform(generate_series(a, b, interval 7 day), lambda d: isoyear(d)::varchar || lpad(week(d)::varchar, 2, '0')), ',') as weeks from o""")
def week_range(spark, sf_dir):
    first = F.date_trunc("week", "o_orderdate").cast("date")
    last = F.date_add(first, (F.col("o_orderkey") % 5 * 7).cast("int"))
    text = F.concat_ws(" - ", exprs.iso_year_week(first), exprs.iso_year_week(last))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))
    return rows.select("o_orderkey", F.array_join(exprs.week_range("text"), ",").alias("weeks"))


@R.query("select event_id, cast(json_extract_string(props, '$.k') as integer) as k from events")
def from_json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int").alias("p")).select("event_id", "p.k")


URL = "regexp_replace(url, '^https?://[^/]+', '')"


@R.query(f"""with r as (select page_id, {URL} as url from pages), e as (select page_id, url, regexp_extract(right(url, 5), '\\..*', 0) as ending from r where url <> '')
 select page_id, url from e where ending in ('.html', '.htm', '')""")
def content_pages(spark, sf_dir):
    """Requests for pages made from their addresses, and those that ask for content."""
    path = F.regexp_replace("url", "^https?://[^/]+", "")
    request = F.concat(F.lit("GET "), path, F.lit(" HTTP/1.0"))
    rows = table(spark, sf_dir, "pages").select("page_id", exprs.requested_url(request).alias("url")).where("url != ''")
    return rows.where(exprs.ending(F.col("url")).isin(*exprs.PAGE_ENDINGS))


@R.query(f"select {URL} as url, count(*) as n from pages group by 1 order by n desc, url limit 10")
def topk_urls(spark, sf_dir):
    path = F.regexp_replace("url", "^https?://[^/]+", "")
    return table(spark, sf_dir, "pages").groupBy(path.alias("url")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "url").limit(10)


@R.query("""select e.event_id, p.p_partkey as sensor_id, round(e.value * (p.p_retailprice - p.p_size) + p.p_size, 6) as reading from events e join part p on e.user_id = p.p_partkey""")
def sensor_denormalise(spark, sf_dir):
    """Normalised readings in the ranges of their sensors; parts stand in for sensors."""
    sensors = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sensor_id"), F.col("p_size").cast("double").alias("low"), F.col("p_retailprice").alias("high"))
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("sensor_id"), "value").join(sensors, "sensor_id")
    return rows.select("event_id", "sensor_id", F.round(F.col("value") * (F.col("high") - F.col("low")) + F.col("low"), 6).alias("reading"))


@R.query("""select (vec_id * 1) as vec_id, list_count(list_filter(embedding, lambda x: x > 0)) as positives from embeddings""")
def hof_filter(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size(F.filter("embedding", lambda x: x > 0)).cast("long").alias("positives"))


@R.query("""select vec_id, round(list_sum(list_transform(embedding, lambda x, i: x::double * (i - 1))), 6) as weighted from embeddings""")
def hof_transform(spark, sf_dir):
    ranked = F.transform("embedding", lambda x, i: x.cast("double") * i)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(ranked, F.lit(0.0), lambda a, x: a + x), 6).alias("weighted"))


@R.query("select vec_id, round(list_sum(list_transform(embedding, lambda x: x::double * x::double)), 6) as norm from embeddings")
def hof_aggregate(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 6).alias("norm"))


@R.query("select vec_id, list_count(list_filter(embedding, lambda x: x > 0.3)) > 0 as found from embeddings")
def hof_exists(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.exists("embedding", lambda x: x > F.lit(0.3).cast("float")).alias("found"))


@R.query("""select conv_id, list_count(a) as n, coalesce(list_sum(list_filter(list_transform(list_zip(a, a[2:]), lambda p: p[1] * 10 + p[2]), lambda x: x is not null)), 0)::bigint as total,
 len(list_filter(list_transform(list_zip(a, a[2:]), lambda p: p[2]), lambda x: x is null)) as padded
 from (select conv_id, list(turn order by turn) as a from conversations group by conv_id) group by all""")
def hof_zip_with(spark, sf_dir):
    """Each conversation's turns zipped with the turns after them; the shorter list is padded with null."""
    a = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("a"))
    zipped = F.zip_with("a", F.expr("slice(a, 2, size(a))"), lambda x, y: F.struct((x * 10 + y).alias("v"), y.alias("y")))
    total = F.aggregate(F.filter(zipped, lambda z: z["v"].isNotNull()), F.lit(0).cast("long"), lambda acc, z: acc + z["v"])
    return a.select("conv_id", F.size("a").cast("long").alias("n"), total.alias("total"), F.size(F.filter(zipped, lambda z: z["y"].isNull())).cast("long").alias("padded"))


@R.query("""with a as (select conv_id, list(case when turn % 2 = 1 then role end order by turn) as a from conversations group by conv_id)
 select conv_id, list_filter(a, lambda x: x is not null)[1] as first_role, list_count(list_filter(a, lambda x: x is not null)) as present from a""")
def first_non_null_nested(spark, sf_dir):
    """The first role present in an array of structs, where every other one is null."""
    info = F.struct("turn", F.when(F.col("turn") % 2 == 1, F.col("role")).alias("role"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(info)).alias("info"))
    roles = F.col("info.role")
    return rows.select("conv_id", nested.first_present(roles).alias("first_role"), F.size(F.array_compact(roles)).cast("long").alias("present"))


@R.query("""select vec_id, list_position(embedding, embedding[5]) as place, round(list_reverse(embedding)[1]::double, 6) as last, 64 - 1 - 0 as left_over from embeddings
 where list_count(embedding) = 64""")
def hof_misc(spark, sf_dir):
    """array_position, reverse, and array_remove, which never takes null out (array_compact does)."""
    e = table(spark, sf_dir, "embeddings").where(F.size("embedding") == 64)
    fifth = F.element_at("embedding", 5)
    place = F.array_position("embedding", fifth)
    left = F.size(F.array_compact(F.transform("embedding", lambda x, i: F.when(i != 7, x))))
    return e.select("vec_id", place.cast("int").alias("place"), F.round(F.element_at(F.reverse("embedding"), 1).cast("double"), 6).alias("last"), left.alias("left_over"))


TOP = """with i as (select *, row_number() over () as rid from lineitem), u as (select rid, l_orderkey, l_partkey, l_suppkey, l_linenumber, unnest([{'v': l_quantity, 'k': 'l_quantity'}, {'v': l_discount * 100, 'k': 'discount'}, {'v': l_tax * 100, 'k': 'tax'}]) as e from i),
 r as (select *, row_number() over (partition by rid order by e.v desc, e.k) as rn from u)"""


def top_measures(spark, sf_dir, n):
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", (F.col("l_discount") * 100).alias("discount"), (F.col("l_tax") * 100).alias("tax"))
    return l.withColumn("top", nested.row_top_n(["l_quantity", "discount", "tax"], n))


@R.query(TOP + " select l_orderkey, l_partkey, l_suppkey, l_linenumber, rn::integer as rank, e.k as name, round(e.v, 6) as value from r where rn <= 2")
def row_topn(spark, sf_dir):
    rows = top_measures(spark, sf_dir, 2).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.posexplode("top").alias("rank", "e"))
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", (F.col("rank") + 1).alias("rank"), F.col("e.name").alias("name"), F.round("e.value", 6).alias("value"))


@R.query(TOP + """ select l_orderkey, l_partkey, l_suppkey, l_linenumber, max(case when rn = 1 then e.k end) as first_name, max(case when rn = 2 then e.k end) as second_name from r group by rid, l_orderkey, l_partkey, l_suppkey, l_linenumber""")
def row_topn_pivot(spark, sf_dir):
    rows = top_measures(spark, sf_dir, 2)
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("top")[0]["name"].alias("first_name"), F.col("top")[1]["name"].alias("second_name"))


@R.query("select event_id, i.key as key, i.value as value from (select event_id, unnest([{'key': 'user', 'value': user_id}, {'key': 'double', 'value': 2 * user_id}]) as i from events)")
def explode_map_struct(spark, sf_dir):
    models = F.create_map(F.lit("user"), F.struct(F.col("user_id").alias("n")), F.lit("double"), F.struct((2 * F.col("user_id")).alias("n")))
    return table(spark, sf_dir, "events").select("event_id", F.explode(models).alias("key", "m")).select("event_id", "key", F.col("m.n").alias("value"))
