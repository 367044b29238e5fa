"""Aggregates, grouping sets, pivots, set operations and text statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import nested
from millrace.operators import aggregates as A
from millrace.operators import skew
from millrace.plans.base import Registry, table
from millrace.plans.predicates import SPARSE, sparse

R = Registry()
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@R.query("select count(*) as n from lineitem")
def global_count(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.count("*").alias("n"))


@R.query(f"with p as ({SPARSE}) select state, city, count(*) as n from p group by all")
def group_count_nulls(spark, sf_dir):
    return sparse(spark, sf_dir).groupBy("state", "city").agg(F.count("*").alias("n"))


@R.query("select l_returnflag, sum(l_partkey)::bigint as parts, count(distinct l_suppkey) as suppliers from lineitem group by l_returnflag")
def sum_count_distinct(spark, sf_dir):
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("millrace_lineitem")
    return spark.sql("select l_returnflag, sum(l_partkey) as parts, count(distinct l_suppkey) as suppliers from millrace_lineitem group by l_returnflag")


@R.query("""select l_returnflag || ', ' || l_linestatus as key, max(cast(l_quantity as decimal(18, 2)))::double as most, round(avg(cast(l_quantity as decimal(18, 2)))::double, 6) as mean
 from lineitem group by 1""")
def decimal_avg(spark, sf_dir):
    q = F.col("l_quantity").cast("decimal(18,2)")
    return A.by_composite_key(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], [F.max(q).cast("double").alias("most"), F.round(F.avg(q).cast("double"), 6).alias("mean")])


@R.query("""select l_returnflag, l_linestatus, grouping(l_returnflag, l_linestatus)::bigint as gid, count(*) as n, round(sum(l_quantity), 4) as quantity
 from lineitem group by cube (l_returnflag, l_linestatus)""")
def cube_grouping_id(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping_id().alias("gid"), F.count("*").alias("n"), F.round(F.sum("l_quantity"), 4).alias("quantity"))
    return rows.orderBy(F.desc("gid"), "l_returnflag", "l_linestatus")


@R.query("select user_id, event_type, count(*) as n from events group by rollup (user_id, event_type)")
def rollup_usage(spark, sf_dir):
    return table(spark, sf_dir, "events").rollup("user_id", "event_type").agg(F.count("*").alias("n"))


@R.query("select year(o_orderdate)::integer as year, " + ", ".join(f"round(avg(o_totalprice) filter (where o_orderpriority = '{p}'), 2) as \"{p}_mean\"" for p in PRIORITIES) + " from orders group by 1")
def pivot_rename(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    wide = A.pivot(o, ["year"], "o_orderpriority", PRIORITIES, [F.round(F.avg("o_totalprice"), 2)])
    return A.rename_columns(wide, {"year"}, "_mean")


@R.query("select year(o_orderdate)::integer as year, " + ", ".join(f"round(avg(o_totalprice) filter (where o_orderstatus = '{s}'), 2) as {s}_cost, min(o_orderpriority) filter (where o_orderstatus = '{s}') as {s}_ship" for s in "FOP") + " from orders group by 1")
def pivot_multi(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    return A.pivot(o, ["year"], "o_orderstatus", list("FOP"), [F.round(F.avg("o_totalprice"), 2).alias("cost"), F.min("o_orderpriority").alias("ship")])


@R.query("select event_id, user_id::varchar as user, event_type as type, case when event_id % 2 = 0 then 'yes' end as even from events")
def kv_text_pivot(spark, sf_dir):
    text = F.concat_ws(" || ", F.concat(F.lit("user="), F.col("user_id").cast("string")), F.concat(F.lit("type="), F.col("event_type")), F.when(F.col("event_id") % 2 == 0, F.lit("even=yes")))
    return A.key_values(table(spark, sf_dir, "events").select("event_id", text.alias("vals")), "event_id", "vals", ["user", "type", "even"])


@R.query("select o_custkey, string_agg(o_orderkey::varchar || ':' || o_orderstatus, ',' order by o_orderkey) as orders, string_agg(distinct o_orderstatus, ',' order by o_orderstatus) as statuses from orders group by o_custkey")
def collect_structs(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rows = A.rows_as_list(o, "o_custkey", ["o_orderkey", "o_orderstatus"], "list")
    sets = o.groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_set("o_orderstatus")), ",").alias("statuses"))
    text = F.array_join(F.transform("list", lambda x: F.concat(x["o_orderkey"].cast("string"), F.lit(":"), x["o_orderstatus"])), ",")
    return rows.select("o_custkey", text.alias("orders")).join(sets, "o_custkey")


@R.query("""with s as (select l_returnflag, l_linenumber as k, sum(l_quantity)::bigint as s from lineitem group by all)
 select l_returnflag, string_agg(k::varchar || '=' || s::varchar, ',' order by k) as sums from s group by 1""")
def map_merge_sum(spark, sf_dir):
    maps = F.create_map("l_linenumber", F.struct(F.col("l_quantity").cast("long").alias("value1"), F.col("l_discount").alias("value2")))
    rows = nested.merge_sum(table(spark, sf_dir, "lineitem").select("l_returnflag", maps.alias("maps")), "l_returnflag", "maps", "value1")
    text = F.array_join(F.transform(F.map_entries("maps"), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"].cast("string"))), ",")
    return rows.select("l_returnflag", text.alias("sums"))


@R.query("""with c as (select o_orderkey, l_linenumber as k, max(l_partkey) as v from orders join lineitem on o_orderkey = l_orderkey group by all)
 select o_orderkey, string_agg(k::varchar || '=' || v::varchar, ',' order by k) as children from c group by 1""")
def parent_children_map(spark, sf_dir):
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    rows = A.children_by_parent(o, l, F.col("o_orderkey") == F.col("l_orderkey"), "o_orderkey", "l_linenumber", F.col("l_partkey"), "children")
    text = F.array_join(F.transform(F.map_entries("children"), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"].cast("string"))), ",")
    return rows.select("o_orderkey", text.alias("children"))


@R.query("""with t as (select lang, doc_id, unnest(regexp_split_to_array(lower(text), '\\W+')) as token from documents),
 f as (select doc_id, lang, token, count(*) as tf from t where token <> '' group by all), d as (select token, count(*) as df from f group by token)
 select doc_id, token, tf, df, round(tf * ln((select count(*) from documents)::double / df), 6) as weight from f join d using (token)
 qualify row_number() over (partition by doc_id order by tf * ln((select count(*) from documents)::double / df) desc, token) <= 5""")
def tf_idf(spark, sf_dir):
    """The five most telling words of each document."""
    from millrace.operators.windows import first_per_key

    rows = A.tf_idf(table(spark, sf_dir, "documents"), "doc_id", "text")
    return first_per_key(rows, ["doc_id"], [F.desc("weight"), F.col("token")], 5).withColumn("weight", F.round("weight", 6))


@R.query("select event_id, user_id from events where event_type = 'view' union all select event_id, user_id from events where user_id < 20")
def union_all(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.where("event_type = 'view'").select("event_id", "user_id").unionByName(e.where("user_id < 20").select("user_id", "event_id"))


@R.query("select distinct user_id, event_type from events")
def salted_distinct(spark, sf_dir):
    return skew.salted_distinct(table(spark, sf_dir, "events").select("user_id", "event_type"), 8)


@R.query("select user_id, min(event_id) as event_id from events group by user_id")
def drop_duplicates(spark, sf_dir):
    """One event per user: the first, so that the answer is the same each time."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("event_id").alias("event_id"))


@R.query("""select l_returnflag, count(*) as n, round(sum(l_extendedprice), 2) as price, round(avg(l_discount), 6) as discount, min(l_shipdate) as first, max(l_quantity) as most
 from lineitem group by l_returnflag""")
def salted_group_by(spark, sf_dir):
    metrics = {"n": ("count", "*"), "price": ("sum", "l_extendedprice"), "discount": ("avg", "l_discount"), "first": ("min", "l_shipdate"), "most": ("max", "l_quantity")}
    rows = skew.salted_group_by(table(spark, sf_dir, "lineitem"), ["l_returnflag"], metrics, 16, ["l_orderkey", "l_linenumber"])
    return rows.select("l_returnflag", "n", F.round("price", 2).alias("price"), F.round("discount", 6).alias("discount"), "first", "most")
