"""Joins, and scans and sinks that go through files."""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from millrace.operators.skew import null_skew_left_join as skew_join
from millrace.plans.base import Registry, table
from millrace.sources import files, kafka

R = Registry()


def scratch(spark: SparkSession) -> str:
    """A folder of the session's shared storage for files that a query writes and reads again."""
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="millrace-")
    return f"{base.rstrip('/')}/millrace-{uuid.uuid4().hex}"


@R.query("select a.o_orderkey as left_key, b.l_orderkey as right_key, b.l_linenumber from orders a join lineitem b on a.o_orderkey = b.l_orderkey")
def join_expr(spark, sf_dir):
    o, l = table(spark, sf_dir, "orders").alias("a"), table(spark, sf_dir, "lineitem").alias("b")
    return o.join(l, F.col("a.o_orderkey") == F.col("b.l_orderkey")).select(F.col("a.o_orderkey").alias("left_key"), F.col("b.l_orderkey").alias("right_key"), "l_linenumber")


@R.query("select c_custkey, c_name, o_orderkey from customer join orders on c_custkey = o_custkey")
def join_using(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(o, "c_custkey", "inner")


@R.query("select c_custkey, c_mktsegment, o_orderkey from customer join orders on c_custkey = o_custkey")
def shuffle_hash_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").hint("shuffle_hash").join(o, "c_custkey")


SOME = "select o_orderkey, case when o_custkey % 10 <> 0 then o_custkey end as c_custkey from orders"
LEFT = f"with o as ({SOME}) select o.o_orderkey, o.c_custkey, c.c_name from o left join customer c on o.c_custkey = c.c_custkey"


def some_keys(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey")).alias("c_custkey"))


@R.query(LEFT)
def left_join_nulls(spark, sf_dir):
    return some_keys(spark, sf_dir).join(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", "left").select("o_orderkey", "c_custkey", "c_name")


@R.query(LEFT)
def null_skew_left_join(spark, sf_dir):
    return skew_join(some_keys(spark, sf_dir), table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", 1000).select("o_orderkey", "c_custkey", "c_name")


@R.query("select c_nationkey, count(*) as n, round(sum(o_totalprice), 2) as price from customer join orders on c_custkey = o_custkey group by 1")
def bucketed_join(spark, sf_dir):
    """A join of two tables bucketed on its key: no exchange before the join."""
    names = [f"millrace_{x}_{uuid.uuid4().hex[:12]}" for x in ("c", "o")]
    files.write_bucketed(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_nationkey"), names[0], "k", 8)
    files.write_bucketed(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_totalprice"), names[1], "k", 8)
    joined = spark.table(names[0]).join(spark.table(names[1]).hint("merge"), "k")
    return joined.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("price"))


@R.query("select o_orderkey, o_orderstatus from orders where o_orderstatus = 'F'")
def parquet_scan(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_orderstatus")


@R.query("select p_size % 7 as day, p_partkey as id, p_name as data from part")
def partitioned_write_roundtrip(spark, sf_dir):
    at = scratch(spark)
    rows = table(spark, sf_dir, "part").select((F.col("p_size") % 7).alias("day"), F.col("p_partkey").alias("id"), F.col("p_name").alias("data"))
    files.write_partitioned(rows, at, ["day"])
    return files.csv(spark, at, "id long, data string, day int").select("day", "id", "data")


@R.query("""select ts::date as dt, user_id % 5 as app_id, props as campaign from events where ts::date between date '2024-01-14' and date '2024-01-20'""")
def load_date_range(spark, sf_dir):
    """Seven days of one field's lists out of a folder by day and field."""
    at = scratch(spark)
    e = table(spark, sf_dir, "events").select(F.to_date("ts").alias("dt"), (F.col("user_id") % 5).alias("app_id"), F.col("props").alias("campaign"))
    both = e.withColumn("field_name", F.lit("campaign")).unionByName(e.withColumn("field_name", F.lit("site")))
    files.write_partitioned(both, at, ["dt", "field_name"], "parquet")
    return files.load_date_range(spark, at, "campaign", dt.date(2024, 1, 20), 7).select("dt", "app_id", "campaign")


@R.query("select event_id, user_id, value from events")
def json_nested_scan(spark, sf_dir):
    at = scratch(spark)
    e = table(spark, sf_dir, "events").select(F.struct("event_id", F.struct("user_id", "value").alias("info")).alias("s")).select("s.*")
    e.write.json(at)
    return files.json_lines(spark, at, "event_id long, info struct<user_id: long, value: double>").select("event_id", "info.user_id", "info.value")


@R.query("select 'c' || id as word, n from (values (1, 1), (2, 4), (3, 9)) as t(id, n)")
def literal_rows(spark, sf_dir):
    return files.rows(spark, [("c1", 1), ("c2", 4), ("c3", 9)], "word string, n int")


@R.query("select range as id from range(5, 1000)")
def range_scan(spark, sf_dir):
    return spark.range(5, 1000)


def text_file(spark: SparkSession, text: str) -> str:
    """A folder with one text file of exactly this content."""
    at = scratch(spark)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.option("lineSep", "\n").text(at)
    return at


@R.query("select * from (values (1, 12, 'a'), (2, null, null), (3, 12, 'c'), (null, 5, 'd')) as t(ROWNUM, SOME_INT, SOME_STRING)")
def csv_null_token(spark, sf_dir):
    at = text_file(spark, "ROWNUM,SOME_INT,SOME_STRING\n1,12,a\n2,NA,NA\n3,12,c\nNA,5,d")
    return files.csv(spark, at, "ROWNUM int, SOME_INT int, SOME_STRING string", null="NA")


@R.query("select * from (values (1, 12, 'a'), (2, null, 'NA'), (3, 12, 'c'), (4, 5, 'd')) as t(ROWNUM, SOME_INT, SOME_STRING)")
def csv_permissive(spark, sf_dir):
    """A malformed number is null; the rest of its row stays."""
    at = text_file(spark, "ROWNUM,SOME_INT,SOME_STRING\n1,12,a\n2,NA,NA\n3,12,c\n4,5,d")
    return files.csv(spark, at, "ROWNUM int, SOME_INT int, SOME_STRING string")


@R.query("select * from (values ('one'), ('two'), ('three')) as t(value)")
def text_custom_delim(spark, sf_dir):
    at = text_file(spark, "oneÃtwoÃthree")
    return files.delimited_text(spark, at, "Ã").select(F.trim(F.regexp_replace("value", "\n", "")).alias("value")).where("value != ''")


@R.query("select page_id, 'p' || page_id as name, page_id % 3 as code from pages")
def xml_parse(spark, sf_dir):
    """Markup built from the pages' ids, parsed, and its nested rows exploded."""
    text = F.concat(F.lit('<Doc code="'), (F.col("page_id") % 3).cast("string"), F.lit('"><Passengers><Passenger><Name>p'), F.col("page_id").cast("string"), F.lit("</Name></Passenger></Passengers></Doc>"))
    schema = "_code int, Passengers struct<Passenger: array<struct<Name: string>>>"
    parsed = files.xml(table(spark, sf_dir, "pages").select("page_id", text.alias("xmldata")), "xmldata", schema)
    rows = parsed.select("page_id", F.col("xmldata._code").cast("long").alias("code"), F.explode("xmldata.Passengers.Passenger").alias("p"))
    return rows.select("page_id", F.col("p.Name").alias("name"), "code")


@R.query("""select event_id::varchar as key, '{"event_id":' || event_id || ',"user_id":' || user_id || '}' as value, 'events-' || event_type as topic from events""")
def kafka_payload(spark, sf_dir):
    """Records for a broker: key, JSON value and topic."""
    e = table(spark, sf_dir, "events")
    return kafka.payload(e, "event_id", ["event_id", "user_id"], F.concat(F.lit("events-"), F.col("event_type")))


@R.query("select event_id, ts + (timestamp '2030-01-01' - (select min(ts) from events)) as ts from events")
def replay_shift(spark, sf_dir):
    """Events moved so that the earliest is now."""
    return files.shifted_to(table(spark, sf_dir, "events").select("event_id", "ts"), "ts", dt.datetime(2030, 1, 1))
