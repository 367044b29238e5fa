"""Helpers that several of the training-data operators share."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of an Arrow batch on its way to Python; the session's setting, if that is lower.
BATCH_BYTES = 4 << 20
#: Seconds between two collections of the driver's garbage, and with it of shuffle files.
COLLECT_S = 4
#: Seconds between two looks of the bridge's own thread, which tells the JVM what Python has collected, and some for the telling.
TOLD_S = 1.2
#: Links of forests, of 16 bytes each, that one task may hold.
SETTLED = 1 << 20
#: What separates words: ASCII space and the five ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir. Where that is unset, one of our own in
    local mode, where all share a machine; on a cluster an error.

    Also lowers the session's limit on bytes of an Arrow batch to BATCH_BYTES, as executors hold several at once."""
    sc = spark.sparkContext
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(limit).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(limit, str(BATCH_BYTES))
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if known is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        known = tempfile.mkdtemp(prefix="millrace-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(known)
    return known


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


_collected = [0.0]


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, with its lineage cut; survives the loss of any executor.

    Spark deletes shuffle files and checkpoints that no plan needs any more once the driver has collected their plans; this
    is asked for now and then, so that a long chain of steps does not keep all that it has written. It is asked for before
    a step: after it the caller still holds df."""
    shared_dir(df.sparkSession)
    if time.monotonic() - _collected[0] > COLLECT_S:
        release(df.sparkSession)
    return df.checkpoint()


def tell_collected(spark: SparkSession) -> None:
    """Has the JVM let go of what Python has collected; its own collection must come after that.

    The bridge's thread looks for such objects once a second, so that those of the last step would often be missed."""
    waiting = getattr(spark.sparkContext._gateway._gateway_client, "finalizer_deque", None)
    if waiting is None:  # another bridge
        time.sleep(TOLD_S)
        return
    for _ in range(len(waiting)):
        try:
            task = waiting.pop()
        except IndexError:  # that thread was faster
            break
        if isinstance(task, str):  # ends that thread
            waiting.append(task)
            break
        client, name = task
        client.garbage_collect_object(name, False)
    time.sleep(0.05)  # it may be telling one just now


def release(spark: SparkSession) -> None:
    """Lets Spark delete what it has written for plans that nothing refers to any more."""
    gc.collect()
    tell_collected(spark)
    spark.range(1).count()  # threads that ran the last job refer to it until they run another
    jvm = spark.sparkContext._jvm
    jvm.System.gc()
    try:  # many threads free native memory that the C library keeps; JVMs that cannot give it back say so
        jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer().invoke(jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap", None, None)
    except Exception as e:  # noqa: BLE001
        if "MBean" not in str(e) and "Reflection" not in str(e) and "Unsupported" not in str(e):
            raise
    _collected[0] = time.monotonic()


def stored(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """df computed once and written as compressed columns in the shared folder, which a checkpoint is not, and where to.

    For tables of many rows that a caller can tell the last use of: it then calls `discard`. Spark takes the size of the
    files for the size of the rows; joins that must not send such a table to all workers say so by a hint."""
    spark = df.sparkSession
    at = shared_path(spark, label)
    if time.monotonic() - _collected[0] > COLLECT_S:
        release(spark)
    df.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at), at


def discard(spark: SparkSession, at: str) -> None:
    """Deletes what `stored` has written; nothing may read it any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def with_size(df: DataFrame, text: str = "text", name: str = "size") -> DataFrame:
    """Adds the number of words of a text; null counts as 0."""
    return df.withColumn(name, F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long"))


def named(columns: list[str], of: str = "") -> list:
    """Columns by name, whatever is in the names; of a struct, if `of` names one."""
    return [F.col(f"{of and of + '.'}`{c.replace('`', '``')}`").alias(c) for c in columns]


def packed(docs: DataFrame, columns: list[str], *beside) -> DataFrame:
    """row, a struct of columns of docs that no working column can clash with, and the columns `beside` it."""
    return docs.select((F.struct(*named(columns)) if columns else F.lit(None)).alias("row"), *beside)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_totals(df: DataFrame, order: list, values: list[str], parts: int | None = None) -> DataFrame:
    """Adds, for each of values, <value>_before: its total over all rows that come earlier in order.

    Rows are dealt out by ranges of the order, totalled range by range, and summed inside each range; the only
    table that one task sees whole has a row per range. Materialised once, so that the ranges cannot move."""
    n = parts or shuffle_partitions(df.sparkSession)
    dealt = cut(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    totals = dealt.groupBy("_range").agg(*[F.sum(v).alias(f"_sum_{v}") for v in values])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("_range", *[F.coalesce(F.sum(f"_sum_{v}").over(earlier), F.lit(0)).alias(f"_base_{v}") for v in values])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        dealt.join(F.broadcast(base), "_range")  # a row per range: n at most
        .select(*df.columns, *[(F.col(f"_base_{v}") + F.coalesce(F.sum(v).over(inside), F.lit(0))).alias(f"{v}_before") for v in values])
    )


def salted(left: DataFrame, right: DataFrame, key: str, share: int = 2000, salts: int = 64, sized: bool = False, of: DataFrame | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """left and right, which has one row per key, and the columns to join them on, where a key may hold any part of left's rows.

    The most frequent keys, `share` at most, are found by an aggregation and
    spread: their rows in left get a salt, their single rows in right a copy for each salt. If right is sized, it has the
    number of left's rows of each key as _n, and nothing is counted; else `of`, or left, is read once more for that. Of keys
    with more than 1000 rows the `share` most frequent are taken; any other has fewer than 1/share of the rows."""
    if sized:
        counts, right = right.select(key, "_n"), right.drop("_n")
    else:
        counts = (left if of is None else of).where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    heavy = [r[0] for r in counts.where(F.col("_n") > 1000).orderBy(F.desc("_n")).limit(share).select(key).collect()]
    if not heavy:
        return left, right, [key]
    among = F.col(key).isin(heavy) if len(heavy) < 50 else F.array_contains(F.array(*[F.lit(x) for x in heavy]), F.col(key))
    spread = left.withColumn("_salt", F.when(among, F.pmod(F.xxhash64(*[c for c in left.columns if c != key] or [key]), F.lit(salts)).cast("int")).otherwise(0))
    copies = right.withColumn("_salt", F.explode(F.when(among, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return spread, copies, [key, "_salt"]


def lookup(left: DataFrame, right: DataFrame, key: str, how: str = "inner", sized: bool = False, of: DataFrame | None = None) -> DataFrame:
    """left joined with right, which has one row per key, where a key may hold any part of left's rows; see salted."""
    spread, copies, on = salted(left, right, key, sized=sized, of=of)
    return spread.join(copies, on, how).drop("_salt")


def contracted(it: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links (a, b) of one partition, each beside the smallest that it reaches there."""
    found = [b for b in it if b.num_rows]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = [np.concatenate([b[c].to_numpy() for b in found]) for c in ("a", "b")]
    nodes, at = np.unique(np.concatenate(ends), return_inverse=True)
    a, b = np.split(at, 2)
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        for x in (a, b):
            np.minimum.at(new, label[x], least)
            np.minimum.at(new, x, least)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def contract(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links (a, b) of one partition as a forest: each node beside the smallest that it reaches there."""
    nodes, least = contracted(it)
    low = np.flatnonzero(nodes != least)
    for i in range(0, len(low), 100_000):
        part = low[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(nodes[part]), pa.array(least[part])], names=["a", "b"])


def settle(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all nodes, from links (a, b) that are all in one partition."""
    nodes, least = contracted(it)
    for i in range(0, len(nodes), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + 100_000]), pa.array(least[i : i + 100_000])], names=["node", "component"])


def snug(df: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """df, which `cut` has made, read by one task if it has no more than `most` rows, and whether it has.

    Steps on such a table then need no shuffle and no task for each of a few hundred partitions that are all but empty."""
    few = df.count() <= most
    return df.coalesce(1) if few else df, few


def components(edges: DataFrame, held: bool = False) -> DataFrame:
    """(node, component) of every node of the undirected edges (a, b): component is the smallest node reachable.

    Edges that are held, made from what `cut` has made, are counted first: up to SETTLED of them go to one task at once. Else
    each partition's links are first reduced to a forest. If these forests have SETTLED links at most, one task finds what
    they connect. Else large-star and small-star steps alternate until nothing changes. Each is an aggregation by node and a
    salted lookup, so that neither a node with very many links nor a large component meets in one task. Nothing but counts
    comes to the driver."""
    e = edges.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).where("a != b")
    if held and e.count() <= SETTLED:
        return cut(e.coalesce(1).mapInArrow(settle, "node long, component long"))
    e = cut(e.mapInArrow(contract, "a long, b long"))
    if e.count() <= SETTLED:
        return cut(e.coalesce(1).mapInArrow(settle, "node long, component long"))
    e = cut(e.distinct())
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    seen, now = None, state(e)
    while now != seen and now[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("_n")).withColumn("m", F.least("a", "m"))
        large = lookup(both, low, "a", sized=True).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        large = cut(large)
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("_n"))
        joined = lookup(large, low, "a", sized=True)
        small = joined.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        e = cut(small.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        seen, now = now, state(e)
    roots = e.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
