"""Streams: sources, windows over event time, deduplication, sinks and monitoring."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import StructField, StructType

#: Options of a file stream (fixed values).
FILE_OPTIONS = {"maxFilesPerTrigger", "latestFirst", "maxFileAge", "fileNameOnly", "maxBytesPerTrigger", "pathGlobFilter", "cleanSource"}


def rate(spark: SparkSession, rows_per_second: int = 10, partitions: int | None = None) -> DataFrame:
    """(timestamp, value), so many rows a second."""
    reader = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second)
    return (reader.option("numPartitions", partitions) if partitions else reader).load()


def socket(spark: SparkSession, host: str, port: int) -> DataFrame:
    """(value), a row per line; only for trials, as it cannot be read again after a failure."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def files(spark: SparkSession, path: str, schema: str | StructType, form: str = "parquet", **options: object) -> DataFrame:
    """New files of a folder as they come."""
    unknown = set(options) - FILE_OPTIONS
    if unknown:
        raise ValueError(f"unknown options: {sorted(unknown)}")
    return spark.readStream.format(form).schema(schema).options(**{k: str(v) for k, v in options.items()}).load(path)


def decode(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """JSON lines as columns; malformed ones go."""
    return lines.select(F.from_json(F.col(column).cast("string"), schema).alias("record")).where("record is not null").select("record.*")


def tumbling(df: DataFrame, ts: str, size: str, keys: list[str], slide: str | None = None, watermark: str | None = None) -> DataFrame:
    """(start, end, keys, n): counts per window, tumbling or sliding. Late rows are dropped beyond the watermark, if any."""
    timed = df.withColumn(ts, F.col(ts).cast("timestamp"))
    timed = timed.withWatermark(ts, watermark) if watermark else timed
    return timed.groupBy(F.window(ts, size, slide).alias("w"), *keys).agg(F.count("*").alias("n")).select("w.start", "w.end", *keys, "n")


def deduplicate(df: DataFrame, keys: list[str], ts: str, within: str) -> DataFrame:
    """The first row of each key; state is kept only as long as `within`."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)


def denormalise(readings: DataFrame, sensors: DataFrame, key: str) -> DataFrame:
    """Readings from 0 to 1 in the range (minRange, maxRange) of their sensors, a static table."""
    return readings.join(sensors, key).withColumn("value", F.col("value") * (F.col("maxRange") - F.col("minRange")) + F.col("minRange"))


def checkpoint_folder(spark: SparkSession) -> str:
    """A folder for a stream's offsets and state in the session's shared storage."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="millrace-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def to_memory(df: DataFrame, mode: str = "append", name: str | None = None, trigger: dict | None = None, rows: int = 0) -> DataFrame:
    """Runs a stream over all that is there and returns what it has written, from a table in memory. For small results.

    With a trigger of its own it runs until it has written that many rows."""
    spark = df.sparkSession
    name = name or f"stream_{uuid.uuid4().hex}"
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint_folder(spark)).trigger(**trigger or {"availableNow": True}).start()
    if trigger:
        while query.isActive and spark.table(name).count() < rows:
            query.awaitTermination(1)
        query.stop()
    query.awaitTermination()
    return spark.table(name)


def to_storage(df: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and returns what it has written, from files in the session's shared storage.

    For results of any size: no row of theirs comes to the driver. In complete mode they are the last batch's, in no order. State
    is kept by RocksDB, outside the executors' heaps."""
    spark = df.sparkSession
    at, kind = checkpoint_folder(spark), "spark.sql.streaming.stateStore.providerClass"
    columns = StructType([StructField(f.name, f.dataType) for f in df.schema])  # without a watermark's metadata
    before, last = spark.conf.get(kind, None), []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/batch={number}")
        last[:] = [f"{at}/batch={number}"]

    spark.conf.set(kind, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        if mode == "append":
            to_files(df, at, checkpoint_folder(spark)).awaitTermination()
        else:
            df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint_folder(spark)).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(kind, before) if before is not None else spark.conf.unset(kind)
    if mode == "append":
        return spark.read.schema(columns).parquet(at)
    paths = last if mode == "complete" else [f"{at}/*"] if last else []
    return spark.read.schema(columns).parquet(*paths) if paths else spark.createDataFrame([], columns)


def to_console(df: DataFrame, rows: int = 20) -> int:
    """Runs a stream over all that is there, shows some rows of each batch, and returns how many it has read."""
    query = df.writeStream.format("console").option("numRows", rows).option("truncate", True).option("checkpointLocation", checkpoint_folder(df.sparkSession)).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(p.numInputRows for p in query.recentProgress)


def observed(df: DataFrame, *counters: Column) -> dict:
    """Runs df without keeping its rows; what the counters have seen on the way."""
    seen = Observation()
    df.observe(seen, *counters).write.format("noop").mode("overwrite").save()
    return seen.get


def to_files(df: DataFrame, path: str, checkpoint: str, form: str = "parquet", every: str | None = None) -> StreamingQuery:
    """Appends to a folder. One trigger a minute or so (every) keeps files from becoming many and tiny; else all that is there."""
    writer = df.writeStream.format(form).outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def once_per_batch(write: Callable[[DataFrame, int], None], done: Callable[[int], bool]) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that writes each batch once: after a failure a batch comes again with the same number."""

    def sink(batch: DataFrame, number: int) -> None:
        if not done(number):
            write(batch, number)

    return sink


class Progress(StreamingQueryListener):
    """Keeps the last events of all queries; register it before they start."""

    def __init__(self, most: int = 100):
        self.most, self.started, self.progress, self.ended = most, [], [], []

    def onQueryStarted(self, event) -> None:
        self.started = [*self.started, str(event.id)][-self.most :]

    def onQueryProgress(self, event) -> None:
        self.progress = [*self.progress, (str(event.progress.id), event.progress.batchId, event.progress.numInputRows)][-self.most :]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended = [*self.ended, (str(event.id), event.exception)][-self.most :]


def metrics_on(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.metricsEnabled", "true")
