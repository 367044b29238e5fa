"""Reader and writer options of Kafka; the connector's jar comes with the cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Of these exactly one names what is read (fixed values).
WHAT = ("subscribe", "subscribePattern", "assign")
SOURCE_OPTIONS = {*WHAT, "startingOffsets", "failOnDataLoss", "kafkaConsumer.pollTimeoutMs", "fetchOffset.numRetries", "fetchOffset.retryIntervalMs", "maxOffsetsPerTrigger"}
#: The columns of a Kafka record.
RECORD = "key binary, value binary, topic string, partition int, offset bigint, timestamp timestamp, timestampType int"


def source_options(servers: str, **options: str) -> dict[str, str]:
    """Checked options of a stream; names with a prefix of kafka. go to the consumer, dots written as double underscores."""
    named = {k.replace("__", "."): str(v) for k, v in options.items()}
    unknown = [k for k in named if k not in SOURCE_OPTIONS and not k.startswith("kafka.")]
    if unknown:
        raise ValueError(f"unknown options: {unknown}")
    if sum(k in named for k in WHAT) != 1:
        raise ValueError(f"exactly one of {WHAT} is needed")
    return {"kafka.bootstrap.servers": servers} | named


def read_stream(spark: SparkSession, servers: str, **options: str) -> DataFrame:
    return spark.readStream.format("kafka").options(**source_options(servers, **options)).load()


def payload(df: DataFrame, key: str, columns: list[str], topic: str | Column | None = None) -> DataFrame:
    """(key, value[, topic]): a JSON value per row; with a topic column each row says where it goes."""
    out = [F.col(key).cast("string").alias("key"), F.to_json(F.struct(*columns)).alias("value")]
    if topic is not None:
        out.append((F.lit(topic) if isinstance(topic, str) else topic).alias("topic"))
    return df.select(*out)


def sink_options(servers: str, df: DataFrame, topic: str | None = None) -> dict[str, str]:
    """The options of a sink; a topic is needed exactly if the rows have none."""
    if (topic is None) != ("topic" in df.columns):
        raise ValueError("either a topic or a topic column is needed")
    return {"kafka.bootstrap.servers": servers} | ({"topic": topic} if topic else {})
