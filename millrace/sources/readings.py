"""Generated sensor readings and weather, as tables and as a stream that can be read again from any offset."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "id long, sensor long, value double"
#: Rows that one offset step adds.
STEP = 100


def value_of(i: int) -> float:
    """A number from 0 to 1 that depends on i alone."""
    return ((i * 2654435761) % (1 << 32)) / float(1 << 32)


class Span(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class ReadingsReader(DataSourceStreamReader):
    """Offsets count rows; the same two offsets always give the same rows, so that a batch can be replayed after a failure."""

    def __init__(self, n: int, sensors: int):
        self.n, self.sensors, self.at = n, sensors, 0

    def initialOffset(self) -> dict:
        return {"row": 0}

    def latestOffset(self) -> dict:
        self.at = min(self.n, self.at + STEP)
        return {"row": self.at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = max(self.at, end["row"])
        middle = (start["row"] + end["row"]) // 2
        return [Span(start["row"], middle), Span(middle, end["row"])]

    def read(self, partition: Span) -> Iterator[tuple]:
        for i in range(partition.start, partition.end):
            yield (i, i % self.sensors, value_of(i))

    def commit(self, end: dict) -> None:
        """Rows before `end` will not be asked for again; nothing is held for them."""


class Readings(DataSource):
    """The format millrace_readings, with the options rows and sensors."""

    @classmethod
    def name(cls) -> str:
        return "millrace_readings"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ReadingsReader(int(self.options.get("rows", 1000)), int(self.options.get("sensors", 10)))


def stream(spark: SparkSession, rows: int, sensors: int) -> DataFrame:
    spark.dataSource.register(Readings)
    return spark.readStream.format("millrace_readings").option("rows", rows).option("sensors", sensors).load()


def readings(spark: SparkSession, n: int, sensors: int, seed: int = 1) -> DataFrame:
    """(sensorId, timestamp in milliseconds, value from 0 to 1)."""
    return spark.range(n).select((F.col("id") % sensors).alias("sensorId"), (F.lit(1_700_000_000_000) + F.col("id") * 1000).alias("timestamp"), F.rand(seed).alias("value"))


def weather(spark: SparkSession, n: int, stations: int, seed: int = 1) -> DataFrame:
    """(id, stationId, timestamp, location, pressure, temp)."""
    place = F.struct((F.rand(seed) * 180 - 90).alias("latitude"), (F.rand(seed + 1) * 360 - 180).alias("longitude"))
    return spark.range(n).select("id", F.concat(F.lit("s"), (F.col("id") % stations).cast("string")).alias("stationId"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("timestamp"), place.alias("location"), (F.rand(seed + 2) * 60 + 980).alias("pressure"), (F.rand(seed + 3) * 50 - 10).alias("temp"))


def jdbc_options(url: str, table: str, column: str | None = None, lower: int = 0, upper: int = 0, parts: int = 1) -> dict[str, str]:
    """Options of a JDBC read or write; with a column, reads go in `parts` ranges of it. The driver's jar comes with the cluster."""
    out = {"url": url, "dbtable": table}
    if column:
        out |= {"partitionColumn": column, "lowerBound": str(lower), "upperBound": str(upper), "numPartitions": str(parts)}
    return out
