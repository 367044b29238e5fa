"""The session the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "millrace", master: str | None = None, **conf: object) -> SparkSession:
    """A session in UTC with adaptive execution; further settings by name, dots as double underscores."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    builder = builder.master(master) if master else builder
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
