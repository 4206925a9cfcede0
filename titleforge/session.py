"""A session with the settings that the queries rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "titleforge", **extra: str) -> SparkSession:
    """UTC, adaptive execution and Arrow; ``extra`` settings by name with dots as double underscores."""
    builder = SparkSession.builder.appName(app)
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
