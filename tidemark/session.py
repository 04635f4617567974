"""A session with the settings that the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "tidemark", **conf: str) -> SparkSession:
    """UTC and adaptive execution; shuffle partitions start high and are coalesced by size."""
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"} | conf
    return SparkSession.builder.appName(app).config(map=settings).getOrCreate()
