"""A Spark session with the settings that the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "gridloom", master: str | None = None, **settings: str) -> SparkSession:
    """UTC, adaptive execution and skew handling on; anything may be overridden by its key with _ for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    plain = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for k, v in (plain | {k.replace("_", "."): v for k, v in settings.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
