"""A session with the settings that the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "vigilake", **more: str) -> SparkSession:
    """The running session, or a new one; `more` are further settings, with _ for each dot."""
    builder = SparkSession.builder.appName(app)
    for k, v in (SETTINGS | {k.replace("_", "."): v for k, v in more.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
