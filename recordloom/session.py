"""Session builder."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: What the operators rely on; everything else is the cluster's matter.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "recordloom", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings that the operators rely on; ``settings`` (dots as underscores twice) go on top."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
