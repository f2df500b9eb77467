"""Session settings the engine is planned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "loomgraph", master: str | None = None, **settings: str) -> SparkSession:
    """A session with adaptive planning, skew joins and UTC; ``settings`` override (dots as __)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.sql.parquet.filterPushdown": "true",
    } | {k.replace("__", "."): v for k, v in settings.items()}
    return builder.config(map=conf).getOrCreate()
