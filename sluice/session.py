"""Spark sessions with the settings that the engine's semantics rest on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Decimal division, overflow and casts raise; timestamps are UTC; plans adapt at run time.
SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def session(app: str = "sluice", master: str | None = None, cores: int | None = None, **settings: str) -> SparkSession:
    """The active session with the engine's settings, or a new one.

    ``cores`` sets a local master and as many shuffle partitions; on a cluster leave both to its configuration.
    """
    builder = SparkSession.builder.appName(app)
    if cores:
        master = master or f"local[{cores}]"
        builder = builder.config("spark.sql.shuffle.partitions", str(cores))
    if master:
        builder = builder.master(master)
    for k, v in {**SETTINGS, **settings}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
