"""Session settings the library is tuned for. Callers with their own session only need the same SQL confs."""

from __future__ import annotations

from pyspark.sql import SparkSession

SQL_CONFS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # z-range filters reach the volume sources only with this on
    "spark.sql.python.filterPushdown.enabled": "true",
    # a repeated key in a JSON object keeps its last value
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(app: str = "tomoloom", master: str | None = None, **confs: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SQL_CONFS, **confs}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
