"""Session settings the engine is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str = "local[*]", **extra: str) -> SparkSession:
    """A local session; on a cluster build your own with DEFAULTS."""
    return SparkSession.builder.master(master).config(map=DEFAULTS | extra).getOrCreate()
