"""Session settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app_name: str = "deltascope", master: str | None = None, **conf: str) -> SparkSession:
    """Get or create a session: UTC, ANSI arithmetic, adaptive execution."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # recording a call site per column expression makes building wide plans several
        # times slower
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
