"""Spark sessions with the settings the engine is designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "promptloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC timestamps and bounded Arrow batches.

    Prompts can be long, so Arrow batches are kept small: a batch of replies is held by
    one Python worker at a time.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
