"""A session with the settings the engine's plans expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, **settings: str) -> SparkSession:
    b = SparkSession.builder.appName("orrery")
    if master:
        b = b.master(master)
    own = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for k, v in (own | {k.replace("_", "."): v for k, v in settings.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()
