"""A session with the settings that results depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "tidemark", **settings: str) -> SparkSession:
    """UTC, ANSI arithmetic and adaptive execution; the rest is the cluster's choice."""
    builder = SparkSession.builder.appName(name)
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true"}
    return builder.config(map=fixed | settings).getOrCreate()
