"""A session with the settings that the package is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "seqforge", master: str | None = None, **settings: str) -> SparkSession:
    """ANSI arithmetic, UTC, adaptive execution with skew joins; other settings by keyword, dots as __."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.ansi.enabled", "true").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
