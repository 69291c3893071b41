"""A session with the settings that the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "marlstone", master: str | None = None, **settings: str) -> SparkSession:
    """UTC, ANSI, adaptive execution; further settings by name with ``_`` for ``.``."""
    builder = SparkSession.builder.appName(name)
    builder = builder.master(master) if master else builder
    builder = builder.config("spark.sql.session.timeZone", "UTC").config("spark.sql.ansi.enabled", "true").config("spark.sql.adaptive.enabled", "true")
    for key, value in settings.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()
