"""Sessions with the settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.ansi.doubleQuotedIdentifiers": "true",
    "spark.sql.runSQLOnFiles": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def builder(name: str = "tidewell") -> SparkSession.Builder:
    """A builder with the engine's settings; the master and sizes are the caller's."""
    made = SparkSession.builder.appName(name)
    for key, value in SETTINGS.items():
        made = made.config(key, value)
    return made


def scoped(spark: SparkSession) -> SparkSession:
    """A fresh session for one free query: its own views and settings, nothing shared but the cluster."""
    own = spark.newSession()
    for key, value in SETTINGS.items():
        own.conf.set(key, value)
    return own
