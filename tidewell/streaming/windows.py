"""Event-time windows over a stream of changes: beyond what capture itself needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame) -> DataFrame:
    """Changes with their commit time as a timestamp."""
    return events.withColumn("committed", F.timestamp_micros("commit_timestamp_us"))


def counted(events: DataFrame, size: str, slide: str | None = None, late: str = "10 minutes", by: list[Column] | None = None) -> DataFrame:
    """Changes per table, operation and window (tumbling, or sliding), final once the watermark has passed."""
    at = F.window("committed", size, slide) if slide else F.window("committed", size)
    keys = by if by is not None else [F.col("schema"), F.col("table"), F.col("op")]
    return timed(events).where("op <> 'progress'").withWatermark("committed", late).groupBy(at.alias("at"), *keys).agg(F.count("*").alias("n")).select(F.col("at.start").alias("start"), F.col("at.end").alias("end"), *[c for c in keys], "n")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Stretches of changes of a table without a pause of ``gap``."""
    at = F.session_window("committed", gap)
    out = timed(events).where("op <> 'progress'").withWatermark("committed", late).groupBy(at.alias("at"), "schema", "table").agg(F.count("*").alias("n"))
    return out.select(F.col("at.start").alias("start"), F.col("at.end").alias("end"), "schema", "table", "n")
