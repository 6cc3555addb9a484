"""Windowed telemetry; the same functions serve batches and, given a watermark, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, late: str | None) -> DataFrame:
    e = events.withColumn("__ts", F.timestamp_seconds("created_at"))
    return e.withWatermark("__ts", late) if late else e


def windowed_calls(events: DataFrame, size: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Calls and latency per window and tool; late is the watermark's delay on streams."""
    w = F.window("__ts", size, slide) if slide else F.window("__ts", size)
    g = _timed(events, late).groupBy(w.alias("w"), "tool").agg(F.count(F.lit(1)).alias("calls"), F.sum("latency_ms").alias("latency_ms"))
    return g.select(F.unix_timestamp(F.col("w.start")).alias("start"), "tool", "calls", "latency_ms")


def session_gaps(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """Sessions cut where nothing happens for gap or longer: start and calls. Windows that only touch are merged by Spark, so they end a microsecond before
    the gap does: events exactly gap apart are in two sessions."""
    g = _timed(events, late).groupBy(F.session_window("__ts", f"{gap} -1 microseconds").alias("w"), "session_id").agg(F.count(F.lit(1)).alias("calls"))
    return g.select("session_id", F.unix_timestamp(F.col("w.start")).alias("started"), "calls")
