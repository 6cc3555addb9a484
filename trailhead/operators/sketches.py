"""Daily sketches of telemetry: exact counts beside mergeable summaries of sessions and latencies, for any range of days without the events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAY = 86_400


def daily(events: DataFrame, lg_k: int = 12, k: int = 200) -> DataFrame:
    """Per day and tool of events (tool, session_id, latency_ms, created_at): calls, sessions (an HLL sketch) and latency (a KLL sketch). Rows without a
    time are left out; a day and tool without latencies has a null sketch of them."""
    e = events.where("created_at is not null").withColumn("day", F.floor(F.col("created_at") / DAY))
    return e.groupBy("day", "tool").agg(F.count(F.lit(1)).alias("calls"), F.hll_sketch_agg("session_id", lg_k).alias("sessions"), F.kll_sketch_agg_bigint("latency_ms", k).alias("latency"))


def over(sketches: DataFrame, first: int | None = None, last: int | None = None, ranks: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Per tool over days first to last (both included; null for open ends): calls, about how many sessions, and latency quantiles (an array)."""
    s = sketches
    if first is not None:
        s = s.where(F.col("day") >= first)
    if last is not None:
        s = s.where(F.col("day") <= last)
    merged = s.groupBy("tool").agg(F.sum("calls").alias("calls"), F.hll_union_agg("sessions").alias("s"), F.kll_merge_agg_bigint("latency").alias("l"))
    at = F.array(*[F.lit(r) for r in ranks])
    return merged.select("tool", "calls", F.hll_sketch_estimate("s").alias("sessions"), F.kll_sketch_get_quantile_bigint("l", at).alias("latency"))


def usage_cube(events: DataFrame, by: list[str]) -> DataFrame:
    """Calls and latency by all subsets of some columns: level has a bit per column that is summed over, the last column's the lowest."""
    return events.cube(*by).agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("calls"), F.sum("latency_ms").alias("latency_ms"))


def usage_rollup(events: DataFrame, by: list[str]) -> DataFrame:
    """The same by the columns' prefixes alone."""
    return events.rollup(*by).agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("calls"), F.sum("latency_ms").alias("latency_ms"))
