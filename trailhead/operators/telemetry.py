"""Session telemetry, access statistics and retrieval-weight learning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailhead.functions.text import scope


def scoped(rows: DataFrame) -> DataFrame:
    """rows with their worktree_id normalised: one session may work in several worktrees, which don't see one another."""
    return rows.withColumn("worktree_id", scope(F.col("worktree_id")))


def session_summary(events: DataFrame) -> DataFrame:
    """Per session and worktree."""
    return scoped(events).groupBy("session_id", "worktree_id").agg(
        F.count(F.lit(1)).alias("events"), F.countDistinct("tool").alias("tools"), F.round(F.avg("result_count"), 6).alias("avg_results"), F.round(F.avg("latency_ms"), 6).alias("avg_latency"),
        F.round(F.avg("groundedness_score"), 6).alias("avg_groundedness"), F.min("created_at").alias("started"), F.max("created_at").alias("ended"), (F.max("created_at") - F.min("created_at")).alias("duration"),
    )


def session_totals(events: DataFrame, session: str | None = None, worktree: str | None = None) -> DataFrame:
    """One row of totals, zeros without events; for one session or all, and one worktree or all (a blank one is the project's root)."""
    e = events if session is None else events.where(F.col("session_id") == session)
    if worktree is not None:
        e = scoped(e).where(F.col("worktree_id") == (worktree.strip() or "project-root"))
    return e.agg(F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum("latency_ms"), F.lit(0)).alias("latency_ms"), F.round(F.avg("groundedness_score"), 6).alias("avg_groundedness"))


def tool_breakdown(events: DataFrame) -> DataFrame:
    """Per session and worktree: the tools by calls, ties by name."""
    b = scoped(events).groupBy("session_id", "worktree_id", "tool").agg(F.count(F.lit(1)).alias("calls"), F.sum("latency_ms").alias("latency_ms"), F.round(F.avg("groundedness_score"), 6).alias("avg_groundedness"))
    place = Window.partitionBy("session_id", "worktree_id").orderBy(F.desc("calls"), "tool")
    return b.withColumn("place", F.row_number().over(place))


def groundedness_window(events: DataFrame, n: int = 100) -> DataFrame:
    """Count and mean of the most recent n scores."""
    recent = events.where("groundedness_score is not null").orderBy(F.desc("created_at"), F.desc("id")).limit(n)
    return recent.agg(F.count(F.lit(1)).alias("samples"), F.round(F.avg("groundedness_score"), 6).alias("avg_groundedness"))


def recent_activity(events: DataFrame, n: int = 50) -> DataFrame:
    return events.orderBy(F.desc("created_at"), F.desc("id")).limit(n).select("id", "session_id", "tool", "created_at")


WEIGHTS = {"lexical": 0.4, "semantic": 0.4, "co_access": 0.1, "recency": 0.1}


def _clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def learn_weights(window: DataFrame, gate_open: bool, current: dict[str, float] | None = None, least: int = 5) -> DataFrame:
    """The next weight snapshot from a one-row window (samples, avg_groundedness): bounded shift from lexical to semantic."""
    now = current or WEIGHTS
    w = window.withColumn("shift", _clamp((F.col("avg_groundedness") - 0.5) * 0.2, -0.05, 0.05))
    raw = {
        "lexical": _clamp(F.lit(now["lexical"]) - F.col("shift"), 0.05, 0.8), "semantic": _clamp(F.lit(now["semantic"]) + F.col("shift"), 0.05, 0.8),
        "co_access": F.lit(min(0.6, max(0.05, now["co_access"]))), "recency": F.lit(min(0.6, max(0.05, now["recency"]))),
    }
    total = raw["lexical"] + raw["semantic"] + raw["co_access"] + raw["recency"]
    w = w.withColumns({f"candidate_{k}": v / total for k, v in raw.items()})
    delta = sum((F.abs(F.col(f"candidate_{k}") - now[k]) for k in now), F.lit(0.0)) / 4
    label = F.when(F.col("shift") > 0.005, "improving").when(F.col("shift") < -0.005, "regressing").otherwise("neutral")
    enough = (F.col("samples") >= least) & F.col("avg_groundedness").isNotNull()
    w = w.withColumn("outcome_label", F.when(enough, label).otherwise("neutral")).withColumn("candidate_delta", F.when(enough, F.round(delta, 6)).otherwise(0.0))
    applied = enough & F.lit(gate_open) & (F.col("outcome_label") == "improving")
    w = w.withColumn("applied", applied).withColumn("learning_state", F.when(F.col("outcome_label") == "regressing", "regressing").when(applied, "improving").otherwise("neutral"))
    w = w.withColumn("last_learning_outcome", F.when(~enough, "no_history").when(applied, "promoted").when(F.col("outcome_label") == "regressing", "rolled_back").otherwise("no_change"))
    w = w.withColumns({k: F.round(F.when(F.col("applied"), F.col(f"candidate_{k}")).otherwise(v), 6) for k, v in now.items()})
    cand = [F.when(enough, F.round(f"candidate_{k}", 6)).alias(f"candidate_{k}") for k in now]
    return w.select("samples", *now, *cand, "applied", "outcome_label", "candidate_delta", "learning_state", "last_learning_outcome")


def shadow_scores(snapshot: DataFrame, quality: DataFrame) -> DataFrame:
    """Per lane of quality (lane, quality): its quality under the current and the candidate weights, to 4 places."""
    lanes = snapshot.select(F.explode(F.array(*[F.struct(F.lit(k).alias("lane"), F.col(k).alias("cur"), F.col(f"candidate_{k}").alias("cand")) for k in WEIGHTS])).alias("w")).select("w.*")
    q = F.coalesce("quality", F.lit(0.0))
    return quality.join(lanes, "lane", "left").select("lane", F.round(q * F.coalesce("cur", F.lit(1.0)), 4).alias("baseline"), F.round(q * F.coalesce("cand", F.lit(1.0)), 4).alias("candidate"))


def access_stats(access: DataFrame, k: int | None = None) -> DataFrame:
    """Per file accesses and the last one; with k only the k files with the most accesses, ties by path."""
    s = access.groupBy("file_path").agg(F.count(F.lit(1)).alias("accesses"), F.max("accessed_at").alias("last_access"))
    return s if k is None else s.orderBy(F.desc("accesses"), "file_path").limit(k)


def session_files(access: DataFrame) -> DataFrame:
    """Per session, worktree and file: accesses and last access, and the session's total in the worktree."""
    f = scoped(access).groupBy("session_id", "worktree_id", "file_path").agg(F.count(F.lit(1)).alias("accesses"), F.max("accessed_at").alias("last_access"))
    total = f.groupBy("session_id", "worktree_id").agg(F.sum("accesses").alias("session_total"))
    return f.join(total, ["session_id", "worktree_id"])


def access_boost(access: DataFrame, now: DataFrame) -> DataFrame:
    """Per file ln(1 + n) * exp(-days / 30) since its last access; now: one row (now)."""
    s = access_stats(access).crossJoin(F.broadcast(now))  # now is one row
    days = (F.col("now") - F.col("last_access")) / 86400.0
    return s.select("file_path", (F.log1p("accesses") * F.exp(-days / 30.0)).alias("boost"))
