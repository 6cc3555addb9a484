"""Queries over telemetry, accesses and evaluation history."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailhead.functions import text as X
from trailhead.operators import drift, evals, sketches, telemetry
from trailhead.operators.graph import written
from trailhead.plans.registry import query
from trailhead.sources.snapshots import scratch_table
from trailhead.streaming.sinks import LatestSink


@query("session_summary", "SELECT session_id, worktree_id, count(*) AS events, count(DISTINCT tool) AS tools, round(avg(result_count), 6) AS avg_results, round(avg(latency_ms), 6) AS avg_latency, round(avg(groundedness_score), 6) AS avg_groundedness, min(created_at) AS started, max(created_at) AS ended, max(created_at) - min(created_at) AS duration FROM scoped_events GROUP BY 1, 2")
def session_summary(t):
    return telemetry.session_summary(t.tool_events())


@query("session_totals", "SELECT count(*) AS calls, CAST(coalesce(sum(latency_ms), 0) AS BIGINT) AS latency_ms, round(avg(groundedness_score), 6) AS avg_groundedness FROM tool_events")
def session_totals(t):
    return telemetry.session_totals(t.tool_events())


@query("session_in_worktree", "SELECT count(*) AS calls, CAST(coalesce(sum(latency_ms), 0) AS BIGINT) AS latency_ms, round(avg(groundedness_score), 6) AS avg_groundedness FROM scoped_events WHERE session_id = 's8' AND worktree_id = 'project-root'")
def session_in_worktree(t):
    return telemetry.session_totals(t.tool_events(), "s8", " ")


@query("tool_breakdown", "SELECT *, row_number() OVER (PARTITION BY session_id, worktree_id ORDER BY calls DESC, tool) AS place FROM (SELECT session_id, worktree_id, tool, count(*) AS calls, CAST(sum(latency_ms) AS BIGINT) AS latency_ms, round(avg(groundedness_score), 6) AS avg_groundedness FROM scoped_events GROUP BY 1, 2, 3)")
def tool_breakdown(t):
    return telemetry.tool_breakdown(t.tool_events())


_WINDOW = "SELECT count(*) AS samples, round(avg(groundedness_score), 6) AS avg_groundedness FROM (SELECT * FROM tool_events WHERE groundedness_score IS NOT NULL ORDER BY created_at DESC, id DESC LIMIT 100)"


@query("groundedness_window", _WINDOW)
def groundedness_window(t):
    return telemetry.groundedness_window(t.tool_events())


@query("recent_activity", "SELECT id, session_id, tool, created_at FROM tool_events ORDER BY created_at DESC, id DESC LIMIT 50")
def recent_activity(t):
    return telemetry.recent_activity(t.tool_events())


@query("access_stats", "SELECT file_path, count(*) AS accesses, max(accessed_at) AS last_access FROM chunk_access GROUP BY 1")
def access_stats(t):
    return telemetry.access_stats(t.chunk_access())


@query("top_accessed", "SELECT file_path, count(*) AS accesses, max(accessed_at) AS last_access FROM chunk_access GROUP BY 1 ORDER BY accesses DESC, file_path LIMIT 20")
def top_accessed(t):
    return telemetry.access_stats(t.chunk_access(), 20)


@query("session_files", "SELECT *, CAST(sum(accesses) OVER (PARTITION BY session_id, worktree_id) AS BIGINT) AS session_total FROM (SELECT session_id, worktree_id, file_path, count(*) AS accesses, max(accessed_at) AS last_access FROM scoped_access GROUP BY 1, 2, 3)")
def session_files(t):
    return telemetry.session_files(t.chunk_access())


@query("access_boost", "SELECT file_path, round(ln(1 + count(*)) * exp(-((SELECT max(accessed_at) FROM chunk_access) - max(accessed_at)) / 86400.0 / 30.0), 6) AS boost FROM chunk_access GROUP BY 1")
def access_boost(t):
    a = t.chunk_access()
    return telemetry.access_boost(a, a.agg(F.max("accessed_at").alias("now"))).select("file_path", F.round("boost", 6).alias("boost"))


@query("parse_strategy", "SELECT id, regexp_extract(strategy, 'strategy=([^;]*)', 1) AS strategy, regexp_extract(strategy, 'lane=([^;]*)', 1) AS lane, regexp_extract(strategy, 'outcome=([^;]*)', 1) AS outcome FROM tool_events")
def parse_strategy(t):
    m = X.parse_strategy(F.col("strategy"))
    return t.tool_events().withColumn("m", m).select("id", *[F.try_element_at("m", F.lit(k)).alias(k) for k in ("strategy", "lane", "outcome")])


_LEARN = f"""WITH w AS ({_WINDOW}), s AS (SELECT *, greatest(-0.05, least(0.05, (avg_groundedness - 0.5) * 0.2)) AS shift FROM w),
c AS (SELECT *, greatest(0.05, least(0.8, 0.4 - shift)) AS l, greatest(0.05, least(0.8, 0.4 + shift)) AS m, CASE WHEN shift > 0.005 THEN 'improving' WHEN shift < -0.005 THEN 'regressing' ELSE 'neutral' END AS outcome_label FROM s),
n AS (SELECT *, l / (l + m + 0.2) AS cl, m / (l + m + 0.2) AS cm, 0.1 / (l + m + 0.2) AS ca, outcome_label = 'improving' AS applied FROM c)"""
_LEARN_COLS = """samples, round(CASE WHEN applied THEN cl ELSE 0.4 END, 6) AS lexical, round(CASE WHEN applied THEN cm ELSE 0.4 END, 6) AS semantic, round(CASE WHEN applied THEN ca ELSE 0.1 END, 6) AS co_access, round(CASE WHEN applied THEN ca ELSE 0.1 END, 6) AS recency,
  round(cl, 6) AS candidate_lexical, round(cm, 6) AS candidate_semantic, round(ca, 6) AS candidate_co_access, round(ca, 6) AS candidate_recency, applied, outcome_label,
  round((abs(cl - 0.4) + abs(cm - 0.4) + 2 * abs(ca - 0.1)) / 4, 6) AS candidate_delta, CASE WHEN outcome_label = 'regressing' THEN 'regressing' WHEN applied THEN 'improving' ELSE 'neutral' END AS learning_state,
  CASE WHEN applied THEN 'promoted' WHEN outcome_label = 'regressing' THEN 'rolled_back' ELSE 'no_change' END AS last_learning_outcome"""


@query("learn_weights", f"{_LEARN} SELECT {_LEARN_COLS} FROM n")
def learn_weights(t):
    return telemetry.learn_weights(telemetry.groundedness_window(t.tool_events()), True)


@query("latest_snapshot", f"{_LEARN} SELECT learning_state, last_learning_outcome, candidate_delta FROM (SELECT {_LEARN_COLS} FROM n)")
def latest_snapshot(t):
    return telemetry.learn_weights(telemetry.groundedness_window(t.tool_events()), True).select("learning_state", "last_learning_outcome", "candidate_delta")


@query("shadow_scores", f"{_LEARN}, o AS (SELECT {_LEARN_COLS} FROM n), q AS (SELECT tool AS lane, avg(groundedness_score) AS quality FROM tool_events GROUP BY 1 UNION ALL SELECT 'lexical', avg(groundedness_score) FROM tool_events UNION ALL SELECT 'semantic', avg(groundedness_score) FROM tool_events) SELECT lane, round(coalesce(quality, 0) * CASE lane WHEN 'lexical' THEN lexical WHEN 'semantic' THEN semantic ELSE 1.0 END, 4) AS baseline, round(coalesce(quality, 0) * CASE lane WHEN 'lexical' THEN candidate_lexical WHEN 'semantic' THEN candidate_semantic ELSE 1.0 END, 4) AS candidate FROM q, o")
def shadow_scores(t):
    e = t.tool_events()
    q = e.groupBy(F.col("tool").alias("lane")).agg(F.avg("groundedness_score").alias("quality"))
    both = e.agg(F.avg("groundedness_score").alias("quality")).select(F.explode(F.array(F.lit("lexical"), F.lit("semantic"))).alias("lane"), "quality")
    return telemetry.shadow_scores(telemetry.learn_weights(telemetry.groundedness_window(e), True), q.unionByName(both))


@query("scope_norm", "SELECT worktree_id, CAST(sum(n) AS BIGINT) AS n FROM (SELECT coalesce(nullif(trim(CASE WHEN tool = 'view' THEN '  ' WHEN tool = 'click' THEN NULL ELSE ' ' || worktree_id || ' ' END), ''), 'project-root') AS worktree_id, 1 AS n FROM tool_events) GROUP BY 1")
def scope_norm(t):
    raw = F.when(F.col("tool") == "view", "  ").when(F.col("tool") == "click", None).otherwise(F.concat(F.lit(" "), "worktree_id", F.lit(" ")))
    return t.tool_events().groupBy(X.scope(raw).alias("worktree_id")).agg(F.count(F.lit(1)).alias("n"))


@query("extract_ref", r"""SELECT ref, count(*) AS n FROM (SELECT list_filter(string_split_regex(concat('find task-', result_count, ' ', query), '\s+'), lambda x: starts_with(x, 'task-'))[1] AS ref FROM tool_events) GROUP BY 1""")
def extract_ref(t):
    text = F.concat(F.lit("find task-"), "result_count", F.lit(" "), "query")
    ref = F.try_element_at(F.filter(X.words(text), lambda x: x.startswith("task-")), F.lit(1))
    return t.tool_events().groupBy(ref.alias("ref")).agg(F.count(F.lit(1)).alias("n"))


@query("pending_updates", "SELECT session_id, bool_or(regexp_matches(p, 'mod\\.rs|lib\\.rs|main\\.rs|router|server|handler|service|middleware|api')) AS architecture, bool_or(regexp_matches(p, 'error|types|schema|model|config|util|helper')) AS conventions, bool_or(regexp_matches(p, 'docker|makefile|justfile|cargo\\.toml|package\\.json|\\.env|setup|compose')) AS setup FROM (SELECT session_id, lower(concat(replace(file_path, '.rs', ''), '/', tool, CASE tool WHEN 'view' THEN 'Model' WHEN 'signup' THEN 'Setup' WHEN 'purchase' THEN '/api' ELSE '' END)) AS p FROM (SELECT a.*, e.tool FROM chunk_access a JOIN tool_events e USING (id))) GROUP BY 1".replace("\\\\", "\\"))
def pending_updates(t):
    tail = F.when(F.col("tool") == "view", "Model").when(F.col("tool") == "signup", "Setup").when(F.col("tool") == "purchase", "/api").otherwise("")
    p = t.tool_events().select("session_id", F.concat(F.lit("src/f"), "result_count", F.lit("/"), "tool", tail).alias("p"))
    return p.groupBy("session_id").agg(*[F.bool_or(X.touches(F.col("p"), c)).alias(c) for c in ("architecture", "conventions", "setup")])


@query("regression_status", "SELECT golden_set, id, overall_score, round(m, 6) AS moving_avg, round(overall_score - m, 6) AS delta, state FROM runs_state")
def regression_status(t):
    return evals.regression(t.eval_runs())


@query("eval_history", "SELECT golden_set, id, overall_score, round(overall_score - lag(overall_score) OVER (PARTITION BY golden_set ORDER BY created_at, id), 6) AS change FROM eval_runs")
def eval_history(t):
    return evals.history(t.eval_runs())


@query("latest_eval", "SELECT golden_set, id, overall_score, passed FROM runs_w WHERE latest = 1")
def latest_eval(t):
    return evals.latest_runs(t.eval_runs()).select("golden_set", "id", "overall_score", "passed")


@query("ci_decision", "SELECT golden_set, overall_score, CASE WHEN overall_score < 0.45 THEN 'below_threshold' WHEN NOT passed THEN 'critical_failed' WHEN state = 'regression' THEN 'regression' ELSE 'pass' END AS decision FROM runs_state WHERE latest = 1")
def ci_decision(t):
    return evals.ci_decision(t.eval_runs())


@query("rfc3339", "SELECT id, strftime(make_timestamp(created_at * 1000000), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS at FROM tool_events")
def rfc3339(t):
    return t.tool_events().select("id", X.rfc3339(F.col("created_at")).alias("at"))


@query("health_scores", "SELECT golden_set, overall_score, state, gate, (SELECT greatest(0, 100 - 3 * count(*) FILTER (WHERE severity = 'warning') - count(*) FILTER (WHERE severity = 'info')) FROM issues) AS drift_score, CASE WHEN overall_score * 100 >= 80 THEN 'healthy' WHEN overall_score * 100 >= 50 THEN 'degraded' ELSE 'unhealthy' END AS grade FROM runs_state, gate_row WHERE latest = 1")
def health_scores(t):
    from trailhead.functions.health import grade
    from trailhead.operators.graph import eval_gate

    runs = t.eval_runs()
    f = t.freshness()
    drifted = drift.score(drift.staleness(f, f.agg(F.max("last").alias("now")), 30, 10)).select(F.col("score").alias("drift_score"))
    last = evals.latest_runs(runs).join(evals.regression(runs).select("id", "state"), "id").crossJoin(F.broadcast(eval_gate(runs))).crossJoin(F.broadcast(drifted))  # gate and score are one row
    return last.select("golden_set", "overall_score", "state", "gate", "drift_score", grade(F.col("overall_score") * 100).alias("grade"))


_WEEK = "created_at // 86400 BETWEEN (SELECT min(created_at) // 86400 FROM tool_events) + 2 AND (SELECT min(created_at) // 86400 FROM tool_events) + 20"


@query("approximate_usage", f"SELECT tool, count(*) AS calls, true AS sessions_near, true AS latency_near FROM tool_events WHERE {_WEEK} GROUP BY tool")
def approximate_usage(t):
    """Stored daily sketches merged over a range of days, held against the exact figures: sessions within a twentieth, latency quantiles within three
    hundredths of their ranks."""
    e = t.tool_events()
    first = e.agg(F.floor(F.min("created_at") / sketches.DAY)).first()[0]  # one value
    if first is None:
        return t.spark.createDataFrame([], "tool string, calls long, sessions_near boolean, latency_near boolean")
    stored = written(sketches.daily(e), "sketches")
    got = sketches.over(stored, first + 2, first + 20)
    days = e.withColumn("day", F.floor(F.col("created_at") / sketches.DAY)).where(F.col("day").between(first + 2, first + 20))
    exact = days.groupBy("tool").agg(F.countDistinct("session_id").alias("n"))
    met = days.join(F.broadcast(got.select("tool", "latency")), "tool").groupBy("tool").agg(*[F.avg((F.col("latency_ms") < F.col("latency")[i]).cast("double")).alias(f"lo{i}") for i in (0, 1)], *[F.avg((F.col("latency_ms") <= F.col("latency")[i]).cast("double")).alias(f"hi{i}") for i in (0, 1)])  # a row per tool
    near = (F.col("lo0") <= 0.53) & (F.col("hi0") >= 0.47) & (F.col("lo1") <= 0.98) & (F.col("hi1") >= 0.92)
    return got.join(exact, "tool").join(met, "tool").select("tool", "calls", (F.abs(F.col("sessions") - F.col("n")) <= F.greatest(F.lit(1.0), F.col("n") / 20)).alias("sessions_near"), near.alias("latency_near"))


_LANED = "(SELECT *, regexp_extract(strategy, 'lane=([^;]*)', 1) AS lane FROM scoped_events)"


@query("usage_cube", f"SELECT tool, lane, worktree_id, CAST(grouping(tool, lane, worktree_id) AS BIGINT) AS level, count(*) AS calls, CAST(sum(latency_ms) AS BIGINT) AS latency_ms FROM {_LANED} GROUP BY CUBE (tool, lane, worktree_id)")
def usage_cube(t):
    e = telemetry.scoped(t.tool_events()).withColumn("lane", F.regexp_extract("strategy", "lane=([^;]*)", 1))
    return sketches.usage_cube(e, ["tool", "lane", "worktree_id"])


@query("usage_rollup", "SELECT worktree_id, session_id, tool, CAST(grouping(worktree_id, session_id, tool) AS BIGINT) AS level, count(*) AS calls, CAST(sum(latency_ms) AS BIGINT) AS latency_ms FROM scoped_events GROUP BY ROLLUP (worktree_id, session_id, tool)")
def usage_rollup(t):
    return sketches.usage_rollup(telemetry.scoped(t.tool_events()), ["worktree_id", "session_id", "tool"])


@query("stream_latest", "SELECT path, id, timestamp, agent FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY timestamp DESC, id DESC) AS r FROM activity) WHERE r = 1")
def stream_latest(t):
    """The activity's table read as a stream into an exactly-once sink that keeps each path's latest event. Runs the stream to its end."""
    kind = "path string, order_ struct<timestamp: long, id: long>, agent string"
    sink = LatestSink(t.spark, scratch_table(t.spark, "latest"), kind, "path", "order_")
    stream = t.streamed().activity().select("path", F.struct("timestamp", "id").alias("order_"), "agent")
    sink.start(stream, scratch_table(t.spark, "latest-checkpoint")).awaitTermination()
    return sink.frame().select("path", "order_.id", "order_.timestamp", "agent")
