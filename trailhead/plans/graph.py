"""Queries over intents, their edges, locks and co-access."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailhead.functions import text as X
from trailhead.operators import graph, memory
from trailhead.plans.fixtures import PREFIXES
from trailhead.plans.registry import query
from trailhead.schemas import INTENT_STATUSES


@query("list_intents", "SELECT id, kind, status, priority, updated_at FROM intents WHERE status = 'approved' AND kind IN ('bug', 'feature')")
def list_intents(t):
    return t.intents().where("status = 'approved' and kind in ('bug', 'feature')").orderBy(F.desc("updated_at"), "id").select("id", "kind", "status", "priority", "updated_at")


@query("intent_counts", "SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in INTENT_STATUSES) + " FROM intents")
def intent_counts(t):
    return t.intents().agg(F.count(F.lit(1)).alias("total"), *[F.count(F.when(F.col("status") == s, 1)).alias(s) for s in INTENT_STATUSES])


@query("direct_deps", "SELECT from_id, to_id, to_status FROM dep_edges")
def direct_deps(t):
    return graph.direct(t.intent_edges(), t.intents()).select("from_id", "to_id", "to_status")


@query("dependents", "SELECT e.to_id AS id, e.from_id AS dependent, i.status FROM intent_edges e JOIN intents i ON i.id = e.from_id WHERE e.kind = 'depends_on'")
def dependents(t):
    e = t.intent_edges().where("kind = 'depends_on'").select(F.col("to_id").alias("id"), F.col("from_id").alias("dependent"))
    return e.join(t.intents().select(F.col("id").alias("dependent"), "status"), "dependent").select("id", "dependent", "status")


@query("ready_intents", "SELECT id, priority FROM intents i WHERE status = 'approved' AND NOT EXISTS (SELECT 1 FROM dep_edges d WHERE d.from_id = i.id AND d.to_status NOT IN ('verified', 'merged'))")
def ready_intents(t):
    return graph.ready(t.intents(), t.intent_edges()).select("id", "priority")


_SAT = "SELECT i.id, count(d.to_id) AS deps, count(*) FILTER (WHERE d.to_status NOT IN ('verified', 'merged')) = 0 AS satisfied FROM intents i LEFT JOIN dep_edges d ON d.from_id = i.id GROUP BY i.id"


@query("deps_satisfied", _SAT)
def deps_satisfied(t):
    return graph.deps_satisfied(t.intents(), t.intent_edges())


@query("intent_context", f"SELECT s.id, s.deps, f.first_dep, coalesce(b.n, 0) AS dependents, b.first_dependent, s.satisfied FROM ({_SAT}) s LEFT JOIN (SELECT from_id, min(to_id) AS first_dep FROM dep_edges GROUP BY 1) f ON f.from_id = s.id LEFT JOIN (SELECT to_id, count(*) AS n, min(from_id) AS first_dependent FROM dep_edges GROUP BY 1) b ON b.to_id = s.id")
def intent_context(t):
    return graph.context(t.intents(), t.intent_edges())


@query("auto_block", "SELECT id, status, 'blocked' AS new_status FROM intents WHERE status NOT IN ('blocked', 'rejected', 'merged', 'verified') AND id IN (SELECT from_id FROM dep_edges WHERE to_status = 'rejected')")
def auto_block(t):
    return graph.auto_block(t.intents(), t.intent_edges()).select("id", "status", "new_status")


@query("transitive_deps", "WITH RECURSIVE c AS (SELECT i.id AS start, e.to_id AS id FROM intents i JOIN dep_edges e ON e.from_id = i.id WHERE i.status = 'in_progress' UNION SELECT c.start, e.to_id FROM c JOIN dep_edges e ON e.from_id = c.id) SELECT start, id FROM c")
def transitive_deps(t):
    return graph.transitive(t.intent_edges(), t.intents().where("status = 'in_progress'").select("id"))


@query("cycle_nodes", "WITH RECURSIVE c AS (SELECT from_id AS start, to_id AS id FROM cyclic_edges UNION SELECT c.start, e.to_id FROM c JOIN cyclic_edges e ON e.from_id = c.id) SELECT DISTINCT id FROM c WHERE start = id")
def cycle_nodes(t):
    return graph.cycle_nodes(t.cyclic_edges())


@query("graph_validation", "WITH RECURSIVE e AS (SELECT from_id, to_id FROM looped_edges WHERE kind = 'depends_on'), c AS (SELECT from_id AS start, to_id AS id FROM e UNION SELECT c.start, e.to_id FROM c JOIN e ON e.from_id = c.id), n AS (SELECT DISTINCT id FROM c WHERE start = id) SELECT count(*) > 0 AS has_cycles, count(*) AS cyclic, min(id) AS first_cyclic, (SELECT count(*) FROM intents WHERE status NOT IN ('blocked', 'rejected', 'merged', 'verified') AND id IN (SELECT l.from_id FROM looped_edges l JOIN intents i ON i.id = l.to_id WHERE l.kind = 'depends_on' AND i.status = 'rejected')) AS auto_blocked FROM n")
def graph_validation(t):
    return graph.validate(t.intents(), t.looped_edges())


@query("edge_outcomes", "SELECT DISTINCT r.from_id, r.to_id, r.kind, CASE WHEN r.from_id = r.to_id THEN 'self_loop' WHEN e.from_id IS NOT NULL THEN 'duplicate' ELSE 'inserted' END AS outcome FROM edge_requests r LEFT JOIN intent_edges e ON e.from_id = r.from_id AND e.to_id = r.to_id AND e.kind = r.kind")
def edge_outcomes(t):
    return graph.insert_edges(t.intent_edges(), t.edge_requests())


@query("edges_removed", "SELECT from_id, to_id, kind FROM intent_edges WHERE (from_id, to_id, kind) NOT IN (SELECT from_id, to_id, kind FROM edge_requests)")
def edges_removed(t):
    return graph.remove_edges(t.intent_edges(), t.edge_requests())


@query("edge_degrees", "SELECT i.id, coalesce(o.n, 0) AS outgoing, coalesce(n.n, 0) AS incoming FROM intents i LEFT JOIN (SELECT from_id, count(*) AS n FROM intent_edges GROUP BY 1) o ON o.from_id = i.id LEFT JOIN (SELECT to_id, count(*) AS n FROM intent_edges GROUP BY 1) n ON n.to_id = i.id")
def edge_degrees(t):
    return graph.edge_degrees(t.intents(), t.intent_edges())


_LEGAL = " OR ".join(f"(current = '{a}' AND requested = '{b}')" for a, b in graph.TRANSITIONS) + " OR requested = 'blocked'"


@query("valid_transitions", f"SELECT current, requested, {_LEGAL} AS legal, count(*) AS n FROM transition_requests GROUP BY 1, 2, 3")
def valid_transitions(t):
    return t.transition_requests().groupBy("current", "requested", graph.legal(F.col("current"), F.col("requested")).alias("legal")).agg(F.count(F.lit(1)).alias("n"))


@query("eval_gate", "SELECT gate FROM gate_row")
def eval_gate(t):
    return graph.eval_gate(t.eval_runs())


@query("transition_outcomes", f"""WITH j AS (SELECT id, current, requested, CASE WHEN NOT ({_LEGAL}) THEN 'invalid_transition' WHEN ((current = 'in_review' AND requested = 'verified') OR (current = 'verified' AND requested = 'merged')) AND gate <> 'pass' THEN gate ELSE 'accepted' END AS outcome FROM transition_requests, gate_row)
SELECT *, CASE WHEN outcome <> 'accepted' THEN 'none' WHEN current <> 'in_progress' AND requested = 'in_progress' THEN 'acquire' WHEN current = 'in_progress' AND requested <> 'in_progress' THEN 'release' ELSE 'none' END AS lock FROM j""")
def transition_outcomes(t):
    return graph.transition_outcomes(t.transition_requests(), graph.eval_gate(t.eval_runs()))


@query("project_overview", "SELECT (SELECT count(DISTINCT file_path) FROM chunks) AS files, (SELECT count(*) FROM chunks) AS total_chunks, (SELECT string_agg(DISTINCT language, ',' ORDER BY language) FROM chunks) AS languages, count(*) AS total_intents, count(*) FILTER (WHERE status = 'in_progress') AS active, count(*) FILTER (WHERE status = 'blocked') AS stuck, (SELECT count(*) FROM intents i WHERE status = 'approved' AND NOT EXISTS (SELECT 1 FROM dep_edges d WHERE d.from_id = i.id AND d.to_status NOT IN ('verified', 'merged'))) AS ready, strftime(make_timestamp(CAST(max(updated_at) * 1000000 AS BIGINT)), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS last_change FROM intents")
def project_overview(t):
    i = t.intents()
    parts = [
        t.chunks().agg(F.countDistinct("file_path").alias("files"), F.count(F.lit(1)).alias("total_chunks"), F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages")),
        i.agg(F.count(F.lit(1)).alias("total_intents"), F.count(F.when(F.col("status") == "in_progress", 1)).alias("active"), F.count(F.when(F.col("status") == "blocked", 1)).alias("stuck"), X.rfc3339(F.max("updated_at")).alias("last_change")),
        graph.ready(i, t.intent_edges()).agg(F.count(F.lit(1)).alias("ready")),
    ]
    return parts[0].crossJoin(F.broadcast(parts[1])).crossJoin(F.broadcast(parts[2]))  # each is one row


def _now(t):
    return t.intents().agg(F.max("updated_at").alias("now"))


@query("stale_intents", "SELECT id, updated_at FROM intents, (SELECT max(updated_at) AS now FROM intents) WHERE status = 'in_progress' AND now - updated_at > 48 * 3600")
def stale_intents(t):
    return graph.stale(t.intents(), _now(t)).select("id", "updated_at")


@query("stale_recovery", "SELECT id, status, CASE WHEN status = 'in_progress' AND now - updated_at > 48 * 3600 THEN 'approved' ELSE status END AS new_status FROM intents, (SELECT max(updated_at) AS now FROM intents)")
def stale_recovery(t):
    return graph.recover_stale(t.intents(), _now(t))


@query("resolve_prefix", "WITH p AS (SELECT prefix, CASE WHEN starts_with(prefix, 'i') THEN prefix ELSE 'i' || prefix END AS fully FROM (SELECT unnest(" + str(PREFIXES) + ") AS prefix)), m AS (SELECT prefix, fully, count(id) AS n, min(id) AS id, count(*) FILTER (WHERE id = fully) AS same FROM p LEFT JOIN intents ON starts_with(id, fully) GROUP BY 1, 2) SELECT prefix, n AS matches, CASE WHEN n = 0 THEN 'missing' WHEN n = 1 OR same = 1 THEN 'found' ELSE 'ambiguous' END AS outcome, CASE WHEN same = 1 THEN fully WHEN n = 1 THEN id END AS id FROM m")
def resolve_prefix(t):
    return graph.resolve_prefix(t.intents().select("id"), t.spark.createDataFrame([(p,) for p in PREFIXES], "prefix string"), "i")


@query("hash_id", "SELECT id, concat('task-', substr(sha256(id || title), 1, 8)) AS hashed FROM intents")
def hash_id(t):
    return t.intents().select("id", graph.hash_id("task-", F.concat("id", "title")).alias("hashed"))


@query("json_arrays", "SELECT id, concat('[\"', kind, '\",\"', priority, '\"]') AS encoded, 2 AS n, priority AS last FROM intents")
def json_arrays(t):
    e = t.intents().select("id", F.to_json(F.array("kind", "priority")).alias("encoded"))
    back = F.from_json("encoded", "array<string>")
    return e.select("id", "encoded", F.size(back).alias("n"), F.element_at(back, -1).alias("last"))


@query("lock_outcomes", """WITH RECURSIVE o AS (SELECT id, intent_id, coalesce(nullif(trim(worktree_id), ''), 'project-root') AS tree, action, ts, row_number() OVER (PARTITION BY intent_id ORDER BY ts, id) AS r FROM lock_requests),
f AS (SELECT id, intent_id, r, CASE WHEN action = 'release' THEN 'not_held' ELSE 'acquired' END AS outcome, CASE WHEN action = 'acquire' THEN tree END AS holder, CASE WHEN action = 'acquire' THEN ts + 3600 ELSE 0 END AS expires FROM o WHERE r = 1
 UNION ALL SELECT o.id, o.intent_id, o.r, CASE WHEN o.action = 'release' THEN CASE WHEN f.holder = o.tree AND f.expires > o.ts THEN 'released' ELSE 'not_held' END WHEN f.holder <> o.tree AND f.expires > o.ts THEN 'conflict' ELSE 'acquired' END,
  CASE WHEN o.action = 'release' THEN CASE WHEN f.holder = o.tree OR f.expires <= o.ts THEN NULL ELSE f.holder END WHEN f.holder <> o.tree AND f.expires > o.ts THEN f.holder ELSE o.tree END,
  CASE WHEN o.action = 'release' THEN CASE WHEN f.holder = o.tree OR f.expires <= o.ts THEN 0 ELSE f.expires END WHEN f.holder <> o.tree AND f.expires > o.ts THEN f.expires ELSE o.ts + 3600 END
 FROM f JOIN o ON o.intent_id = f.intent_id AND o.r = f.r + 1) SELECT id, intent_id, outcome, holder AS held_by FROM f""")
def lock_outcomes(t):
    return graph.lock_outcomes(t.lock_requests())


_LOCKS = "(SELECT intent_id, holder, worktree_id, ts AS acquired_at, ts + 3600 AS expires_at FROM (SELECT concat('i', result_count) AS intent_id, CAST(substr(session_id, 2) AS BIGINT) AS holder, worktree_id, created_at AS ts, row_number() OVER (PARTITION BY result_count ORDER BY created_at DESC, id DESC) AS r FROM tool_events) WHERE r = 1)"


def _locks(t):
    last = graph.latest(t.lock_requests(), ["intent_id"], [F.desc("ts"), F.desc("id")])
    return last.select("intent_id", "holder", "worktree_id", F.col("ts").alias("acquired_at"), (F.col("ts") + 3600).alias("expires_at"))


def _lock_now(t):
    return t.tool_events().agg(F.max("created_at").alias("now"))


@query("live_locks", f"SELECT l.* FROM {_LOCKS} l WHERE expires_at > (SELECT max(created_at) FROM tool_events)")
def live_locks(t):
    return graph.live_locks(_locks(t), _lock_now(t))


@query("worktree_owners", f"SELECT w.worktree_id, l.intent_id, l.holder FROM (SELECT DISTINCT worktree_id FROM tool_events) w LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY worktree_id ORDER BY acquired_at DESC, intent_id DESC) AS r FROM {_LOCKS} WHERE expires_at > (SELECT max(created_at) FROM tool_events)) l ON l.worktree_id = w.worktree_id AND l.r = 1")
def worktree_owners(t):
    live = graph.latest(graph.live_locks(_locks(t), _lock_now(t)), ["worktree_id"], [F.desc("acquired_at"), F.desc("intent_id")])
    return t.tool_events().select("worktree_id").distinct().join(live, "worktree_id", "left").select("worktree_id", "intent_id", "holder")


def _pairs(t):
    return memory.co_access_pairs(t.result_sets())


@query("co_access_pairs", "SELECT file_a, file_b, n FROM co_pairs")
def co_access_pairs(t):
    return _pairs(t)


_PROXIMITY = """SELECT a.file_path AS file_a, b.file_path AS file_b, count(*) AS n FROM near_files a JOIN near_files b ON a.id = b.id AND a.file_path < b.file_path GROUP BY 1, 2"""


@query("session_proximity", f"WITH last AS (SELECT e.id, a.file_path, max(a.accessed_at * 10000000 + a.id) AS stamp FROM scoped_access e JOIN scoped_access a ON a.session_id = e.session_id AND a.worktree_id = e.worktree_id AND a.accessed_at >= e.accessed_at - 21600 AND (a.accessed_at < e.accessed_at OR (a.accessed_at = e.accessed_at AND a.id <= e.id)) GROUP BY 1, 2), near_files AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY stamp DESC) AS r FROM last) WHERE r <= 10) {_PROXIMITY}")
def session_proximity(t):
    return memory.session_pairs(t.chunk_access(), window=21600)


@query("co_access_strength", "SELECT file_a, file_b, round(strength, 6) AS strength FROM strengths")
def co_access_strength(t):
    return memory.strengths(_pairs(t)).withColumn("strength", F.round("strength", 6))


def _edges(t):
    return memory.strengths(_pairs(t)).withColumn("strength", F.round("strength", 9))


@query("related_files", "SELECT file, other, round(strength, 6) AS strength, place FROM related_top")
def related_files(t):
    return memory.related(_edges(t)).withColumn("strength", F.round("strength", 6))


@query("session_suggestions", """WITH u AS (SELECT DISTINCT session_id, result_count + 1 AS file FROM tool_events), f AS (SELECT session_id, other, max(round(strength, 9)) AS strength FROM u JOIN related_top r ON r.file = u.file GROUP BY 1, 2),
k AS (SELECT f.*, row_number() OVER (PARTITION BY f.session_id ORDER BY strength DESC, other) AS place FROM f LEFT JOIN u ON u.session_id = f.session_id AND u.file = f.other WHERE u.file IS NULL) SELECT session_id, other, round(strength, 6) AS strength, place FROM k WHERE place <= 5""")
def session_suggestions(t):
    uses = t.tool_events().select("session_id", (F.col("result_count") + 1).cast("long").alias("file"))
    return memory.suggestions(uses, _edges(t)).withColumn("strength", F.round("strength", 6)).select("session_id", "other", "strength", "place")
