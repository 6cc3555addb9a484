"""Queries over golden sets, drift, activity and project files."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailhead.functions import health
from trailhead.functions import text as X
from trailhead.operators import drift, evals, graph
from trailhead.plans import fixtures
from trailhead.plans.registry import query
from trailhead.plans.sql_tables import golden
from trailhead.sources import files as S


def _violations(t, scope=None):
    return evals.case_violations(t.golden_checks(), t.chunks(), fixtures.GOLDEN_CHECKS, scope)


@query("golden_violations", "SELECT case_id, kind, literal, file_path, start_line FROM golden_bad")
def golden_violations(t):
    return _violations(t)


@query("golden_diff_scope", "WITH d AS (" + golden("(SELECT * FROM chunks WHERE language = 'fr')") + ") SELECT case_id, kind, literal, file_path, start_line FROM d WHERE kind = 'must_not' UNION ALL SELECT case_id, kind, literal, 'N/A', 0 FROM golden_rows g WHERE kind = 'must' AND NOT EXISTS (SELECT 1 FROM d h WHERE h.case_id = g.case_id AND h.literal = g.literal AND h.kind = 'must')")
def golden_diff_scope(t):
    return _violations(t, t.files().where("language = 'fr'"))


@query("golden_empty_scope", "SELECT case_id, kind, literal, file_path, start_line FROM golden_bad")
def golden_empty_scope(t):
    return _violations(t, t.files().where("language = 'none'"))


_CODE = "SELECT '{0}' AS case_id, '{1}' AS kind, '{2}' AS literal"


_CODE_BAD = f"""{_CODE.format('s2', 'structural_must', 'python:absent($X)')}, 'N/A' AS file_path, 0 AS start_line UNION ALL {_CODE.format('s2', 'invalid_structural_pattern', 'no language')}, 'N/A', 0
UNION ALL SELECT * FROM ({_CODE.format('s1', 'structural_must_not', 'python:print($X)')}, file_path, 12 FROM code_files WHERE k % 3 = 0 ORDER BY file_path LIMIT 10)
UNION ALL SELECT * FROM ({_CODE.format('s3', 'structural_must_not', 'python:self.run($X)')}, file_path, 9 FROM code_files WHERE starts_with(file_path, 'src/p2') AND NOT ends_with(file_path, '2.py') ORDER BY file_path LIMIT 10)"""


@query("structural_violations", _CODE_BAD)
def structural_violations(t):
    return evals.structural_violations(t.code_files(), fixtures.CODE_CHECKS)


def _evaluated(t):
    checks = t.spark.createDataFrame(fixtures.ALL_CHECKS, t.golden_checks().schema)
    return evals.case_scores(checks, evals.all_violations(checks, t.chunks(), t.code_files(), fixtures.ALL_CHECKS))


_EVALUATED = f"""SELECT *, round(greatest(0.0, 1 - CAST(violations AS DOUBLE) / checks), 6) AS score, violations = 0 AS passed, CASE priority WHEN 'critical' THEN 2.0 WHEN 'high' THEN 1.5 WHEN 'low' THEN 0.5 ELSE 1.0 END AS weight
FROM (SELECT case_id, priority, checks, coalesce(v.violations, 0) AS violations, coalesce(v.files, 0) AS files FROM (SELECT case_id, priority, count(*) AS checks FROM (VALUES {", ".join(f"('{r[0]}', '{r[1]}')" for r in fixtures.ALL_CHECKS)}) c(case_id, priority) GROUP BY 1, 2)
LEFT JOIN (SELECT case_id, count(*) AS violations, count(DISTINCT CASE WHEN file_path <> 'N/A' THEN file_path END) AS files FROM (SELECT case_id, file_path FROM golden_bad UNION ALL SELECT case_id, file_path FROM ({_CODE_BAD})
UNION ALL SELECT * FROM (SELECT 'c5', file_path FROM code_files WHERE k % 3 = 0 ORDER BY file_path LIMIT 10)) GROUP BY 1) v USING (case_id))"""


@query("evaluated_cases", f"SELECT case_id, priority, checks, violations, files, score, passed FROM ({_EVALUATED})")
def evaluated_cases(t):
    return _evaluated(t).drop("weight")


@query("evaluated_set", f"SELECT round(sum(score * weight) / sum(weight), 6) AS overall_score, bool_and(passed) FILTER (WHERE priority = 'critical') AS critical_pass FROM ({_EVALUATED})")
def evaluated_set(t):
    return evals.golden_score(_evaluated(t))


@query("case_scores", "SELECT case_id, priority, checks, violations, score, passed FROM golden_cases")
def case_scores(t):
    return evals.case_scores(t.golden_checks(), _violations(t)).select("case_id", "priority", "checks", "violations", "score", "passed")


@query("case_files", "SELECT case_id, files FROM golden_cases")
def case_files(t):
    return evals.case_scores(t.golden_checks(), _violations(t)).select("case_id", "files")


@query("golden_score", "SELECT round(sum(score * weight) / sum(weight), 6) AS overall_score FROM golden_cases")
def golden_score(t):
    return evals.golden_score(evals.case_scores(t.golden_checks(), _violations(t))).select("overall_score")


@query("golden_gate", "SELECT coalesce(bool_and(passed) FILTER (WHERE priority = 'critical'), true) AS critical_pass FROM golden_cases")
def golden_gate(t):
    return evals.golden_score(evals.case_scores(t.golden_checks(), _violations(t))).select("critical_pass")


def _issues(t):
    f = t.freshness()
    return drift.staleness(f, f.agg(F.max("last").alias("now")), 30, 10)


@query("staleness_issues", "SELECT checker, file, message, severity FROM issues")
def staleness_issues(t):
    return _issues(t)


@query("drift_score", "SELECT greatest(0, 100 - 3 * count(*) FILTER (WHERE severity = 'warning') - count(*) FILTER (WHERE severity = 'info')) AS score, 0 AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings, count(*) FILTER (WHERE severity = 'info') AS infos FROM issues")
def drift_score(t):
    return drift.score(_issues(t))


@query("issues_by_file", "SELECT file, count(*) AS issues, string_agg(checker || ': ' || message, '; ' ORDER BY checker || ': ' || message) AS messages FROM issues GROUP BY 1")
def issues_by_file(t):
    return drift.by_file(_issues(t))


@query("missing_required", "SELECT 'completeness' AS checker, 'ctx/c' || c_custkey || '.md' AS file, 'missing' AS message, 'error' AS severity FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def missing_required(t):
    required = t.raw("customer").select(F.concat(F.lit("ctx/c"), "c_custkey", F.lit(".md")).alias("file"))
    return drift.missing_required(required, t.freshness())


@query("convention_paths", "SELECT 'convention_paths' AS checker, concat(c.file, ':2') AS file, concat('scope glob ''', folder, '/*', ext, ''' matches no files') AS message, 'warning' AS severity FROM convention_rows c WHERE NOT EXISTS (SELECT 1 FROM files f WHERE concat(f.source, '/', f.language) = c.folder AND ends_with(f.file_path, c.ext))")
def convention_paths(t):
    return drift.unmatched_scopes(t.convention_files(), t.files().select("file_path"))


@query("convention_patterns", "SELECT 'convention_patterns' AS checker, concat(file, ':4') AS file, CASE WHEN pattern = '' THEN 'check_pattern is empty' ELSE concat('unsupported language ''', language, ''' in check_pattern') END AS message, 'warning' AS severity FROM convention_rows WHERE pattern = '' OR language IN ('cobol', 'go')")
def convention_patterns(t):
    return drift.bad_patterns(t.convention_files())


@query("referenced_skills", "SELECT 'skills_referenced' AS checker, concat(file, ':5') AS file, concat('Referenced skill ''', skill, ''' not found') AS message, 'warning' AS severity FROM convention_rows c WHERE NOT EXISTS (SELECT 1 FROM skill_files s WHERE s.file IN (c.skill || '.md', c.skill || '.yaml', c.skill || '.yml', c.skill || '.txt'))")
def referenced_skills(t):
    return drift.missing_skills(t.convention_files(), t.skill_files())


@query("severity_counts", "SELECT severity, count(*) AS n FROM (SELECT severity FROM convention_rows WHERE severity <> 'none' UNION ALL SELECT 'error' FROM convention_rows) GROUP BY 1")
def severity_counts(t):
    lines = t.convention_files().select(F.explode(X.lines(F.col("body"))).alias("line")).select(F.regexp_extract("line", r"\b(error|warning|info)\b", 1).alias("severity"))
    return lines.where("severity <> ''").groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


@query("dep_versions", "SELECT dep, version, count(*) AS locations FROM manifest_rows GROUP BY 1, 2")
def dep_versions(t):
    return S.manifest_dependencies(t.manifest_files()).groupBy("dep", "version").agg(F.count(F.lit(1)).alias("locations"))


@query("version_conflicts", "SELECT dep, count(DISTINCT version) AS versions, count(*) AS locations, array_to_string(list_sort(list(DISTINCT version)), ',') AS version_list FROM manifests GROUP BY 1 HAVING count(DISTINCT version) > 1")
def version_conflicts(t):
    return drift.version_conflicts(t.manifests())


def _refs(t):
    return t.script_docs().select("file", F.explode(X.script_refs(F.col("body"))).alias("script"))


@query("script_refs", "SELECT file, script FROM doc_refs")
def script_refs(t):
    return _refs(t)


@query("undeclared_refs", "SELECT file, script FROM doc_refs WHERE script NOT IN (SELECT script FROM declared_scripts)")
def undeclared_refs(t):
    return drift.undeclared(_refs(t), t.declared_scripts())


@query("index_links", "SELECT file FROM index_targets")
def index_links(t):
    return S.index_links(t.index_files(), "body")


@query("index_sync_drift", "SELECT 'index_dangling' AS checker, file, 'missing' AS message, 'error' AS severity FROM index_targets WHERE file NOT IN (SELECT file FROM pattern_files) UNION ALL SELECT 'index_unlisted', file, 'missing', 'warning' FROM pattern_files WHERE file NOT IN (SELECT file FROM index_targets)")
def index_sync_drift(t):
    return drift.index_sync(S.index_links(t.index_files(), "body"), t.pattern_files())


@query("doc_titles", "SELECT concat('doc', p_partkey) AS name, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_type ELSE concat('doc', p_partkey) END AS title FROM part")
def doc_titles(t):
    return S.titles(t.titled_docs())


@query("parse_records", "SELECT s_suppkey AS project, 1 AS place, concat('/w/main', s_suppkey) AS path, md5(CAST(s_suppkey AS VARCHAR)) AS head, concat('b', s_suppkey) AS branch, false AS locked, false AS prunable FROM supplier UNION ALL SELECT s_suppkey, 2, concat('/w/side', s_suppkey), 'bbbb', NULL, true, true FROM supplier WHERE s_suppkey % 2 = 0")
def parse_records(t):
    return S.worktree_records(t.worktree_listings(), "body")


_REL = "CASE WHEN starts_with(p, '/work/') THEN substr(p, 7) WHEN NOT starts_with(p, '/') THEN p END"


@query("ignore_paths", rf"SELECT path, rel, coalesce(regexp_matches(rel, '^(\.git/|target/|node_modules/|\.activity/)') OR regexp_matches(rel, '(\.swp|\.tmp)$'), true) AS ignored FROM (SELECT path, {_REL} AS rel FROM (SELECT path, replace(path, chr(92), '/') AS p FROM watched_paths))")
def ignore_paths(t):
    p = F.col("path")
    return t.watched_paths().select("path", X.relative(p, "/work").alias("rel"), X.unwatched(p, "/work").alias("ignored"))


@query("core_events", "SELECT kind, count(*) AS n FROM (SELECT ['create', 'modify', 'remove', 'access', 'other'][id % 5 + 1] AS kind FROM tool_events) WHERE kind IN ('create', 'modify', 'remove') GROUP BY 1")
def core_events(t):
    kinds = t.tool_events().select(F.element_at(F.array(*map(F.lit, ("create", "modify", "remove", "access", "other"))), (F.col("id") % 5 + 1).cast("int")).alias("kind"))
    return kinds.where(X.core_event(F.col("kind"))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("activity_conflicts", """SELECT id, path, agent, other_agent, age FROM (SELECT a.id, a.path, a.agent, b.agent AS other_agent, a.timestamp - b.timestamp AS age, row_number() OVER (PARTITION BY a.id ORDER BY b.timestamp DESC, b.id DESC) AS r
 FROM activity a JOIN activity b ON a.path = b.path AND a.agent <> b.agent AND (b.timestamp < a.timestamp OR (b.timestamp = a.timestamp AND b.id < a.id)) AND a.timestamp - b.timestamp <= 3600) WHERE r = 1""")
def activity_conflicts(t):
    return drift.latest_in_window(t.activity(), 3600)


@query("debounce_events", """WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY timestamp, id) AS r FROM activity), f AS (SELECT path, id, r, timestamp AS last, true AS kept FROM o WHERE r = 1
 UNION ALL SELECT o.path, o.id, o.r, CASE WHEN o.timestamp - f.last >= 21600 THEN o.timestamp ELSE f.last END, o.timestamp - f.last >= 21600 FROM f JOIN o ON o.path = f.path AND o.r = f.r + 1) SELECT path, id FROM f WHERE kept""")
def debounce_events(t):
    return drift.debounce(t.activity(), 21600)


@query("windowed_telemetry", "SELECT CAST(floor(created_at / 21600.0) AS BIGINT) * 21600 AS start, tool, count(*) AS calls, CAST(sum(latency_ms) AS BIGINT) AS latency_ms FROM tool_events GROUP BY 1, 2")
def windowed_telemetry(t):
    from trailhead.streaming.windows import windowed_calls

    return windowed_calls(t.tool_events(), "6 hours")


@query("session_gaps", "WITH g AS (SELECT session_id, created_at, CASE WHEN created_at - lag(created_at) OVER (PARTITION BY session_id ORDER BY created_at) < 21600 THEN 0 ELSE 1 END AS new FROM tool_events), r AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY created_at ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT session_id, min(created_at) AS started, count(*) AS calls FROM r GROUP BY session_id, run")
def session_gaps(t):
    from trailhead.streaming.windows import session_gaps as gaps

    return gaps(t.tool_events(), "6 hours")


_STALE = "(SELECT count(*) FROM intents WHERE status = 'in_progress' AND (SELECT max(updated_at) FROM intents) - updated_at > 7 * 86400)"


@query("doctor_checks", f"""WITH RECURSIVE e AS (SELECT from_id, to_id FROM looped_edges WHERE kind = 'depends_on'), c AS (SELECT from_id AS start, to_id AS id FROM e UNION SELECT c.start, e.to_id FROM c JOIN e ON e.from_id = c.id),
n AS (SELECT (SELECT count(*) FROM chunks) AS i, (SELECT count(*) FROM intents WHERE status = 'draft') AS d, (SELECT gate FROM gate_row) AS g, (SELECT count(*) FROM intents WHERE status NOT IN ('blocked', 'rejected', 'merged', 'verified') AND id IN (SELECT l.from_id FROM looped_edges l JOIN intents t ON t.id = l.to_id WHERE l.kind = 'depends_on' AND t.status = 'rejected')) AS b,
 (SELECT count(*) FROM c WHERE start = id) AS y, {_STALE} AS s, (SELECT count(*) FROM golden_rows) AS q, (SELECT coalesce(bool_and(passed) FILTER (WHERE priority = 'critical'), true) AND sum(score * weight) / sum(weight) >= 0.45 FROM golden_cases) AS ci)
SELECT 'index' AS name, i > 0 AS ok FROM n UNION ALL SELECT 'cycles', y = 0 FROM n UNION ALL SELECT 'auto_block', b = 0 FROM n UNION ALL SELECT 'stale', s = 0 FROM n UNION ALL SELECT 'drafts', d <= 10 FROM n UNION ALL SELECT 'golden_sets', q > 0 FROM n UNION ALL SELECT 'golden_parse', true FROM n
UNION ALL SELECT 'ci_gate', ci FROM n UNION ALL SELECT 'eval_gate', g = 'pass' FROM n UNION ALL SELECT 'config_version', true UNION ALL SELECT 'initialised', true UNION ALL SELECT 'hooks', false""")
def doctor_checks(t):
    i, now = t.intents(), t.intents().agg(F.max("updated_at").alias("now"))
    golden = evals.golden_score(evals.case_scores(t.golden_checks(), _violations(t)))
    bad = F.col("literal").contains("{{") | (F.col("kind").startswith("structural") & ~F.col("literal").rlike(r"^\s*\w+\s*:\s*\S"))
    none = F.count(F.lit(1)) == 0
    checks = {
        "index": t.chunks().limit(1).agg((F.count(F.lit(1)) > 0).alias("ok")),
        "cycles": graph.validate(i, t.looped_edges()).select((~F.col("has_cycles")).alias("ok")),
        "auto_block": graph.auto_block(i, t.looped_edges()).agg(none.alias("ok")),
        "stale": graph.stale(i, now, 7 * 24).agg(none.alias("ok")),
        "drafts": i.where("status = 'draft'").agg((F.count(F.lit(1)) <= 10).alias("ok")),
        "golden_sets": t.golden_checks().agg((F.count(F.lit(1)) > 0).alias("ok")),
        "golden_parse": t.golden_checks().where(bad).agg(none.alias("ok")),
        "ci_gate": golden.select((F.col("critical_pass") & (F.col("overall_score") >= 0.45)).alias("ok")),
        "eval_gate": graph.eval_gate(t.eval_runs()).select((F.col("gate") == "pass").alias("ok")),
    }
    return health.doctor(checks, {"config_version": True, "initialised": True, "hooks": False})
