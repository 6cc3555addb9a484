"""The domain tables in DuckDB SQL."""

from trailhead.functions.porter import PATTERNS, STEP2, STEP3, STEP4
from trailhead.functions.text import FOLD_FROM, FOLD_TO


def _list(values: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values.split()) + "]"


STATUS = _list("draft approved in_progress in_review verified merged rejected blocked")
KIND = _list("feature bug refactor spike test chore")
TOKENS = "list_filter(string_split_regex(translate(lower({0}), '" + FOLD_FROM + "', '" + FOLD_TO + r"'), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"
TOKEN_SET = r"list_distinct(list_filter(string_split_regex(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\p{{L}}\p{{N}}_]+'), lambda t: strlen(t) >= 2))"
WORDS = r"list_filter(string_split_regex({0}, '\s+'), lambda t: t <> '')"

CTES = {
    "tool_events": f"""SELECT event_id AS id, concat('s', user_id) AS session_id, event_type AS tool, props AS query,
  concat('strategy=', event_type, ';lane=', {_list('cli mcp progressive_mcp')}[user_id % 3 + 1], ';outcome=', CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END) AS strategy,
  CAST(json_extract_string(props, '$.k') AS INT) AS result_count, CAST(floor(value * 10) AS BIGINT) AS latency_ms,
  CASE WHEN event_type <> 'error' THEN CAST(json_extract_string(props, '$.k') AS INT) / CAST(100 AS DOUBLE) END AS groundedness_score,
  CAST(floor(epoch(ts)) AS BIGINT) AS created_at, CASE WHEN event_id % 9 = 0 THEN '  ' ELSE concat('wt-', event_id % 4) END AS worktree_id FROM events""",
    "scoped_events": "SELECT * REPLACE (coalesce(nullif(trim(worktree_id), ''), 'project-root') AS worktree_id) FROM tool_events",
    "scoped_access": "SELECT * REPLACE (coalesce(nullif(trim(worktree_id), ''), 'project-root') AS worktree_id) FROM chunk_access",
    "lock_requests": "SELECT id, concat('i', result_count) AS intent_id, worktree_id, CASE WHEN id % 5 = 0 THEN 'release' ELSE 'acquire' END AS action, created_at AS ts FROM tool_events",
    "chunk_access": "SELECT id, concat('src/f', result_count, '.rs') AS file_path, session_id, worktree_id, created_at AS accessed_at FROM tool_events",
    "files": "SELECT doc_id, concat_ws('/', source, lang, concat('d', doc_id, '.txt')) AS file_path, lang AS language, text AS content, source FROM documents",
    "document_access": "SELECT file_path, session_id, created_at AS accessed_at FROM tool_events JOIN files ON result_count = doc_id",
    "result_sets": "SELECT l_orderkey AS set_id, l_partkey AS file_id FROM lineitem",
    "file_meta": "SELECT file_path, sha256(CASE WHEN language = 'fr' THEN content || '#' ELSE content END) AS content_hash FROM files WHERE source <> 'src3'",
    "current_files": "SELECT file_path, sha256(content) AS content_hash FROM files WHERE source <> 'src5'",
    "file_lines": "SELECT doc_id, file_path, language, source, CASE WHEN l[-1] = '' THEN l[1:-2] ELSE l END AS l FROM (SELECT *, string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10)) AS l FROM files)",
    "chunks": """SELECT *, concat_ws('_', language, start_line // 50) AS symbol_name, concat_ws(':', file_path, start_line, end_line, md5(content)) AS chunk_id FROM (
  SELECT doc_id, file_path, language, source, b * 50 AS start_line, least(b * 50 + 50, len(l)) - 1 AS end_line, array_to_string(l[b * 50 + 1 : b * 50 + 50], chr(10)) AS content, 'block' AS symbol_kind
  FROM (SELECT *, unnest(range(0, (len(l) - 1) // 50 + 1)) AS b FROM file_lines WHERE len(l) > 0))""",
    "search_queries": f"""SELECT item_id AS query_id, text, list_transform(list_sort(list_transform(list_distinct({TOKENS.format('text')}), lambda w: {{'n': -length(w), 'w': w}}))[1:3], lambda s: s.w) AS terms FROM benchmark""",
    "vectors": "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding, CAST(label AS VARCHAR) AS language FROM embeddings",
    "qa_pairs": "SELECT q.conv_id, q.turn, q.text AS question, a.text AS answer FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant' WHERE q.role = 'user'",
    "intents": f"""SELECT o_orderkey AS num, concat('i', o_orderkey) AS id, {KIND}[o_orderkey % 6 + 1] AS kind, concat('Intent ', o_orderkey) AS title, {STATUS}[o_custkey % 8 + 1] AS status,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' ELSE 'low' END AS priority,
  CASE WHEN o_custkey % 5 <> 0 THEN concat('a', o_custkey % 7) END AS assigned_to, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS updated_at FROM orders""",
    "intent_edges": """SELECT DISTINCT concat('i', i) AS from_id, concat('i', j) AS to_id, CASE WHEN i % 11 = 0 THEN 'related_to' ELSE 'depends_on' END AS kind FROM (
  SELECT o_orderkey AS i, o_orderkey // 2 AS j FROM orders WHERE o_orderkey >= 1 UNION SELECT o_orderkey, o_orderkey // 3 FROM orders WHERE o_orderkey >= 3) WHERE i <> j""",
    "dep_edges": "SELECT from_id, to_id, t.status AS to_status FROM intent_edges e JOIN intents t ON t.id = e.to_id WHERE e.kind = 'depends_on'",
    "looped_edges": """SELECT from_id, to_id, kind FROM intent_edges
  UNION ALL SELECT to_id, from_id, 'depends_on' FROM intent_edges WHERE CAST(substr(from_id, 2) AS INT) % 97 = 0""",
    "cyclic_edges": "SELECT o_orderkey AS from_id, (o_orderkey * o_orderkey + 1) % (SELECT count(*) FROM orders) AS to_id FROM orders",
    "transition_requests": f"SELECT id, status AS current, {STATUS}[num % 8 + 1] AS requested FROM intents",
    "eval_runs": """SELECT concat(golden_set, '-', strftime(day, '%Y%m%d')) AS id, golden_set, overall_score, overall_score >= 0.45 AS passed, CAST(floor(epoch(day)) AS BIGINT) AS created_at FROM (
  SELECT event_type AS golden_set, date_trunc('day', ts) AS day, round(CAST(sum(CAST(round(least(value, 100) * 100) AS BIGINT)) AS DOUBLE) / (count(*) * CAST(10000 AS DOUBLE)), 6) AS overall_score FROM events GROUP BY 1, 2)""",
    "manifests": "SELECT concat(p_name, '#', p_size) AS dep, p_brand AS version, p_partkey AS location FROM part",
    "freshness": "SELECT concat('ctx/c', o_custkey, '.md') AS file, max(CAST(floor(epoch(o_orderdate)) AS BIGINT)) AS last, count(*) AS commits FROM orders GROUP BY o_custkey",
    "activity": "SELECT id, created_at AS timestamp, concat('agent-', CAST(substr(session_id, 2) AS BIGINT) % 5) AS agent, concat('src/f', result_count, '.rs') AS path, tool AS kind FROM tool_events",
    "co_pairs": """SELECT a.file_id AS file_a, b.file_id AS file_b, count(*) AS n FROM first_files a JOIN first_files b ON a.set_id = b.set_id AND a.file_id < b.file_id GROUP BY 1, 2""",
    "first_files": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY file_id) AS r FROM (SELECT DISTINCT set_id, file_id FROM result_sets)) WHERE r <= 10",
    "strengths": "SELECT file_a, file_b, (1 - 0.95 ** n) / 0.05 AS strength FROM co_pairs",
    "neighbours": "SELECT file_a AS file, file_b AS other, strength FROM strengths UNION ALL SELECT file_b, file_a, strength FROM strengths",
    "related_top": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY round(strength, 9) DESC, other) AS place FROM neighbours) WHERE place <= 5",
    "chunk_fields": f"SELECT chunk_id, file_path, {TOKENS.format('file_path')} AS paths, {TOKENS.format('symbol_name')} AS names, {TOKENS.format('content')} AS body, {TOKENS.format('symbol_kind')} AS kinds FROM chunks",
    "chunk_tokens": "SELECT chunk_id, file_path, body, list_concat(paths, names, body, kinds) AS tokens FROM chunk_fields",
    "field_terms": "SELECT chunk_id, field, unnest(tokens) AS term FROM (SELECT chunk_id, 'file_path' AS field, paths AS tokens FROM chunk_fields UNION ALL SELECT chunk_id, 'symbol_name', names FROM chunk_fields UNION ALL SELECT chunk_id, 'content', body FROM chunk_fields UNION ALL SELECT chunk_id, 'symbol_kind', kinds FROM chunk_fields)",
    "query_terms": "SELECT query_id, unnest(list_distinct(terms)) AS term FROM search_queries",
    "term_hits": "SELECT chunk_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, len(tokens) AS dl, unnest(tokens) AS term FROM chunk_tokens) WHERE term IN (SELECT term FROM query_terms) GROUP BY 1, 2, 3",
    "bm25_all": "BM25(term_hits, query_terms)",
    "bm25_top": "TOP(bm25_all, query_terms)",
    "boosts": "SELECT file_path, ln(1 + count(*)) * exp(-((SELECT max(accessed_at) FROM document_access) - max(accessed_at)) / 86400.0 / 30.0) AS boost FROM document_access GROUP BY 1",
    "golden_rows": "SELECT * FROM (VALUES {golden}) g(n, case_id, priority, kind, literal, include, exclude)",
}


_BM25 = """SELECT query_id, chunk_id, -round(sum(greatest(1e-6, ln((n_all - df + 0.5) / (df + 0.5))) * (tf * 2.2) / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score, count(*) AS have
  FROM {hits} JOIN (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM {hits} GROUP BY term) USING (term) JOIN {terms} USING (term),
  (SELECT CAST(count(*) AS DOUBLE) AS n_all, avg(len(tokens)) AS avgdl FROM chunk_tokens) GROUP BY 1, 2"""
_TOP = """SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score, chunk_id) AS place FROM {ranked}
  JOIN (SELECT query_id, count(*) AS need FROM {terms} GROUP BY 1) USING (query_id) WHERE have = need) WHERE place <= 10"""
CTES["bm25_all"], CTES["bm25_top"] = _BM25.format(hits="term_hits", terms="query_terms"), _TOP.format(ranked="bm25_all", terms="query_terms")


def _stems(words: str) -> str:
    """Porter's algorithm over a table of words (term): step after step, as CASE expressions."""

    def is_(name: str, x: str) -> str:
        return f"regexp_matches({x}, '{PATTERNS[name]}')"

    def less(n: int, x: str = "w") -> str:
        return f"left({x}, length({x}) - {n})"

    def swap(table: dict[str, str]) -> str:
        tails = sorted(table, key=len, reverse=True)
        return "CASE " + " ".join(f"WHEN ends_with(w, '{t}') THEN CASE WHEN {is_('m0', less(len(t)))} THEN {less(len(t))} || '{table[t]}' ELSE w END" for t in tails) + " ELSE w END"

    twice = "|".join(c * 2 for c in "bcdfghjkmnpqrtvwxy")
    tails = sorted(STEP4, key=len, reverse=True)
    steps = [
        f"CASE WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN {less(2)} WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN {less(1)} ELSE w END",
        f"CASE WHEN ends_with(w, 'eed') THEN CASE WHEN {is_('m0', less(3))} THEN {less(1)} ELSE w END WHEN ends_with(w, 'ed') THEN CASE WHEN {is_('vowel', less(2))} THEN {less(2)} || '+' ELSE w END WHEN ends_with(w, 'ing') THEN CASE WHEN {is_('vowel', less(3))} THEN {less(3)} || '+' ELSE w END ELSE w END",
        f"CASE WHEN NOT ends_with(w, '+') THEN w WHEN regexp_matches(w, '(at|bl|iz)\\+$') OR {is_('cvc', less(1))} THEN {less(1)} || 'e' WHEN regexp_matches(w, '({twice})\\+$') THEN {less(2)} ELSE {less(1)} END",
        f"CASE WHEN ends_with(w, 'y') AND {is_('vowel', less(1))} THEN {less(1)} || 'i' ELSE w END",
        swap(STEP2), swap(STEP3),
        "CASE " + " ".join(f"WHEN ends_with(w, '{t}') THEN CASE WHEN {is_('more', less(len(t)))} THEN {less(len(t))} ELSE w END" for t in tails) + f" WHEN (ends_with(w, 'sion') OR ends_with(w, 'tion')) AND {is_('more', less(3))} THEN {less(3)} ELSE w END",
        f"CASE WHEN ends_with(w, 'e') AND ({is_('more', less(1))} OR ({is_('m1', less(1))} AND NOT {is_('cvc', less(1))})) THEN {less(1)} ELSE w END",
        f"CASE WHEN ends_with(w, 'll') AND {is_('more', 'w')} THEN {less(1)} ELSE w END",
    ]
    sql = f"SELECT term, term AS w FROM ({words}) WHERE length(term) >= 3 AND regexp_full_match(term, '[a-z]+')"
    for step in steps:
        sql = f"SELECT term, {step} AS w FROM ({sql})"
    return f"SELECT term AS token, w AS term FROM ({sql}) UNION ALL SELECT term, term FROM ({words}) WHERE length(term) < 3 OR NOT regexp_full_match(term, '[a-z]+')"


CTES["vocabulary"] = "SELECT DISTINCT unnest(tokens) AS term FROM chunk_tokens UNION SELECT term FROM query_terms"
CTES["stems"] = _stems("SELECT term FROM vocabulary")
CTES["query_stems"] = "SELECT q.query_id, s.term FROM query_terms q JOIN stems s ON s.token = q.term"
CTES["stem_hits"] = "SELECT chunk_id, dl, s.term, count(*) AS tf FROM (SELECT chunk_id, len(tokens) AS dl, unnest(tokens) AS token FROM chunk_tokens) t JOIN stems s USING (token) WHERE s.term IN (SELECT term FROM query_stems) GROUP BY 1, 2, 3"
CTES["stemmed_all"], CTES["stemmed_top"] = _BM25.format(hits="stem_hits", terms="query_stems"), _TOP.format(ranked="stemmed_all", terms="query_stems")


def _choice(key: str, values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][{key} + 1]"


CTES["source_paths"] = f"SELECT p_partkey AS k, concat('src/f', p_partkey, '.', {_choice('p_partkey % 16', ('rs', 'py', 'pyi', 'ts', 'tsx', 'js', 'jsx', 'toml', 'json', 'yaml', 'yml', 'md', 'markdown', 'bin', 'tar.gz', 'py/file'))}) AS file_path FROM part"
CTES["script_docs"] = """SELECT concat('docs/p', p_partkey, '.md') AS file, concat('use npm run ', replace(p_name, ' ', '-'), ', pnpm ', lower(p_type), ' or yarn --frozen; then pnpm run (', p_size, ') and npm run "', p_brand, '".', CASE WHEN p_partkey % 5 = 0 THEN ' npm run' ELSE '' END) AS body FROM part"""
CTES["doc_refs"] = """SELECT DISTINCT file, script FROM (SELECT file, regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(n, ''), '^[`"''()]+', ''), '[`"''()]+$', ''), '^[,.;:]+', ''), '[,.;:]+$', '') AS script
  FROM (SELECT file, CASE WHEN w[i] IN ('npm', 'pnpm') AND w[i + 1] = 'run' THEN w[i + 2] WHEN w[i] IN ('pnpm', 'yarn') THEN w[i + 1] END AS n FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM (SELECT file, string_split(body, ' ') AS w FROM script_docs)))) WHERE script <> '' AND NOT starts_with(script, '-')"""
CTES["declared_scripts"] = "SELECT DISTINCT replace(p_name, ' ', '-') AS script FROM part WHERE p_partkey % 2 = 0"
CTES["convention_rows"] = f"""SELECT concat('conv/s', s_suppkey, '.toml') AS file, concat('src', s_suppkey % 13, '/', {_choice('s_suppkey % 5', ('en', 'de', 'fr', 'es', 'xx'))}) AS folder, {_choice('s_suppkey % 2', ('.txt', '.md'))} AS ext,
  {_choice('s_suppkey % 4', ('rust', 'cobol', 'python', 'go'))} AS language, {_choice('s_suppkey % 3', ('$X.unwrap()', '', 'print($X)'))} AS pattern, concat('skill-', s_suppkey % 7) AS skill, {_choice('s_suppkey % 4', ('error', 'warning', 'info', 'none'))} AS severity FROM supplier"""
CTES["skill_files"] = f"SELECT concat('skill-', n_nationkey, {_choice('n_nationkey % 3', ('.md', '.yaml', '.exe'))}) AS file FROM nation WHERE n_nationkey < 5"
CTES["index_targets"] = "SELECT DISTINCT file FROM (SELECT concat('p', p_partkey, '.md') AS file FROM part UNION ALL SELECT concat('q', p_partkey % 7, '.md') FROM part)"
CTES["pattern_files"] = "SELECT concat(CASE WHEN p_partkey % 5 = 0 THEN 'r' ELSE 'p' END, p_partkey, '.md') AS file FROM part"
CTES["watched_paths"] = f"SELECT p_partkey AS k, concat({_choice('p_partkey % 4', ('/work/', '', '/other/', '/work/'))}, {_choice('p_partkey % 6', ('.git/', 'src/', 'target/', 'node_modules/', 'docs/target/', '.activity/'))}, 'f', p_partkey, {_choice('p_partkey % 5', ('.rs', '.swp', '.tmp', '.py', chr(92) + 'b.rs'))}) AS path FROM part"
CTES["code_files"] = "SELECT p_partkey AS k, concat('src/p', p_partkey, '.py') AS file_path FROM part"
CTES["manifest_rows"] = "SELECT p_name AS dep, p_brand AS version FROM part WHERE p_partkey % 50 <> 0 UNION ALL SELECT p_type, concat('^', p_size) FROM part WHERE p_partkey % 50 <> 0"
CTES["edge_requests"] = "SELECT concat('i', i) AS from_id, concat('i', CASE i % 3 WHEN 0 THEN i WHEN 1 THEN i // 2 ELSE i + 1 END) AS to_id, 'depends_on' AS kind FROM (SELECT o_orderkey AS i FROM orders WHERE o_orderkey % 10 = 0 AND o_orderkey > 0)"


def _golden() -> str:
    from trailhead.plans.fixtures import GOLDEN_CHECKS

    return ", ".join("(" + ", ".join([str(n), *("'" + x.replace("'", "''") + "'" for x in row)]) + ")" for n, row in enumerate(GOLDEN_CHECKS))


CTES["golden_rows"] = CTES["golden_rows"].format(golden=_golden())
_PATH_OK = """CASE WHEN g.exclude = '' THEN true WHEN contains(g.exclude, '**') THEN NOT (starts_with(c.file_path, rtrim(split_part(g.exclude, '**', 1), '/')) AND ends_with(c.file_path, ltrim(ltrim(substr(g.exclude, instr(g.exclude, '**') + 2), '/'), '*')))
  WHEN contains(g.exclude, '*') THEN NOT ends_with(c.file_path, ltrim(g.exclude, '*')) ELSE c.file_path <> g.exclude END"""


def golden(chunks: str) -> str:
    return f"""SELECT case_id, kind, literal, file_path, start_line FROM (SELECT g.*, c.file_path, c.start_line, row_number() OVER (PARTITION BY n ORDER BY c.file_path, c.start_line) AS r
  FROM golden_rows g JOIN {chunks} c ON instr(c.content, g.literal) > 0 AND (g.include = '' OR c.file_path GLOB g.include) AND {_PATH_OK}) WHERE r <= CASE WHEN kind = 'must' THEN 1 ELSE 5 END"""


CTES["golden_hits"] = golden("chunks")
CTES["golden_bad"] = """SELECT * FROM golden_hits WHERE kind = 'must_not' UNION ALL SELECT case_id, kind, literal, 'N/A', 0 FROM golden_rows g WHERE kind = 'must' AND NOT EXISTS (SELECT 1 FROM golden_hits h WHERE h.case_id = g.case_id AND h.literal = g.literal AND h.kind = 'must')"""
CTES["golden_cases"] = """SELECT case_id, priority, checks, coalesce(violations, 0) AS violations, coalesce(files, 0) AS files, round(greatest(0.0, 1 - CAST(coalesce(violations, 0) AS DOUBLE) / checks), 6) AS score, coalesce(violations, 0) = 0 AS passed,
  CASE priority WHEN 'critical' THEN 2.0 WHEN 'high' THEN 1.5 WHEN 'low' THEN 0.5 ELSE 1.0 END AS weight
  FROM (SELECT case_id, priority, count(*) AS checks FROM golden_rows GROUP BY 1, 2) LEFT JOIN (SELECT case_id, count(*) AS violations, count(DISTINCT CASE WHEN file_path <> 'N/A' THEN file_path END) AS files FROM golden_bad GROUP BY 1) USING (case_id)"""
CTES["runs_w"] = "SELECT *, avg(overall_score) OVER (PARTITION BY golden_set ORDER BY created_at, id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS m, row_number() OVER (PARTITION BY golden_set ORDER BY created_at DESC, id DESC) AS latest FROM eval_runs"
CTES["runs_state"] = "SELECT *, CASE WHEN round(overall_score - m, 6) < -0.1 THEN 'regression' WHEN round(overall_score - m, 6) < -0.05 THEN 'warning' ELSE 'ok' END AS state FROM runs_w"
CTES["gate_row"] = "SELECT CASE WHEN count(*) = 0 THEN 'no_eval_history' WHEN bool_and(passed) THEN 'pass' ELSE 'failed_eval' END AS gate FROM (SELECT passed FROM eval_runs ORDER BY created_at DESC, id DESC LIMIT 1)"
CTES["issues"] = """SELECT 'staleness' AS checker, file, concat('not touched for ', CAST((now - last) // 86400 AS BIGINT), ' days') AS message, 'warning' AS severity FROM freshness, fresh_now WHERE (now - last) // 86400 > 30
  UNION ALL SELECT 'commits', file, concat(commits, ' commits since'), 'info' FROM freshness WHERE commits > 10"""
CTES["fresh_now"] = "SELECT max(last) AS now FROM freshness"
CTES["mixed_code"] = "SELECT p_partkey AS k, concat('src/m', p_partkey) AS file_path, CASE WHEN p_partkey % 6 = 5 THEN 'big' ELSE ['rust', 'typescript', 'python'][p_partkey % 3 + 1] END AS form FROM part"
