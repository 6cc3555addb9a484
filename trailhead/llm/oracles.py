"""DuckDB SQL that gives the rows of this subpackage's queries by plain, quadratic or recursive means."""

_GOOD = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"

OP1 = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE {_GOOD} AND label IS NOT NULL),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
comp AS (SELECT u, least(u, min(v)) AS c FROM reach GROUP BY u),
n AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, vec_id = coalesce(c, vec_id) AS kept
FROM embeddings LEFT JOIN comp ON comp.u = vec_id LEFT JOIN n ON n.u = vec_id
"""

OP3 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM f
"""

OP6 = r"""
WITH d AS (SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
k AS (SELECT doc_id, source, size, CAST(doc_id AS VARCHAR) AS k,
  -ln((CAST(CAST(concat('0x', substr(md5(CAST(doc_id AS VARCHAR)), 1, 13)) AS UBIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0)
    / greatest(1.0, least(2.0, coalesce(CAST(strlen(text) AS DOUBLE) / nullif(size, 0) / 6.0, 1.0))) AS e FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY source),
w AS (SELECT *, CAST(list_value(1, 2, 3)[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w, source_size * CAST(3.0 AS DOUBLE) AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0.0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0.0)) AS level FROM w
  WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, least(cap, max(level) OVER () * w) AS target FROM l),
g AS (SELECT source, source_size, target, CAST(coalesce(floor(target / nullif(source_size, 0)), 0) AS BIGINT) AS epochs FROM t),
r AS (SELECT k.*, source_size, target, epochs, target - epochs * source_size AS rest,
  coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY e, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(size * (epochs + CASE WHEN rest > 0 AND before + size / 2.0 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""

OP7 = r"""
WITH RECURSIVE rules(verdict, rule) AS (VALUES ('allow', 'org/'), ('block', 'example.org/es/'), ('block', 'example.org/en/1'), ('allow', 'com/fr/'), ('block', 'com/de/')),
p AS (SELECT page_id, html, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
fit AS (SELECT page_id, max_by(rule, strlen(rule)) AS rule, max_by(verdict, strlen(rule)) AS verdict FROM p JOIN rules
  ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, instr(rule, '/'))) GROUP BY page_id),
q AS (SELECT p.page_id, p.host, p.path, f.rule, f.verdict FROM p LEFT JOIN fit f USING (page_id)),
votes AS (SELECT host, sum(CAST(coalesce(verdict = 'allow', false) AS INT)) AS allow, sum(CAST(coalesce(verdict = 'block', false) AS INT)) AS block FROM q WHERE host <> '' GROUP BY host),
raw AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, '(?i)\b(?:href|src)\s*=\s*["'']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"''\s<>]+)', 1)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM p),
links AS (SELECT src, dst, count(*) AS n FROM raw WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY src, dst),
share AS (SELECT src, dst, 0.85 * n / sum(n) OVER (PARTITION BY src) AS share FROM links),
back AS (SELECT dst AS src, src AS dst, 0.85 * n / sum(n) OVER (PARTITION BY dst) AS share FROM links),
t0 AS (SELECT host, 0.15 * allow / sum(allow) OVER () AS rank FROM votes WHERE allow > 0),
b0 AS (SELECT host, 0.15 * block / sum(block) OVER () AS rank FROM votes WHERE block > 0),
t AS (SELECT 0 AS i, host, rank FROM t0 UNION ALL SELECT i + 1, host, sum(rank) FROM
  (SELECT i, dst AS host, rank * share AS rank FROM t JOIN share ON src = host UNION ALL SELECT m.i, t0.host, t0.rank FROM t0, (SELECT DISTINCT i FROM t) m) WHERE i < 20 GROUP BY i, host),
b AS (SELECT 0 AS i, host, rank FROM b0 UNION ALL SELECT i + 1, host, sum(rank) FROM
  (SELECT i, dst AS host, rank * share AS rank FROM b JOIN back ON src = host UNION ALL SELECT m.i, b0.host, b0.rank FROM b0, (SELECT DISTINCT i FROM b) m) WHERE i < 20 GROUP BY i, host)
SELECT q.page_id, q.host, q.path, q.rule, coalesce(q.verdict, CASE WHEN round(coalesce(b.rank, 0), 12) > round(coalesce(t.rank, 0), 12) THEN 'block' ELSE 'allow' END) AS verdict
FROM q LEFT JOIN t ON t.host = q.host AND t.i = 20 LEFT JOIN b ON b.host = q.host AND b.i = 20
"""

OP10 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT u, v FROM common JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c >= 85 * (a.n + b.n - c)),
reach AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
comp AS (SELECT u, least(u, min(v)) AS c FROM reach GROUP BY u)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN comp ON u = d.doc_id
"""


def _crc32(value: str) -> str:
    """The unsigned CRC-32 of a column's decimal text."""
    bits = "lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384 * (c & 1)) END"
    codes = f"list_transform(string_split(CAST({value} AS VARCHAR), ''), lambda x: list_concat([CAST(ascii(x) AS BIGINT)], list_transform(range(8), lambda y: CAST(-1 AS BIGINT))))"
    return f"xor(list_reduce(flatten({codes}), {bits}, CAST(4294967295 AS BIGINT)), 4294967295)"


_FRAMED = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR) END"
_LEAF = "sha256(" + " || ".join(_FRAMED.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || " + _FRAMED + ")"

OP12 = f"""
WITH RECURSIVE d AS (SELECT *, {_LEAF.format('text')} AS leaf, CASE WHEN {_crc32('doc_id')} % 2 = 0 THEN {_LEAF.format("replace(text, chr(10), '')")} END AS other FROM documents),
k AS (SELECT doc_id, leaf, coalesce(other, leaf) AS seen, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g,
  row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d),
nodes AS (SELECT 0 AS l, g, pos, leaf AS h, n FROM k
  UNION ALL SELECT l + 1, g, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 2) // 3 FROM nodes WHERE n > 1 GROUP BY l, g, pos // 3),
sub AS (SELECT g, l AS height, h AS subroot FROM nodes WHERE n = 1),
top AS (SELECT 0 AS l, g AS pos, subroot AS h, count(*) OVER () AS n FROM sub
  UNION ALL SELECT l + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 2) // 3 FROM top WHERE n > 1 GROUP BY l, pos // 3),
steps AS (SELECT l, g, pos, coalesce(string_agg(h, '' ORDER BY pos) OVER b, '') AS lo, coalesce(string_agg(h, '' ORDER BY pos) OVER a, '') AS hi FROM nodes WHERE n > 1
  WINDOW b AS (PARTITION BY l, g, pos // 3 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY l, g, pos // 3 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
tops AS (SELECT l, pos, coalesce(string_agg(h, '' ORDER BY pos) OVER b, '') AS lo, coalesce(string_agg(h, '' ORDER BY pos) OVER a, '') AS hi FROM top WHERE n > 1
  WINDOW b AS (PARTITION BY l, pos // 3 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY l, pos // 3 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
way AS (SELECT k.g, k.pos AS i, s.l, lo, hi FROM k JOIN steps s ON s.g = k.g AND s.pos = k.pos // CAST(pow(3, s.l) AS BIGINT)
  UNION ALL SELECT k.g, k.pos, height + s.l, lo, hi FROM k JOIN sub USING (g) JOIN tops s ON s.pos = k.g // CAST(pow(3, s.l) AS BIGINT)),
proof AS (SELECT g, i, string_agg(lo || hi, '' ORDER BY l) AS p FROM way GROUP BY g, i),
up AS (SELECT g, pos AS i, 0 AS l, seen AS h FROM k UNION ALL SELECT up.g, up.i, up.l + 1, sha256(lo || h || hi) FROM up JOIN way ON way.g = up.g AND way.i = up.i AND way.l = up.l),
folded AS (SELECT g, i, max_by(h, l) AS h FROM up GROUP BY g, i)
SELECT doc_id, leaf, subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(coalesce(p, '')) AS proof_sha256, folded.h AS folded_root,
  folded.h = (SELECT h FROM top WHERE n = 1) AS verified
FROM k JOIN sub USING (g) LEFT JOIN proof ON proof.g = k.g AND proof.i = k.pos JOIN folded ON folded.g = k.g AND folded.i = k.pos
"""

OP13 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {_crc32('doc_id')} AS h FROM documents),
e AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a, 3 + (h // 10) % 8 AS m FROM d),
f AS (SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // m) END]) END AS w FROM e),
t AS (SELECT r, n, unnest(range(n)) AS i, unnest(w) AS w FROM f),
same AS (SELECT x.r, x.i, y.i - x.i AS q FROM t x JOIN t y ON x.r = y.r AND x.w = y.w AND y.i > x.i AND y.i - x.i <= x.n // 4),
part AS (SELECT r, q, min(i) AS s, count(*) + q AS l FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM same) GROUP BY r, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT * FROM part p WHERE NOT EXISTS (SELECT 1 FROM part o WHERE o.r = p.r AND o.q < p.q AND p.q % o.q = 0 AND o.s <= p.s AND o.s + o.l >= p.s + p.l)),
kept AS (SELECT r, string_agg(w, ' ' ORDER BY i) AS text FROM t WHERE NOT EXISTS (SELECT 1 FROM runs u WHERE u.r = t.r AND t.i >= u.s + u.q AND t.i < u.s + u.l) GROUP BY r),
found AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines, first(struct_pack(s, l, q) ORDER BY l DESC, s, q) AS best FROM runs GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.q AS period, 1000 * best.l // best.q AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256 FROM f LEFT JOIN found USING (r) LEFT JOIN kept USING (r)
"""

SQL = {"op1_near_vectors": OP1, "op3_warc": OP3, "op6_mix": OP6, "op7_hosts": OP7, "op10_jaccard": OP10, "op12_manifest": OP12, "op13_runs": OP13}
