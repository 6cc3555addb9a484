"""Operators on literal inputs with known values."""

import math
import random

import pytest
from pyspark.sql import functions as F

from trailhead.functions import text as X
from trailhead.functions.porter import stem
from trailhead.operators import budget, chunking, drift, evals, fts, graph, memory, telemetry, vectors


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


EVENTS = "id long, session_id string, tool string, result_count int, latency_ms long, groundedness_score double, created_at long, worktree_id string"


def test_session_telemetry(spark):
    e = spark.createDataFrame([(1, "a", "search_code", 10, 50, 0.9, 5, "w"), (2, "a", "search_semantic", 15, 100, 0.85, 7, "w"), (3, "a", "search_code", 20, 75, 0.92, 9, " w ")], EVENTS)
    r = telemetry.session_summary(e).first()
    assert (r["events"], r["tools"], r["avg_results"], r["avg_latency"], r["duration"]) == (3, 2, 15.0, 75.0, 4) and abs(r["avg_groundedness"] - 0.89) < 0.01
    c = spark.createDataFrame([(1, "s", "search_code", 1, 30, 0.8, 1, "w"), (2, "s", "search_code", 1, 70, 0.9, 2, "w"), (3, "s", "semantic_search", 1, 50, 0.7, 3, "w")], EVENTS)
    assert telemetry.session_totals(c, "s").first()[:2] == (3, 150)
    assert [(r["tool"], r["calls"], r["latency_ms"]) for r in telemetry.tool_breakdown(c).orderBy("place").collect()] == [("search_code", 2, 100), ("semantic_search", 1, 50)]
    assert tuple(telemetry.session_totals(c, "none").first()) == (0, 0, None)


@pytest.mark.parametrize("scores, gate, state, outcome, delta", [([], True, "neutral", "no_history", 0.0), ([0.95] * 20, True, "improving", "promoted", 0.025), ([0.1] * 12, False, "regressing", "rolled_back", 0.025), ([0.9] * 12, False, "neutral", "no_change", 0.025)])
def test_weight_learning(spark, scores, gate, state, outcome, delta):
    e = spark.createDataFrame([(i, "s", "t", 1, 1, s, i, None) for i, s in enumerate(scores)], EVENTS)
    r = telemetry.learn_weights(telemetry.groundedness_window(e), gate).first()
    assert (r["learning_state"], r["last_learning_outcome"], r["candidate_delta"]) == (state, outcome, delta)
    assert math.isclose(sum(r[k] for k in telemetry.WEIGHTS), 1) and (r["semantic"] == 0.45) == (outcome == "promoted")


def test_co_access(spark):
    sets = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "a"), (3, "b"), (3, "c"), (3, "c")], "set_id long, file_id string")
    pairs = memory.co_access_pairs(sets)
    s = memory.strengths(pairs).withColumn("strength", F.round("strength", 6))
    assert {(r["file_a"], r["file_b"]): r["strength"] for r in s.collect()} == {("a", "b"): 2.8525, ("a", "c"): 1.0, ("b", "c"): 1.0}
    assert [r["other"] for r in memory.related(s).where("file = 'a'").orderBy("place").collect()] == ["b", "c"]
    uses = spark.createDataFrame([("s", "a"), ("s", "a"), ("s", "b")], "session_id string, file string")
    assert [r["other"] for r in memory.suggestions(uses, s).collect()] == ["c"]
    wide = spark.createDataFrame([(1, f"f{i:02}") for i in range(30)], "set_id long, file_id string")
    assert memory.co_access_pairs(wide).count() == 45


INTENTS = "id string, status string, updated_at long"
EDGES = "from_id string, to_id string, kind string"


def test_graph(spark):
    e = spark.createDataFrame([("i2", "i1", "depends_on"), ("i3", "i2", "depends_on"), ("i3", "i1", "related_to")], EDGES)
    for status, want in (("approved", {"i1"}), ("verified", {"i2"})):
        i = spark.createDataFrame([("i1", status, 0), ("i2", "approved", 0), ("i3", "draft", 0)], INTENTS)
        assert {r["id"] for r in graph.ready(i, e).collect()} == want
    c = {r["id"]: r for r in graph.context(i, e).collect()}
    assert c["i2"]["satisfied"] and c["i2"]["first_dep"] == "i1" and c["i1"]["dependents"] == 1 and not c["i3"]["satisfied"]
    assert {tuple(r) for r in graph.transitive(e, i.select("id")).collect()} == {("i2", "i1"), ("i3", "i2"), ("i3", "i1")}
    ring = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (3, 5), (6, 7), (7, 6), (8, 8), (9, 10)], "from_id long, to_id long")
    assert {r[0] for r in graph.cycle_nodes(ring).collect()} == {1, 2, 3, 6, 7, 8}
    assert graph.cycle_nodes(ring.limit(0)).collect() == []
    bad = spark.createDataFrame([("i1", "rejected", 0), ("i2", "approved", 0), ("i3", "draft", 0)], INTENTS)
    assert [r["id"] for r in graph.auto_block(bad, e).collect()] == ["i2"]


def test_gate_and_transitions(spark):
    kind = "id string, golden_set string, overall_score double, passed boolean, created_at long"
    for runs, want in (([], "no_eval_history"), ([("a", "g", 1.0, True, 10)], "pass"), ([("a", "g", 1.0, True, 10), ("b", "h", 0.1, False, 11)], "failed_eval")):
        assert graph.eval_gate(spark.createDataFrame(runs, kind)).first()[0] == want
    r = spark.createDataFrame([("1", "draft", "approved"), ("2", "draft", "merged"), ("3", "in_review", "verified"), ("4", "approved", "in_progress"), ("5", "in_progress", "in_review"), ("6", "merged", "blocked")], "id string, current string, requested string")
    got = {x["id"]: (x["outcome"], x["lock"]) for x in graph.transition_outcomes(r, graph.one_row(spark, gate="failed_eval")).collect()}
    assert got == {"1": ("accepted", "none"), "2": ("invalid_transition", "none"), "3": ("failed_eval", "none"), "4": ("accepted", "acquire"), "5": ("accepted", "release"), "6": ("accepted", "none")}


def test_locks_and_stale(spark):
    asked = [("i", "wt-a", "acquire", 0), ("i", "wt-b", "acquire", 10), ("i", "wt-a", "acquire", 20), ("i", "wt-b", "acquire", 3621), ("j", "wt-b", "acquire", 30), ("k", "wt-a", "release", 0), ("k", "wt-a", "acquire", 1), ("k", "wt-b", "release", 2), ("k", "wt-a", "release", 3), ("k", "wt-b", "acquire", 4), ("k", " ", "acquire", 3604)]
    q = spark.createDataFrame([(n, *r) for n, r in enumerate(asked, 1)], "id long, intent_id string, worktree_id string, action string, ts long")
    want = [("acquired", "wt-a"), ("conflict", "wt-a"), ("acquired", "wt-a"), ("acquired", "wt-b"), ("acquired", "wt-b"), ("not_held", None), ("acquired", "wt-a"), ("not_held", "wt-a"), ("released", None), ("acquired", "wt-b"), ("acquired", "project-root")]
    assert {r["id"]: (r["outcome"], r["held_by"]) for r in graph.lock_outcomes(q).collect()} == dict(enumerate(want, 1))
    i = spark.createDataFrame([("a", "in_progress", 0), ("b", "in_progress", 200_000), ("c", "draft", 0)], INTENTS)
    now = graph.one_row(spark, now=200_001)
    assert [r["id"] for r in graph.stale(i, now).collect()] == ["a"]
    assert {r["id"]: r["new_status"] for r in graph.recover_stale(i, now).collect()} == {"a": "approved", "b": "in_progress", "c": "draft"}


def test_prefixes(spark):
    ids = spark.createDataFrame([("ab1",), ("ab2",), ("ab",), ("c9",)], "id string")
    got = {r["prefix"]: (r["outcome"], r["id"]) for r in graph.resolve_prefix(ids, spark.createDataFrame([("ab",), ("ab1",), ("a",), ("c",), ("z%",)], "prefix string")).collect()}
    assert got == {"ab": ("found", "ab"), "ab1": ("found", "ab1"), "a": ("ambiguous", None), "c": ("found", "c9"), "z%": ("missing", None)}


def test_groundedness_and_tokens(spark):
    ground = lambda q, d: one(spark, X.groundedness(X.token_set(F.col("q")), X.token_set(F.col("d"))), q=q, d=d)
    assert ground("authentication token refresh flow", "authentication uses a token; refresh it") == 0.75
    assert ground("opaque query", "zzzz yyyy") == 0 and ground("", "x") == 0
    assert ground("validate token refresh", "fn validate_token(token: &str) { refresh_token(token); }") == pytest.approx(1 / 3)
    assert one(spark, X.token_set(F.col("t")), t="É a_b A_B x é ÉÉ") == ["É", "a_b", "é", "ÉÉ"]
    assert [one(spark, X.estimate_tokens(F.col("t")), t=t) for t in ("", "abcd", "abcde")] == [1, 1, 2]


@pytest.mark.parametrize("q, want", [("src::router::route_query", "deterministic"), ("how does adaptive retrieval routing work", "semantic"), ("how does src::router::route_query work", "hybrid"), ("   ", "hybrid"), ("fooBar", "deterministic"), ("plain", "hybrid"), ("a sentence. It ends", "deterministic")])
def test_routing(spark, q, want):
    assert one(spark, X.route_query(F.col("q")), q=q) == want


def test_lanes(spark):
    lane = lambda n, remote, local: one(spark, X.select_lane(F.lit(n), F.lit(remote), F.lit(local), pressure=512), q=1)
    assert [lane(64, False, True), lane(128, True, False), lane(1024, False, True), lane(1, False, False)] == ["cli", "mcp", "progressive-mcp", "mcp"]


def test_globs_and_scripts(spark):
    p = F.col("p")
    assert one(spark, X.path_glob(p, "src/**/*.rs"), p="src/main.rs") and not one(spark, X.sql_glob(p, "src/**/*.rs"), p="src/main.rs")
    assert one(spark, X.sql_glob(p, "src/*.rs"), p="src/a/b.rs") and not one(spark, X.path_glob(p, "*.rs"), p="a.py")
    assert one(spark, X.script_refs(p), p="run npm run build and yarn test then pnpm run lint") == ["build", "lint", "test"]
    assert one(spark, X.placeholders(p), p="{{ a }} {{b}} {{ a }} { c }") == ["a", "b"]
    assert one(spark, X.tail_lines(p, 2), p="a\r\nb\nc\n") == ["b", "c"]
    assert one(spark, X.scope(p), p="  ") == "project-root"
    assert one(spark, X.detect_language(p), p="x/y.tsx") == "typescript"


@pytest.mark.parametrize("word, want", [("caresses", "caress"), ("ponies", "poni"), ("hopping", "hop"), ("relational", "relat"), ("conflated", "conflat"), ("happy", "happi"), ("generalizations", "gener"), ("sky", "sky"), ("agreed", "agre"), ("controlling", "control"), ("élan", "élan"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate")])
def test_stems(word, want):
    assert stem(word) == want


def chunks(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, file_path string, content string")


def test_search(spark):
    c = chunks(spark, [("1", "src/auth.rs", "fn validate_token(token: &str) { refresh_token(token); }"), ("2", "src/cache.rs", "fn warm_cache() { preload(); }"), ("3", "src/x.rs", "tokens were refreshed after refreshing")])
    q = spark.createDataFrame([(1, ["validate", "token", "refresh"]), (2, ["preload"]), (3, ["absent", "fn"])], "query_id long, terms array<string>")
    got = fts.bm25(c, q).collect()
    assert {(r["query_id"], r["chunk_id"]) for r in got} == {(1, "1"), (2, "2")} and all(r["score"] < 0 for r in got if r["query_id"] == 2)
    s = fts.bm25(c, spark.createDataFrame([(1, ["refreshes", "tokens"])], "query_id long, terms array<string>"), stem=True).collect()
    assert {r["chunk_id"] for r in s} == {"1", "3"}
    find = lambda query: {r["chunk_id"] for r in fts.search(c, query).collect()}
    assert find("token refresh") == {"1"} and find("preload OR token") == {"1", "2"} and find("pre*") == {"2"} and find('"warm cache"') == {"2"}
    assert find("file_path:src NOT (token OR preload)") == {"3"} and find("content:auth") == set() and find("validate_token") == {"1"}
    with pytest.raises(ValueError):
        fts.Parser("(a OR").parse()
    assert one(spark, fts.snippet(F.col("t"), F.array(F.lit("here"))), t="a b c d e f here, g") == "...c d e f >>>here,<<< g"


def test_tf_raises_rank(spark):
    c = chunks(spark, [(str(i), "p", "other words only here " * 3) for i in range(9)] + [("x", "p", "key a b c"), ("y", "p", "key key b c")])
    got = fts.bm25(c, spark.createDataFrame([(1, ["key"])], "query_id long, terms array<string>")).orderBy("place").collect()
    assert [r["chunk_id"] for r in got] == ["y", "x"]


def test_embeddings(spark):
    t = spark.createDataFrame([(1, "bearer token auth"), (2, "bearer token auth"), (3, ""), (4, "zebra")], "k long, t string")
    v = {r["k"]: r["vector"] for r in vectors.embed(t, "k", "t", 32).collect()}
    assert v[1] == v[2] and v[3] == [1.0] + [0.0] * 31 and all(abs(sum(x * x for x in y) - 1) < 1e-5 for y in v.values())


def test_knn(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.0, 1.0], "b"), (3, [2.0, 0.1], "b"), (4, [0.0, 0.0], "a")], "vec_id long, embedding array<double>, lang string")
    got = vectors.knn(v, v.where("vec_id = 1"), k=3).orderBy("place").collect()
    assert [r["vec_id"] for r in got] == [1, 3, 2] and got[0]["score"] == 1.0
    assert [r["vec_id"] for r in vectors.knn(v, v.where("vec_id = 1"), k=2, metric="l2").orderBy("place").collect()] == [1, 4]
    assert [r["vec_id"] for r in vectors.knn(v, v.where("vec_id = 1"), k=5, same="lang").orderBy("place").collect()] == [1, 4]


def test_cache(spark):
    entry = spark.range(1).select(F.lit("q").alias("query_fingerprint"), F.lit("e").alias("embedding_hash"), F.lit("*").alias("language_scope"), F.lit(5).alias("top_k"), F.lit("[1]").alias("result_json"), F.sha2(F.lit("[1]").cast("binary"), 256).alias("payload_hash"), F.lit(100).alias("expires_at"))
    r = spark.createDataFrame([("q", "e", "*", 5, 50), ("q", "e", "*", 5, 100), ("q", "e", "rust", 5, 50), ("q", "e", "*", 9, 50)], "query_fingerprint string, embedding_hash string, language_scope string, top_k int, now int")
    assert sorted(x["state"] for x in vectors.cache_lookup(entry, r).collect()) == ["expired", "hit", "miss", "miss"]


def test_line_chunks(spark):
    f = spark.createDataFrame([("a", "\n".join(map(str, range(120))) + "\n"), ("b", ""), ("c", "x")], "file_path string, content string")
    got = [(r["file_path"], r["start_line"], r["end_line"]) for r in chunking.line_chunks(f, "content").orderBy("file_path", "start_line").collect()]
    assert got == [("a", 0, 49), ("a", 50, 99), ("a", 100, 119), ("b", 0, 0), ("c", 0, 0)][:3] + [x for x in got[3:]]
    assert ("c", 0, 0) in got


def test_symbols_and_patterns():
    py = chunking.symbol_chunks_of("import os\n\n@d\ndef f():\n    pass\n\nclass C:\n    x = 1\n", "python")
    assert [(c[2], c[3], c[0], c[1]) for c in py] == [("_preamble", "preamble", 0, 0), (None, "decorated_definition", 2, 4), ("C", "class_definition", 6, 7)]
    rs = chunking.symbol_chunks_of("use a;\nfn f() {\n  g();\n}\nstruct S { x: u8 }\nimpl S {\n fn m(&self) {}\n}\n", "rust")
    assert [(c[2], c[3]) for c in rs] == [("_preamble", "preamble"), ("f", "function_item"), ("S", "struct_item"), (None, "impl_item")]
    assert len(chunking.symbol_chunks_of("\n".join("x" * 3 for _ in range(120)), None)) == 3
    assert chunking.symbol_chunks_of("def broken(:\n", "python")[0][3] == "block"
    big = "class A:\n    def one(self):\n        " + "x = 1\n        " * 400 + "\n    def two(self):\n        pass\n"
    assert [(c[2], c[4]) for c in chunking.symbol_chunks_of(big, "python")] == [("one", "A/one"), ("two", "A/two")]
    count = lambda s, p: len(chunking.find_pattern(s, p))
    assert count("a.unwrap(); b.expect(1);", "$X.unwrap()") == 1 and count("x = 42\ny = 42", "x = 42") == 1 and count("f(g(1), [2]); f()", "f($$$)") == 2 and count("f(a(b)", "f($$$)") == 0


def test_golden_scores(spark):
    rows = [("c1", "critical", "must", "alpha", "", ""), ("c1", "critical", "must", "beta", "", ""), ("c1", "critical", "must_not", "bad", "src/*", "**/gen.rs"), ("c1", "critical", "must_not", "worse", "", ""), ("c2", "medium", "must", "alpha", "", "")]
    checks = spark.createDataFrame(rows, "case_id string, priority string, kind string, literal string, include string, exclude string")
    c = spark.createDataFrame([("src/a.rs", 0, "alpha beta"), ("src/gen.rs", 0, "bad"), ("doc/x", 0, "bad worse")], "file_path string, start_line int, content string")
    v = evals.case_violations(checks, c, rows)
    assert [tuple(r) for r in v.collect()] == [("c1", "must_not", "worse", "doc/x", 0)]
    s = evals.case_scores(checks, v)
    assert {r["case_id"]: r["score"] for r in s.collect()} == {"c1": 0.75, "c2": 1.0}
    r = evals.golden_score(s).first()
    assert (round(r["overall_score"], 4), r["critical_pass"]) == (0.8333, False)
    assert tuple(evals.golden_score(s.limit(0)).first()) == (1.0, True)
    runs = spark.createDataFrame([(str(i), "g", x, True, i) for i, x in enumerate([1.0, 1.0, 1.0, 1.0, 0.8])], "id string, golden_set string, overall_score double, passed boolean, created_at long")
    last = evals.regression(runs).where("id = '4'").first()
    assert (last["moving_avg"], last["delta"], last["state"]) == (0.96, -0.16, "regression")


def test_drift(spark):
    i = spark.createDataFrame([("c", "f", "m", s) for s in ["error"] + ["warning"] * 2 + ["info"] * 3], "checker string, file string, message string, severity string")
    assert drift.score(i).first()["score"] == 81
    assert drift.score(i.where("severity = 'error'").crossJoin(spark.range(20))).first()["score"] == 0 and drift.score(i.limit(0)).first()["score"] == 100
    a = spark.createDataFrame([(1, 100, "a", "p", "w"), (2, 120, "b", "p", "w"), (3, 130, "b", "p", "w"), (4, 500, "a", "p", "w"), (5, 100, "b", "q", "w")], "id long, timestamp long, agent string, path string, kind string")
    assert {(r["id"], r["other_agent"], r["age"]) for r in drift.latest_in_window(a, 60).collect()} == {(2, "a", 20), (3, "a", 30)}
    assert {r["id"] for r in drift.debounce(a, 25).collect()} == {1, 3, 4, 5}


def test_budget(spark):
    r = spark.createDataFrame([(1, i, "x" * 1000) for i in range(4)] + [(2, 0, "y")] + [(3, i, "z") for i in range(100)], "g long, o long, t string")
    got = {x["g"]: (x["content_limit"], x["rows"]) for x in budget.fit(r, "g", "o", "t", 300).collect()}
    assert got == {1: (256, 4), 2: (512, 1), 3: (0, 49)}


def test_prefixes_of_many_lengths(spark):
    ids = spark.createDataFrame([("x" * 90,), ("y" * 90,), ("y" * 70,)], "id string")
    want = {"x" * n: ("found", "x" * 90) for n in range(1, 91)} | {"y" * 70: ("found", "y" * 70), "y" * 69: ("ambiguous", None), "x" * 91: ("missing", None), "": ("ambiguous", None)}
    got = graph.resolve_prefix(ids, spark.createDataFrame([(p,) for p in want], "prefix string")).collect()
    assert {r["prefix"]: (r["outcome"], r["id"]) for r in got} == want


def test_rows_of_other_worktrees_are_not_counted(spark):
    e = spark.createDataFrame([(1, "s", "a", 1, 10, 0.5, 1, "w1"), (2, "s", "a", 1, 20, 0.7, 2, "w2"), (3, "s", "b", 1, 40, None, 3, None), (4, "s", "b", 1, 80, None, 4, " ")], EVENTS)
    assert tuple(telemetry.session_totals(e, "s", "w1").first())[:2] == (1, 10) and tuple(telemetry.session_totals(e, "s", "").first())[:2] == (2, 120)
    assert {r["worktree_id"]: r["events"] for r in telemetry.session_summary(e).collect()} == {"w1": 1, "w2": 1, "project-root": 2}
    assert {(r["worktree_id"], r["tool"]): r["place"] for r in telemetry.tool_breakdown(e).collect()} == {("w1", "a"): 1, ("w2", "a"): 1, ("project-root", "b"): 1}


def test_session_proximity(spark):
    a = spark.createDataFrame([(1, "s", "w", "a", 0), (2, "s", "w", "b", 100), (3, "s", "w", "c", 350), (4, "s", "v", "d", 351), (5, "s", "w", "a", 1000), (6, "t", "w", "b", 120)], "id long, session_id string, worktree_id string, file_path string, accessed_at long")
    assert {(r["file_a"], r["file_b"]): r["n"] for r in memory.session_pairs(a).collect()} == {("a", "b"): 1, ("b", "c"): 1}
    many = spark.createDataFrame([(i, "s", "w", f"f{i:02}", i) for i in range(30)], "id long, session_id string, worktree_id string, file_path string, accessed_at long")
    assert memory.session_pairs(many).agg(F.sum("n")).first()[0] == sum(min(i + 1, 10) * (min(i + 1, 10) - 1) // 2 for i in range(30))


def reachable(edges, start):
    seen, todo = set(), [start]
    while todo:
        for b in edges.get(todo.pop(), ()):
            if b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def test_cycles_of_random_graphs(spark):
    r, edges = random.Random(2), []
    for g, (n, m) in enumerate(((30, 20), (30, 45), (30, 90), (40, 60), (12, 60))):
        edges += [(1000 * g + r.randrange(n), 1000 * g + r.randrange(n)) for _ in range(m)]
    edges += [(9000 + i, 9001 + i) for i in range(60)] + [(9020, 9015), (9050, 9050)] + [(8000 + i, 8000 + (i * i + 1) % 211) for i in range(211)]
    out = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    df = spark.createDataFrame(edges, "from_id long, to_id long")
    assert {x[0] for x in graph.cycle_nodes(df).collect()} == {v for v in out if v in reachable(out, v)}
    starts = [0, 1005, 2003, 9000, 9016]
    got = graph.transitive(df, spark.createDataFrame([(s,) for s in starts], "id long"), None).collect()
    assert sorted(map(tuple, got)) == sorted((s, v) for s in starts for v in reachable(out, s))


def test_closure_that_does_not_end_is_an_error(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "from_id long, to_id long")
    start = spark.createDataFrame([(0,)], "id long")
    assert graph.transitive(chain, start, None).count() == 40
    with pytest.raises(RuntimeError):
        graph.transitive(chain, start, None, most=3)


def test_bare_ids_are_completed(spark):
    ids = spark.createDataFrame([("task-a1",), ("task-a2",), ("task-b9",)], "id string")
    got = {r["prefix"]: (r["outcome"], r["id"]) for r in graph.resolve_prefix(ids, spark.createDataFrame([("a1",), ("a",), ("task-b",), ("task-a2",), ("q",)], "prefix string"), "task-").collect()}
    assert got == {"a1": ("found", "task-a1"), "a": ("ambiguous", None), "task-b": ("found", "task-b9"), "task-a2": ("found", "task-a2"), "q": ("missing", None)}


def test_conflicts_and_debounce_of_a_busy_path(spark):
    r = random.Random(5)
    rows = [(i, ts, f"a{r.randrange(3)}", "p", "w") for i, ts in enumerate(sorted(r.randrange(4000) for _ in range(600)))]
    a = spark.createDataFrame(rows, "id long, timestamp long, agent string, path string, kind string")
    want = {}
    for n, (i, ts, agent, *_) in enumerate(rows):
        before = [x for x in rows[:n] if x[2] != agent]
        if before and ts - before[-1][1] <= 9:
            want[i] = (before[-1][2], ts - before[-1][1])
    assert {x["id"]: (x["other_agent"], x["age"]) for x in drift.latest_in_window(a, 9).collect()} == want
    kept, last = set(), None
    for i, ts, *_ in rows:
        if last is None or ts - last >= 11:
            kept.add(i)
            last = ts
    assert {x["id"] for x in drift.debounce(a, 11).collect()} == kept


def test_vectors_of_a_wrong_length_are_refused(spark):
    there = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0])], "chunk_id string, vector array<double>")
    new = spark.createDataFrame([("b", [5.0, 6.0]), ("c", [7.0, 8.0])], "chunk_id string, vector array<double>")
    assert {r["chunk_id"]: r["vector"] for r in vectors.store(there, new, 2).collect()} == {"a": [1.0, 2.0], "b": [5.0, 6.0], "c": [7.0, 8.0]}
    with pytest.raises(Exception, match="vector of c has 1 dimensions, not 2"):
        vectors.store(there, spark.createDataFrame([("c", [7.0])], "chunk_id string, vector array<double>"), 2).collect()


def test_run_is_kept_and_learnt_from(spark, tmp_path):
    e = spark.createDataFrame([(i, "s", "t", 1, 1, 0.95, i, None) for i in range(20)], EVENTS)
    sets = spark.createDataFrame([("g", 0.9, True), ("h", 0.8, True)], "golden_set string, overall_score double, critical_pass boolean")
    assert evals.run_and_learn(sets, str(tmp_path / "runs"), e, 10, 0.7).first()["applied"]
    assert not evals.run_and_learn(sets, str(tmp_path / "runs"), e, 11, 0.85).first()["applied"]
    assert sorted((r["id"], r["passed"]) for r in spark.read.parquet(str(tmp_path / "runs")).collect()) == [("g-10", True), ("g-11", True), ("h-10", True), ("h-11", False)]


def test_folding_and_fields(spark):
    assert one(spark, X.index_tokens(F.col("t")), t="Élan vital, naïve ÇA Straße ﬁ") == ["elan", "vital", "naive", "ca", "straße", "ﬁ"]
    c = spark.createDataFrame([("1", "src/cafe.py", "Menu", "no such word", "class"), ("2", "src/x.py", None, "un café ici", "block")], "chunk_id string, file_path string, symbol_name string, content string, symbol_kind string")
    got = fts.bm25(c, spark.createDataFrame([(1, ["cafe"]), (2, ["menu", "word", "class"])], "query_id long, terms array<string>")).collect()
    assert {(r["query_id"], r["chunk_id"]) for r in got} == {(1, "1"), (1, "2"), (2, "1")}
    assert {r["chunk_id"] for r in fts.search(c, "symbol_name:menu OR content:cafe").collect()} == {"1", "2"}


def test_text_helpers(spark):
    p = F.col("p")
    assert one(spark, X.normal_newlines(p), p="a\r\nb\rc") == "a\nb\nc\n" and one(spark, X.normal_newlines(p), p="a\n") == "a\n"
    assert one(spark, X.rfc3339(p), p=1709251199) == "2024-02-29T23:59:59+00:00" and one(spark, X.bounded(p, 3), p="abcdef") == "abc"
    assert one(spark, X.relative(p, "/w/"), p="/w/a\\b") == "a/b" and one(spark, X.relative(p, "/w"), p="/x/a") is None and one(spark, X.unwatched(p, "/w"), p="/x/a")
    assert one(spark, X.trigrams(p), p="Ab-cD e") == ["abc", "bcd", "cde"] and one(spark, X.trigrams(p), p="ab") == [] and one(spark, X.neighbour_pairs(X.index_tokens(p)), p="a b") == ["a b"] and one(spark, X.neighbour_pairs(X.index_tokens(p)), p="") == []
    assert "search_code" in one(spark, X.missing_anchors(p), p="Provide Result") and one(spark, X.core_event(p), p="modify") and not one(spark, X.core_event(p), p="access")


def test_members_of_oversized_items():
    """Members are chunkable kinds one level deep; an impl block has no name to scope them by, and a class body in TypeScript holds none."""
    body = "        let x = 1 ;\n" * 200
    rust = "{} A {{\n    pub fn one(&self) {{\n" + body + "    }}\n    fn two() {{\n        fn deeper() {{}}\n    }}\n}}\n"
    names = lambda source, lang: [(c[2], c[4]) for c in chunking.symbol_chunks_of(source, lang)]
    assert names(rust.format("impl"), "rust") == [("one", None), ("two", None)] and names(rust.format("mod"), "rust") == [("one", "A/one"), ("two", "A/two")]
    ts = "class B {\n  async one(a: number): Promise<void> {\n" + "    if (a) { go ( a ) ; }\n" * 120 + "  }\n}\nfunction f() {\n" + "  const a = 1 ;\n" * 200 + "}\n"
    assert names(ts, "typescript")[:2] == [("B", None), (None, "f")] and len(names(ts, "typescript")) == 201
    py = "@d\nclass A:\n" + "    x = 1 ;\n" * 200 + "    @e\n    def m(self): pass\n"
    assert names(py, "python") == [("A", None)] and names(py[3:], "python") == [(None, "A")]
