"""Scope globs against brute force, and cases that hold literals and code patterns."""

import re

from pyspark.sql import functions as F

from trailhead.functions import text as X
from trailhead.operators import drift, evals, graph

GLOBS = ["src/**/*.rs", "src/*.rs", "**/*.py", "**", "*", "a.b/c?.tx", "docs/**", "docs/guide.md", "(x)/[y]+/*.{z}", "src/in/**/deep/*.rs", "/abs/*.rs", "é/*", "none/*.rs", "a$b/^c|d/#&&~-.*", "src/**/**/m.rs", "*.tar.gz", "src//x?.rs"]
PATHS = ["src/m.rs", "src/in/m.rs", "src/in/a/b/deep/q.rs", "a.b/cd.tx", "aXb/cd.tx", "docs/guide.md", "docs/guideXmd", "(x)/[y]+/k.{z}", "x/y/k.z", "/abs/n.rs", "é/ü", "p.py", "a$b/^c|d/#&&~-.t", "q.tar.gz", "src//x1.rs", "", None]


def test_patterns_of_columns_are_those_of_strings(spark):
    got = spark.createDataFrame([(g,) for g in GLOBS], "g string").crossJoin(spark.createDataFrame([(p,) for p in PATHS if p is not None], "p string"))
    rows = got.select("g", "p", F.rlike("p", X.path_pattern(F.col("g"))).alias("hit")).collect()
    assert len(rows) == len(GLOBS) * (len(PATHS) - 1)
    for g, p, hit in rows:
        assert hit == bool(re.search(X.path_regex(g), p)), (g, p)


def test_unmatched_scopes_against_brute_force(spark):
    conventions = spark.createDataFrame([(f"c{n}.toml", f'scope = "{g}"\n') for n, g in enumerate(g for g in GLOBS if "#" not in g)], "file string, body string")
    got = drift.unmatched_scopes(conventions, spark.createDataFrame([(p,) for p in PATHS], "file_path string"))
    want = {g for g in GLOBS if "#" not in g and not any(p is not None and re.search(X.path_regex(g), p) for p in PATHS)}
    assert "none/*.rs" in want and {re.search("'(.*)'", r.message).group(1) for r in got.collect()} == want
    none = spark.createDataFrame([], "file_path string")
    assert drift.unmatched_scopes(conventions, none).count() == conventions.count()


def test_a_case_counts_both_families(spark):
    rows = [("k", "critical", "must", "here", "", ""), ("k", "critical", "must_not", "gone", "", ""), ("k", "critical", "structural_must_not", "python:print($X)", "", ""), ("k", "critical", "structural_must", "python:run($X)", "", ""), ("m", "low", "structural_must", "odd", "", "")]
    checks = spark.createDataFrame(rows, "case_id string, priority string, kind string, literal string, include string, exclude string")
    chunks = spark.createDataFrame([("a.txt", 0, "here"), ("b.txt", 0, "gone")], "file_path string, start_line int, content string")
    files = spark.createDataFrame([("a.py", "python", "run(1)\nprint(2)\n"), ("b.py", "python", "# print(3)\n")], "file_path string, language string, content string")
    scores = evals.case_scores(checks, evals.all_violations(checks, chunks, files, rows))
    assert {r.case_id: (r.checks, r.violations, r.files, r.score, r.passed) for r in scores.collect()} == {"k": (4, 2, 2, 0.5, False), "m": (1, 1, 0, 0.0, False)}
    assert evals.golden_score(scores).first() == (0.4, False)


def test_trees_around_cycles_go_before_walks_are_doubled(spark, monkeypatch):
    rows = [(f"n{i}", f"n{i // 2}") for i in range(2, 2000)] + [("n1", "n2"), ("n2", "n3"), ("n3", "n1")]
    seen, write = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: (out := write(df, name), seen.append((name, out.written_rows)))[0])
    e = write(spark.createDataFrame(rows, "from_id string, to_id string").distinct(), "graph")
    kept = {tuple(r) for r in graph._trimmed(e, 100).collect()}
    assert kept == {("n2", "n1"), ("n3", "n1"), ("n1", "n2"), ("n2", "n3")}
    assert max([n for name, n in seen if name == "walks"], default=0) < 500
