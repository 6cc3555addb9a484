import json

import pytest
from pyspark.sql import functions as F

from trailhead.functions.health import environment
from trailhead.operators import drift
from trailhead.schemas import DDL, schema
from trailhead.sources import files as S
from trailhead.streaming import activity, windows


def test_walk(spark, tmp_path):
    files = {"src/a.rs": "fn a() {}", "src/.hidden.py": "x", "node_modules/m.js": "x", "b.py": "é", "c.bin": "x", ".git/x.py": "x", "gen/x_gen.rs": "x", "gen/keep_gen.rs": "y", "src/deep/b.py": "x", "src/deep/own.py": "z", "top/b.py": "w", "out/o.js": "x", "src/out/o.js": "v"}
    for name, text in files.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    (tmp_path / ".ignorefile").write_text("# c\nnode_modules/\n*_gen.rs\n!keep_gen.rs\n/out\n\n")
    (tmp_path / "src" / "deep" / ".ignorefile").write_text("*.py\n!own.py\n")
    got = {r["file_path"]: (r["language"], r["content"]) for r in S.walk(spark, str(tmp_path), ignore_files=(".ignorefile",)).collect()}
    assert got == {"src/a.rs": ("rust", "fn a() {}"), "b.py": ("python", "é"), "gen/keep_gen.rs": ("rust", "y"), "src/deep/own.py": ("python", "z"), "top/b.py": ("python", "w"), "src/out/o.js": ("javascript", "v")}
    assert {r["file_path"] for r in S.walk(spark, str(tmp_path), skip=("*.rs", "src/**/*.py"), ignore_files=()).collect()} == {"node_modules/m.js", "b.py", "top/b.py", "out/o.js", "src/out/o.js"}


def test_tables(spark, tmp_path):
    rows = spark.createDataFrame([("i1", "bug", "t")], "id string, kind string, title string")
    S.insert(rows, "intents", str(tmp_path))
    S.insert(rows.withColumn("updated_at", F.lit(5)), "intents", str(tmp_path))
    got = S.table(spark, "intents", str(tmp_path))
    assert got.columns == schema("intents").names and sorted((r["id"], r["updated_at"] or 0) for r in got.collect()) == [("i1", 0), ("i1", 5)]
    with pytest.raises(ValueError):
        S.insert(rows.withColumn("odd", F.lit(1)), "intents", str(tmp_path))


def test_doctor_of_a_folder(tmp_path):
    assert environment(str(tmp_path), "1", "2") == {"config_version": False, "initialised": False, "hooks": False}
    (tmp_path / ".project").mkdir()
    (tmp_path / ".git" / "hooks").mkdir(parents=True)
    (tmp_path / ".git" / "hooks" / "post-commit").write_text("x")
    assert all(environment(str(tmp_path), "1", "1").values())


def test_golden_files(spark, tmp_path):
    (tmp_path / "core.toml").write_text('[metadata]\nname = "core"\n[[cases]]\nid = "c"\npriority = "high"\n[cases.checks]\nmust_contain = ["a", "b"]\nmust_not_contain = ["x"]\n')
    got = S.golden_sets(spark, str(tmp_path))
    assert sorted((r["kind"], r["literal"], r["priority"]) for r in got.collect()) == [("must_contain", "a", "high"), ("must_contain", "b", "high"), ("must_not_contain", "x", "high")]
    assert S.golden_set_names(str(tmp_path)) == ["core"] and S.golden_set_names(str(tmp_path / "none")) == []
    with pytest.raises(FileNotFoundError):
        S.golden_sets(spark, str(tmp_path), "other")
    (tmp_path / "bad.toml").write_text('[[cases]]\nid = "c"\n[cases.checks]\nmust_contain = "a"\n')
    with pytest.raises(TypeError):
        S.golden_sets(spark, str(tmp_path))


def test_config(tmp_path):
    p = tmp_path / "c.toml"
    assert S.Config.load(str(p)) == S.Config()
    p.write_text("[router]\ntoken_pressure_threshold = 5\nother = 1\n[eval]\nci_threshold = 1\n")
    c = S.Config.load(str(p))
    assert c.token_pressure_threshold == 5 and c.extra == {"other": 1} and c.ci_threshold == 1
    p.write_text('debounce_ms = "x"\n')
    with pytest.raises(TypeError):
        S.Config.load(str(p))


def test_manifests(spark):
    m = spark.createDataFrame([("a/package.json", json.dumps({"dependencies": {"x": "1", "y": "2"}, "devDependencies": {"x": "2"}})), ("b", "not json"), ("c", "{}")], "file_path string, content string")
    assert {tuple(r) for r in S.manifest_dependencies(m).collect()} == {("a/package.json", "dependencies", "x", "1"), ("a/package.json", "dependencies", "y", "2"), ("a/package.json", "devDependencies", "x", "2")}


def test_validation():
    assert S.valid_name("a-b.md") and not S.valid_name(".a") and not S.valid_name("-a") and not S.valid_name("a/b")
    assert S.require_top_k("t", None, 5) == 5 and S.require("t", "q", " x ") == "x" and S.require_relative("t", "a/b") == "a/b" and S.structural_entry("rust: $X.unwrap()") == ("rust", "$X.unwrap()")
    for bad in (lambda: S.require_top_k("t", 0, 5), lambda: S.require_top_k("t", 1001, 5), lambda: S.require("t", "q", " "), lambda: S.require_relative("t", "../x"), lambda: S.require_relative("t", "/x"), lambda: S.structural_entry("$X.unwrap()")):
        with pytest.raises(ValueError):
            bad()


def test_schemas(spark):
    for name in DDL:
        assert spark.createDataFrame([], schema(name)).count() == 0


EVENTS = "id long, timestamp long, agent string, path string, kind string"


def events(spark):
    rows = [(i, 100 + (i * 37) % 900, f"a{i % 3}", f"p{i % 4}", "modify") for i in range(120)]
    return spark.createDataFrame(rows, EVENTS)


def run_stream(spark, tmp_path, make, name):
    folder = tmp_path / "in"
    events(spark).coalesce(1).write.json(str(folder))
    stream = spark.readStream.schema(EVENTS).json(str(folder))
    q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_debounce_stream_equals_batch(spark, tmp_path):
    got = {r["id"] for r in run_stream(spark, tmp_path, lambda s: activity.debounce_stream(s, 60), "debounced").collect()}
    assert got == {r["id"] for r in drift.debounce(events(spark), 60).collect()} and activity.debounce_gap(750) == 1


def test_conflict_stream_equals_batch(spark, tmp_path):
    got = {tuple(r) for r in run_stream(spark, tmp_path, lambda s: activity.conflict_stream(s, 60), "conflicts").collect()}
    want = {(r["id"], r["path"], r["agent"], r["other_agent"], r["age"]) for r in drift.latest_in_window(events(spark), 60).collect()}
    assert got == want


def test_activity_log(spark, tmp_path):
    S.append_activity(events(spark), str(tmp_path / "log"))
    S.append_activity(events(spark).limit(3), str(tmp_path / "log"))
    assert S.read_activity(spark, str(tmp_path / "log")).count() == 123 and S.read_activity(spark, str(tmp_path / "log"), stream=True).isStreaming


def test_windowed_stream(spark, tmp_path):
    folder, kind = tmp_path / "ev", "session_id string, tool string, latency_ms long, created_at long"
    spark.createDataFrame([("s", "t", 5, 10), ("s", "t", 7, 20), ("s", "u", 1, 4000), ("s", "t", 1, 20000)], kind).coalesce(1).write.json(str(folder))
    batch = {tuple(r) for r in windows.windowed_calls(spark.read.schema(kind).json(str(folder)), "1 hour").collect()}
    s = windows.windowed_calls(spark.readStream.schema(kind).json(str(folder)), "1 hour", late="1 minute")
    q = s.writeStream.format("memory").queryName("windowed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("windowed").collect()} <= batch and (0, "t", 2, 12) in batch
