"""Streams with kept state, sinks that replays don't change, sketches, snippets and templates."""

import pytest
from pyspark.sql import functions as F

from trailhead.functions import text as X
from trailhead.operators import fts, graph, sketches
from trailhead.sources.snapshots import scratch_table
from trailhead.streaming import locks, windows
from trailhead.streaming.sinks import AppendSink, LatestSink

REQUESTS = "id long, intent_id string, worktree_id string, action string, ts long"


@pytest.fixture
def provider(spark):
    before = spark.conf.get(locks.PROVIDER[0])
    spark.conf.set(*locks.PROVIDER)
    yield
    spark.conf.set(locks.PROVIDER[0], before)


def test_lock_stream_equals_batch_after_a_restart(spark, tmp_path, provider):
    rows = [(i, f"i{i % 3}", [" ", "wt-1", "wt-2", None][(i * 7) % 4], "release" if i % 5 == 0 else "acquire", 1000 + i * 13 + (4000 if i > 60 else 0)) for i in range(90)]
    folder, out = str(tmp_path / "in"), AppendSink(spark, scratch_table(spark, "locks"), "id long, intent_id string, outcome string, held_by string")
    (tmp_path / "in").mkdir()
    stream = locks.lock_stream(spark.readStream.schema(REQUESTS).json(folder), lease=100)
    for part in (rows[:40], rows[40:]):  # the second run goes on from the first one's checkpoint
        spark.createDataFrame(part, REQUESTS).coalesce(1).write.mode("append").json(folder)
        out.start(stream, str(tmp_path / "cp")).awaitTermination()
    want = sorted(map(tuple, graph.lock_outcomes(spark.createDataFrame(rows, REQUESTS), lease=100).collect()))
    assert sorted(map(tuple, out.frame().collect())) == want and {r[2] for r in want} == {"acquired", "conflict", "released", "not_held"}
    held = {r["intent_id"]: r["holder"] for r in locks.leases(spark, str(tmp_path / "cp")).collect()}
    assert held and held.items() <= {r[1]: r[3] for r in want}.items()


def test_replayed_batches_change_nothing(spark):
    kind = "k string, v long, at long"
    rows = lambda *r: spark.createDataFrame(list(r), kind)
    append, latest = AppendSink(spark, scratch_table(spark, "a"), kind), LatestSink(spark, scratch_table(spark, "l"), kind, "k", "at", buckets=4)
    assert append.frame().collect() == [] and latest.frame().collect() == []
    for sink in (append, latest):
        assert sink.write(rows(("a", 1, 1), ("b", 2, 1)), 0) and not sink.write(rows(("a", 9, 9)), 0)
        assert sink.write(rows(("a", 3, 2), ("a", 4, 3), ("b", 0, 0), (None, 1, 1)), 1) and not sink.write(rows(("c", 1, 1)), 1)
    assert sorted(r["v"] for r in append.frame().collect()) == [0, 1, 1, 2, 3, 4]
    assert sorted(map(tuple, latest.frame().collect())) == [("a", 4, 3), ("b", 2, 1)]


def test_failed_batches_leave_no_rows(spark):
    kind = "k string, v long"
    sink = AppendSink(spark, scratch_table(spark, "a"), kind)
    broken = spark.range(3).select(F.lit("k").alias("k"), F.when(F.col("id") == 2, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("long").alias("v"))
    with pytest.raises(Exception, match="broken"):
        sink.write(broken, 0)
    assert sink.frame().collect() == [] and sink.write(spark.createDataFrame([("k", 1)], kind), 0)
    assert [tuple(r) for r in sink.frame().collect()] == [("k", 1)]


def test_sketches_over_any_range(spark):
    rows = [("t" if i % 3 else "u", f"s{i % 700}", i % 1000 if i % 10 else None, 86_400 * (i % 9) + 5) for i in range(9000)]
    e = spark.createDataFrame([*rows, ("t", "s", 1, None)], "tool string, session_id string, latency_ms long, created_at long")
    stored = sketches.daily(e)
    got = {r["tool"]: r for r in sketches.over(stored, 2, 5).collect()}
    for tool in ("t", "u"):
        mine = [r for r in rows if r[0] == tool and 2 <= r[3] // 86_400 <= 5]
        sessions, times = len({r[1] for r in mine}), sorted(r[2] for r in mine if r[2] is not None)
        assert got[tool]["calls"] == len(mine) and abs(got[tool]["sessions"] - sessions) <= 0.05 * sessions
        for q, x in zip((0.5, 0.95), got[tool]["latency"], strict=True):
            assert abs(sum(t <= x for t in times) / len(times) - q) < 0.03
    assert sum(r["calls"] for r in sketches.over(stored).collect()) == 9000 and sketches.over(stored.limit(0)).collect() == []


def test_best_snippets(spark):
    text = " ".join(["alpha", *["x"] * 40, "beta", "y", "Alpha,", *["z"] * 40])
    df = spark.createDataFrame([(text, ["alpha", "beta"]), ("none here", ["q"]), ("", ["q"]), (None, ["q"]), ("alpha beta", ["alpha"])], "content string, terms array<string>")
    got = [r["snippet"] for r in fts.best_snippets(df, "content", "terms", 9).collect()]
    assert got == ["...x x x >>>beta<<< y >>>Alpha,<<< z z z...", "none here", "", None, ">>>alpha<<< beta"]


def test_render(spark):
    cases = ["a {{ x }} b", "{{x}}{{y}}", "{{ x", "{{ a {{x}} }}", "}} {{x}}", "{{ z }} {{\tx\n}}", "", "{{}}"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, body string")
    known = F.create_map(F.lit("x"), F.lit("<{{y}}>"), F.lit("y"), F.lit("Y"))
    got = {r["i"]: r["out"] for r in df.select("i", X.render(F.col("body"), known).alias("out")).collect()}
    assert got == dict(enumerate(["a <{{y}}> b", "<{{y}}>Y", "{{ x", "{{ a {{x}} }}", "}} <{{y}}>", "{{ z }} <{{y}}>", "", "{{}}"]))


def test_events_exactly_a_gap_apart_are_in_two_sessions(spark):
    e = spark.createDataFrame([("a", 0), ("a", 3600), ("a", 7199), ("b", 5)], "session_id string, created_at long")
    assert sorted(tuple(r) for r in windows.session_gaps(e, "1 hour").collect()) == [("a", 0, 1), ("a", 3600, 2), ("b", 5, 1)]
