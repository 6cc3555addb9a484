"""Scans of a hot key by segments give what one sorted scan gives."""

import random

import pytest
from pyspark.sql import functions as F

from trailhead.operators import drift, graph

KIND = "id long, timestamp long, agent string, path string"


@pytest.fixture(params=[1, 7])
def partitions(spark, request):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield request.param
    for k, v in before.items():
        spark.conf.set(k, v)


def rows(seed, n=700):
    r = random.Random(seed)
    t, out = 0, []
    for i in range(n):
        t += r.choice((0, 0, 1, 3, 9, 40))
        out.append((i, t, r.choice("aaaaaab") if i % 90 < 60 else r.choice("abc"), "hot" if r.random() < 0.9 else r.choice("xyz")))
    return out + [(n, 5, "a", None), (n + 1, 6, "b", None), (n + 2, 7, None, "nobody"), (n + 3, 8, "b", "nobody")]


def by_path(data):
    out = {}
    for r in sorted(data, key=lambda r: (r[1], r[0])):
        out.setdefault(r[3], []).append(r)
    return out


def test_runs_by_pause(spark, partitions):
    data = rows(1)
    df = spark.createDataFrame(data, KIND).repartition(3)
    got = {r["id"]: (r["path"], r["run"]) for r in graph.by_pause(df, "path", "timestamp", "id", 9).collect()}
    want = {}
    for path, mine in by_path(data).items():
        run, last = 0, None
        for i, t, *_ in mine:
            run += last is None or t - last >= 9
            last = t
            want[i] = (path, run)
    assert got == want
    if partitions > 1:
        sizes = [r["count"] for r in graph.segments(df, "path", "timestamp", "id").groupBy("path", "seg").count().collect()]
        assert max(sizes) < 0.4 * len(data)


def test_latest_by_another_agent(spark, partitions):
    for seed in (2, 3):
        data = rows(seed)
        got = {(r["id"], r["other_agent"], r["age"]) for r in drift.latest_in_window(spark.createDataFrame(data, KIND).repartition(3), 30).collect()}
        want = set()
        for mine in by_path([r for r in data if r[2]]).values():
            for n, (i, t, agent, _) in enumerate(mine):
                other = next(((a, u) for _, u, a, _ in reversed(mine[:n]) if a != agent), None)
                if other and t - other[1] <= 30:
                    want.add((i, other[0], t - other[1]))
        assert {g for g in got if g[1] is not None} == want


def test_debounce_and_empty(spark, partitions):
    data = rows(4)
    got = {r["id"] for r in drift.debounce(spark.createDataFrame(data, KIND), 9).collect()}
    want = set()
    for mine in by_path(data).values():
        last = None
        for i, t, *_ in mine:
            if last is None or t - last >= 9:
                last = t
                want.add(i)
    assert got == want
    none = spark.createDataFrame([], KIND)
    assert drift.debounce(none, 9).collect() == [] and drift.latest_in_window(none, 9).collect() == [] and graph.by_pause(none, "path", "timestamp", "id", 9).select(F.max("run")).first()[0] is None
