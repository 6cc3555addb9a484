"""Cycles of what is left of a graph, by one task and by rounds."""

import random

import numpy as np
import pytest

from trailhead.operators import graph


def on_cycles(edges):
    """Nodes that reach themselves, by walking from each."""
    to = {}
    for a, b in edges:
        to.setdefault(a, set()).add(b)
    out = set()
    for start in to:
        seen, front = set(), {start}
        while front:
            front = {b for a in front for b in to.get(a, ())} - seen
            seen |= front
        if start in seen:
            out.add(start)
    return out


def test_components_by_brute_force():
    r = random.Random(3)
    for n, m in [(1, 0), (2, 2), (9, 12), (40, 50), (60, 70), (200, 260)] * 20:
        e = {(a, b) for a, b in ((r.randrange(n), r.randrange(n)) for _ in range(m)) if a != b}
        src, dst = (np.array([x[i] for x in e], np.int64) for i in (0, 1))
        got = graph._in_components(src, dst, n)
        assert set(got) == on_cycles(e) and len(got) == len(set(got))
    # a path and a circle as long as they get, without recursion
    n = 200_000
    i = np.arange(n)
    assert graph._in_components(i[:-1], i[1:], n) == [] and len(graph._in_components(i, (i + 1) % n, n)) == n


@pytest.mark.parametrize("kind", ["int", "string"])
def test_few_edges_take_few_tables(spark, monkeypatch, kind):
    r = random.Random(5)
    e = [(r.randrange(90), r.randrange(90)) for _ in range(110)] + [(95, 95), (None, 3), (3, None)]
    df = spark.createDataFrame(e, "from_id int, to_id int").selectExpr(f"cast(from_id as {kind}) from_id", f"cast(to_id as {kind}) to_id")
    made, real = [], graph.written
    monkeypatch.setattr(graph, "written", lambda d, name: (made.append(name), real(d, name))[1])
    want = on_cycles([x for x in e if None not in x])
    assert {int(x[0]) for x in graph.cycle_nodes(df).collect()} == want and len(made) == 3
    monkeypatch.setattr(graph, "LOCAL", 0)
    assert {int(x[0]) for x in graph.cycle_nodes(df).collect()} == want and len(made) > 6
