"""The closure of many starts: pairs are held as bits of groups, and plain rounds agree with doubled walks."""

import random

from trailhead.operators import graph


def closure(edges, starts):
    out, step = set(), {}
    for a, b in edges:
        step.setdefault(a, set()).add(b)
    for s in starts:
        todo, seen = [s], set()
        while todo:
            fresh = step.get(todo.pop(), set()) - seen
            seen |= fresh
            todo += fresh
        out |= {(s, x) for x in seen}
    return out


def frames(spark, edges, starts):
    return spark.createDataFrame(edges, "from_id long, to_id long"), spark.createDataFrame([(s,) for s in starts], "id long")


def test_common_nodes_move_once_a_group(spark, monkeypatch):
    rows, write = [], graph.written

    def counted(df, name):
        out = write(df, name)
        rows.append((name, out.written_rows))
        return out

    monkeypatch.setattr(graph, "written", counted)
    starts = list(range(1000, 1512))
    edges = [(s, 0) for s in starts] + [(i, i + 1) for i in range(20)]
    got = sorted(map(tuple, graph.transitive(*frames(spark, edges, starts), None).collect()))
    assert got == sorted(closure(edges, starts)) and len(got) == 512 * 21
    # 512 starts reach the same 21 nodes: a row a group and node, not one a pair
    assert sum(n for name, n in rows if name == "closure") < len(got) / 10


def test_plain_rounds_agree(spark, monkeypatch):
    r = random.Random(3)
    tree = [(i, i // k) for i in range(2, 400) for k in (2, 3)]
    starts = [i for i in range(400) if i % 3 == 0]
    for extra in ([], [(r.randrange(40), r.randrange(400)) for _ in range(12)]):  # without and with cycles
        want = sorted(closure(tree + extra, starts))
        for plain in (0, 300):
            monkeypatch.setattr(graph, "PLAIN", plain)
            assert sorted(map(tuple, graph.transitive(*frames(spark, tree + extra, starts), None, every=2).collect())) == want


def test_walks_that_stay(spark, monkeypatch):
    monkeypatch.setattr(graph, "FEW", 0)
    monkeypatch.setattr(graph, "JUMPS", 1)
    edges = [(a, b) for a in range(30) for b in (a + 1, a + 2, (7 * a) % 30)]
    starts = list(range(30))
    assert sorted(map(tuple, graph.transitive(*frames(spark, edges, starts), None, every=1).collect())) == sorted(closure(edges, starts))
