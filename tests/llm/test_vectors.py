import numpy as np
import pytest

from trailhead.llm import ann
from trailhead.llm.near_vectors import near_duplicates

NAN, INF = float("nan"), float("inf")


def brute(rows):
    ok = [(k, np.array(v, float), g) for k, v, g in rows if k is not None and g is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    link = {k: set() for k, *_ in ok}
    for i, (a, x, g) in enumerate(ok):
        for b, y, h in ok[i + 1 :]:
            if g == h and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                link[a].add(b)
                link[b].add(a)
    comp = {}
    for k in sorted(link):
        if k not in comp:
            todo = [k]
            while todo:
                n = todo.pop()
                if n not in comp:
                    comp[n] = k
                    todo += link[n]
    return {k: (len(link[k]) if k in link else 0, comp.get(k, k)) for k, *_ in rows}


@pytest.mark.parametrize("block", [1024, 16])
def test_near_vectors_against_brute_force(spark, block):
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(16).tolist(), i % 2) for i in range(200)]
    centre = rng.standard_normal(16)
    rows += [(1000 + i, (centre + rng.standard_normal(16) * 0.08).tolist(), 0) for i in range(120)]
    rows += [(2000 + i, centre.tolist(), 0) for i in range(30)] + [(3000 + i, centre.tolist(), 1) for i in range(3)]
    rows += [(4000, None, 0), (4001, [0.0] * 16, 0), (4002, [NAN] + [1.0] * 15, 0), (4003, [None] + [1.0] * 15, 0), (4004, [INF] + [1.0] * 15, 0), (4005, centre.tolist(), None), (4006, [], 0), (4007, [1.0, 2.0], 0), (4008, [1.0, 2.0], 0)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, rep string, n int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_duplicates(df, leaf=32, block=block).collect()}
    assert got == brute(rows)


def test_trees_keep_the_chance_of_a_miss():
    from trailhead.llm.near_vectors import trees_for

    assert trees_for(0, 0.98, 0.15, 1e-6) == 1 and trees_for(5, 0.98, 0.15, 1e-6) == 4 < trees_for(22, 0.98, 0.15, 1e-6) <= 8
    rng, depth = np.random.default_rng(3), 40  # many levels, so that a share of the pairs at the threshold is parted by a tree
    a = rng.standard_normal((3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o = rng.standard_normal(a.shape)
    o -= (o * a).sum(1, keepdims=True) * a
    o /= np.linalg.norm(o, axis=1, keepdims=True)
    b, together = 0.98 * a + np.sqrt(1 - 0.98**2) * o, np.ones(len(a), bool)
    for _ in range(depth):
        g = rng.standard_normal(64)
        x, y = a @ g, b @ g
        together &= ~((np.minimum(x, y) <= -0.15) & (np.maximum(x, y) >= 0.15))
    want = 1 - 10 ** (-6 / trees_for(depth, 0.98, 0.15, 1e-6, least=1, most=99))
    assert abs(together.mean() - want) < 0.05


def test_near_vectors_repeated_rows_and_empty(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert near_duplicates(spark.createDataFrame([], kind)).collect() == []
    got = near_duplicates(spark.createDataFrame([(7, [1.0, 0.0], 0)] * 2 + [(9, [0.0, 1.0], 0)], kind)).collect()
    assert sorted((r["vec_id"], r["component_id"], r["kept"]) for r in got) == [(7, 7, True), (7, 7, True), (9, 9, True)]


def search(spark, rows, k=20, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = ann.build_index(df, "vec_id", "embedding", **how)
    got = ann.search(df.where("vec_id % 20 = 0"), index, "vec_id", "embedding", k=k).collect()
    out = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_nearest_recall_order_and_shards(spark):
    rng = np.random.default_rng(2)
    centre = rng.standard_normal(24)
    rows = [(i, (rng.standard_normal(24) * rng.uniform(0.5, 2)).tolist()) for i in range(1500)] + [(5000 + i, (centre + rng.standard_normal(24) * 0.01).tolist()) for i in range(500)]
    rows += [(9000, None), (9020, [0.0] * 24), (9040, [NAN] * 24), (9060, centre.tolist()), (9061, centre.tolist()), (9062, centre.tolist())]
    x = {k: np.array(v) for k, v in rows if v and np.isfinite(v).all() and any(v)}
    got = search(spark, rows, shard=700)
    assert set(got) == {k for k in x if k % 20 == 0}
    hit = 0
    for q, found in got.items():
        want = sorted(((-float(x[q] @ v), k) for k, v in x.items() if k != q))[:20]
        assert len(found) == 20 and [(-s, k) for k, s in found] == sorted((-s, k) for k, s in found)
        assert all(abs(s - x[q] @ x[k]) < 1e-9 for k, s in found) and q not in dict(found)
        hit += len({k for _, k in want} & set(dict(found)))
    assert hit / (20 * len(got)) >= 0.95


def test_nearest_of_repeated_keys_and_clashing_columns(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.0, 2.0]), (None, [9.0, 9.0])]
    df = spark.createDataFrame([(k, [float(x) for x in v], 1, "s") for k, v in rows], "vec_id long, embedding array<float>, shard int, dim string")
    got = ann.search(df.where("vec_id = 0"), ann.build_index(df, "vec_id", "embedding"), "vec_id", "embedding").collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got) == [(1, 2, 2.0), (2, 1, 0.0), (3, 1, 0.0)]


def test_nearest_few_and_none(spark):
    assert search(spark, []) == {}
    got = search(spark, [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0])])
    assert [k for k, _ in got[0]] == [1, 3, 2]


@pytest.mark.parametrize("spread", [0.5, 1.0, None])
def test_graph_search_where_norms_differ(spread):
    """Norms of a log-normal spread, or one vector ten times as long as the others: all rows stay nodes, and a query scores a part of them."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((4000, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x *= np.exp(spread * rng.standard_normal((len(x), 1))) if spread else np.where(np.arange(len(x)) == 0, 10.0, 1.0)[:, None]
    order, bands = ann._bands(x)
    x = x[order]
    graphs = []
    for lo, hi in ann._ranges(bands):
        lifted = ann._lift(x[lo:hi])
        graphs.append(ann.Graph(lifted, scale=(lifted[:, :-1] ** 2).sum(1)))
    assert all((g.rep == np.arange(len(g.x))).all() for g in graphs)
    parts = [b"".join(p) for p in zip(*[(g.edges.tobytes(), g.rep.tobytes(), np.int32(g.start).tobytes()) for g in graphs])]
    shard = ann.Shard(48, np.arange(len(x)).tobytes(), np.ones(len(x), np.int64).tobytes(), x.tobytes(), *parts, bands.astype(np.int32).tobytes(), "f8")
    scored = []
    for _, _, g, _ in shard.parts:
        g.search = lambda q, beam, f=g.search: (lambda r: (scored.append(int((r[0] >= 0).sum())), r)[1])(f(q, beam))
    some = np.arange(0, len(x), 50)
    got = shard.look(x[some], some, 20, 100)
    exact = x[some] @ x.T
    exact[np.arange(len(some)), some] = -np.inf
    hits = sum(len(set(np.argsort(-e)[:20].tolist()) & {k for k, _ in g}) for e, g in zip(exact, got))
    assert hits >= 0.95 * 20 * len(some) and sum(scored) <= 0.3 * len(x) * len(some)
