import gzip
import hashlib
import math
import random
import re

import numpy as np
import pytest

from trailhead.llm import hosts, mixing, quality, warc
from trailhead.llm.common import components, cut


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(200, 200), (None, 3)]
    random.Random(1).shuffle(edges)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_warc_round_trip(spark):
    big = "<p>é\r\n\r\nWARC/1.1\r\n" + "x" * 200
    rows = [(5, "http://a/b c\n", big), (2, None, big), (9, "https://x/", big), (3, "u", "short"), (1, "u", "short"), (4, "u", None), (6, "u", ""), (7, "u", "y" * 100), (8, "u", "y" * 100), (8, "u", "y" * 100), (None, "u", "y" * 100)]
    df = spark.createDataFrame([(*r, "e") for r in rows], "page_id long, url string, html string, payload_digest string")
    got = warc.round_trip(spark, df).collect()
    assert len(got) == len(rows)
    want = []
    for k, _, h in rows:
        data = (h or "").encode()
        same = [x for x, _, o in rows if (o or "") == (h or "") and x is not None]
        first = min(same) if len(data) >= 100 and same else None
        again = first is not None and k != first
        want.append((k, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == sorted(want, key=str)
    assert len({r["record_id"] for r in got}) == len(set(rows))
    assert warc.round_trip(spark, df.limit(0)).collect() == []


def test_warc_of_keys_beyond_double_precision(spark):
    big = 1 << 60
    rows = [(big + 1, "u", "z" * 120), (big + 5, "u", "z" * 120), (big + 9, "u", "other"), (None, "u", "z" * 120)]
    got = warc.round_trip(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    want = [(big + 1, "response", None), (big + 5, "revisit", big + 1), (big + 9, "response", None), (None, "revisit", big + 1)]
    assert sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in got), key=str) == sorted(want, key=str)


def test_warc_files_are_bounded_in_bytes(spark, tmp_path):
    rows = [(i, "u", f"{i} " + "".join(random.Random(i).choices("abcdef", k=200 if i % 5 else 9000))) for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(df, str(tmp_path / "w"), bundle=3000, per_file=4)
    files = [b"".join(warc.inflate(p.read_bytes())) for p in sorted((tmp_path / "w").glob("part-*"))]
    found = [len(list(warc.records(iter([f])))) for f in files]
    assert sum(found) == 60 and len(files) > 10 and all(len(f) <= 4 * 3000 + 10_000 for f in files)
    back = warc.read_archives(spark, str(tmp_path / "w"), content=True).collect()
    assert sorted((r["key"], bytes(r["payload"]).decode()) for r in back) == [(k, h) for k, _, h in rows]


def test_archives_in_chunks():
    rec = [warc.to_warc(next(warc.parse_arc(warc.version_block(1) + warc.arc_record("u", "2001", b"HTTP/1.1 200 OK\r\n\r\n" + b"x" * n, 1))), str(n)) for n in (0, 1, 70_000)]
    data = b"\r\n".join(r + warc.END for r in rec)
    zipped = b"".join(gzip.compress(r + warc.END) for r in rec)
    whole = list(warc.parse_warc(data))
    assert len(whole) == 3 and all(list(warc.records(data[i : i + n] for i in range(0, len(data), n))) == whole for n in (1, 7, 1000))
    assert all(list(warc.records(warc.inflate(zipped, n))) == whole for n in (1, 13, 1 << 16))
    for bad in (zipped[:-9], b"\x1f\x8b"):
        with pytest.raises(ValueError):
            list(warc.records(warc.inflate(bad)))
    with pytest.raises(ValueError):
        list(warc.parse_warc(data[:-100]))


@pytest.mark.parametrize("version", [1, 2])
def test_arc_records_by_declared_length(version):
    body = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nhttp://fake/ 0.0.0.0 20000101000000 text/html 3\nabc\n"
    data = warc.version_block(version) + warc.arc_record("http://h/a b", "20010203040506", body, version) + warc.arc_record("dns:h", "2001", b"", version, mime="text/dns") + b"\n"
    a, b = warc.parse_arc(data)
    assert a.body == body and a.url == "http://h/a%20b" and a.version == version and a.status == (200 if version == 2 else None) and b.body == b""
    (head, block), (head2, _) = warc.parse_warc(warc.to_warc(a, "1") + warc.END + warc.to_warc(b, "2") + warc.END)
    assert block == body and warc.field(head, b"WARC-Date") == "2001-02-03T04:05:06Z" and warc.field(head, b"WARC-Type") == "response"
    assert warc.field(head2, b"WARC-Type") == "resource" and warc.field(head2, b"WARC-Date") == "2001-01-01T00:00:00Z"
    assert warc.field(head, b"WARC-Payload-Digest") == "sha256:" + hashlib.sha256(body.split(b"\r\n\r\n", 1)[1]).hexdigest()
    for bad in (data[:-60], b"http://x 1 2\nabc"):
        with pytest.raises(ValueError):
            list(warc.parse_arc(bad))


def brute_mix(rows):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for n, r in zip(size, rows, strict=True) if r[2] == s) for s in names}
    w, target, open_ = {s: i % 3 + 1 for i, s in enumerate(names)}, {}, set(names)
    rest = float(sum(size))
    while open_:
        level = rest / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] >= 3 * total[s]}
        for s in over or open_:
            target[s] = 3.0 * total[s] if over else level * w[s]
            rest -= target[s] if over else 0
        open_ -= over or open_
    taken = {}
    for s in names:
        mine = [(i, rows[i][0]) for i in range(len(rows)) if rows[i][2] == s]
        epochs = int(target[s] // total[s]) if total[s] else 0
        left, order = target[s] - epochs * total[s], []
        for i, d in mine:
            u = (int(hashlib.md5(("" if d is None else str(d)).encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            q = max(1.0, min(2.0, len((rows[i][1] or "").encode()) / size[i] / 6 if size[i] else 1.0))
            order.append((-math.log(u) / q, str(d), i))
        at = 0
        for _, _, i in sorted(order):
            taken[i] = size[i] * (epochs + (left > 0 and at + size[i] / 2 <= left))
            at += size[i]
    return [(rows[i][0], size[i], total[rows[i][2]], target[rows[i][2]], taken[i]) for i in range(len(rows))]


def test_mix_against_brute_force(spark):
    r = random.Random(3)
    rows = [(i, " ".join("w" * r.randint(1, 12) for _ in range(r.randint(0, 60))), r.choice(["a", "a", "a", "a", "b", "é", "Z", None])) for i in range(900)] + [(5000, None, "a"), (5001, "\t\n", "only empty"), (5002, "x y z", "tiny")]
    df = spark.createDataFrame([(d, t, s, 1, 2) for d, t, s in rows], "doc_id long, text string, source string, size int, `__size` int")
    out = mixing.mix(df).collect()
    got = sorted((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in out)
    want = sorted(brute_mix(rows))
    assert [x[:3] + x[4:] for x in got] == [x[:3] + x[4:] for x in want] and np.allclose([x[3] for x in got], [x[3] for x in want])
    times = {r["doc_id"]: r["times"] for r in out}
    applied = mixing.apply_mix(df)
    assert applied.columns == df.columns
    counts = {r["doc_id"]: r["count"] for r in applied.groupBy("doc_id").count().collect()}
    assert counts == {k: v for k, v in times.items() if v}
    assert mixing.mix(df.limit(0)).collect() == [] and mixing.apply_mix(df.limit(0)).collect() == []


def test_mix_by_small_buckets_is_the_same(spark):
    rows = [(i, "word " * (i % 17), f"s{i % 3}") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    keyed = cut(mixing._keyed(df, "doc_id", "text", "source", None))
    a, b = (sorted((r["source"], r["last"] and r["last"]["__k"]) for r in mixing.plan(keyed, per_bucket=n).collect()) for n in (4096, 7))
    assert {k for k, v in a if v} == {k for k, v in b if v}
    assert sum(r["taken"] for r in mixing.mix(df).collect()) == pytest.approx(sum(17 and i % 17 for i in range(500)), rel=0.02)


def brute_rank(links, seeds, rounds=20):
    out = {}
    for (s, _), n in links.items():
        out[s] = out.get(s, 0) + n
    base = {h: 0.15 * w for h, w in seeds.items()}
    rank = dict(base)
    for _ in range(rounds):
        new = dict(base)
        for (s, d), n in links.items():
            if s in rank:
                new[d] = new.get(d, 0) + 0.85 * rank[s] * n / out[s]
        rank = new
    return rank


def test_hosts_against_brute_force(spark):
    a = lambda *to: "".join(f'<a href="{x}">t</a>' for x in to)
    rows = [
        (1, "http://Good.org/x?y#z", a("http://mid.net/1", "//MID.net/2", "/rel", "https://far.net")),
        (2, "https://example.org/en/12", a("http://good.org/")),
        (3, "https://sub.example.org/es/", "<img src='http://bad.com/de/i.png'>"),
        (4, "http://mid.net", a("http://far.net/a", "http://spam.net/")),
        (5, "http://spam.net/#f", a("http://www.bad.com/de/")),
        (6, "http://www.bad.com/de/x", None),
        (7, "http://far.net:80/p", a("http://far.net:80/q")),
        (8, None, "x"), (9, "no scheme", ""), (10, "http:///path", ""), (11, "ftp://x.com/fr/1", ""), (11, "ftp://x.com/fr/1", ""), (12, "http://y.com/de", None),
    ]
    df = spark.createDataFrame([(*r, "h", "v") for r in rows], "page_id long, url string, html string, host string, verdict string")
    got = hosts.judge(df).collect()

    def parts(u):
        if u is None or "://" not in u:
            return "", ""
        rest = u.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        return host.lower(), re.match(r"[^?#]*", rest[len(host) :])[0]

    fit, links, votes = {}, {}, {"allow": {}, "block": {}}
    for k, u, h in rows:
        host, path = parts(u)
        best = max(((len(r), r, v) for v, r in hosts.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])), default=None)
        fit[k] = (host, path, best)
        if best and host:
            votes[best[2]][host] = votes[best[2]].get(host, 0) + 1
        for d in re.findall(r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s<>]+)""", h or ""):
            if host and d.lower() != host:
                links[host, d.lower()] = links.get((host, d.lower()), 0) + 1
    share = {v: {h: n / sum(c.values()) for h, n in c.items()} for v, c in votes.items()}
    trust, distrust = brute_rank(links, share["allow"]), brute_rank({(d, s): n for (s, d), n in links.items()}, share["block"])
    assert len(got) == len(rows)
    for r in got:
        host, path, best = fit[r["page_id"]]
        verdict = best[2] if best else "block" if round(distrust.get(host, 0), 12) > round(trust.get(host, 0), 12) else "allow"
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, best and best[1], verdict)
        assert r["trust"] == pytest.approx(trust.get(host, 0), abs=1e-9) and r["distrust"] == pytest.approx(distrust.get(host, 0), abs=1e-9)
    by = {r["page_id"]: r["verdict"] for r in got}
    assert by[5] == "block" and by[7] == "allow"
    assert hosts.judge(df.limit(0)).collect() == []


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    good = got["quality"] == 1
    ranks = got["score"].rank()
    auc = (ranks[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.95 and got["predicted"][good].mean() > 0.97 and got["predicted"][~good].mean() < 0.3


def nn_risk(w, b, p, u, prior):
    """The non-negative risk by plain loops."""
    loss = lambda z: math.log1p(math.exp(-abs(z))) + max(0.0, -z)
    mean = lambda xs, sign: sum(loss(sign * (w * x + b)) for x in xs) / len(xs)
    return prior * mean(p, 1) + max(0.0, mean(u, -1) - prior * mean(p, -1))


def test_nnpu_against_brute_force():
    r = random.Random(8)
    for prior, far in ((0.5, 1.5), (0.3, 0.7), (0.8, 2.5)):
        p = [r.gauss(far, 1) for _ in range(120)]
        u = [r.gauss(far if r.random() < prior else -far, 1) for _ in range(240)]
        model = quality.fit_nnpu(np.array(p)[:, None], np.array(u)[:, None], prior, rounds=1500, decay=0.0)
        z = (np.array(u) - model.mean[0]) / model.scale[0]
        zp = (np.array(p) - model.mean[0]) / model.scale[0]
        assert np.abs(z).max() < 8 and np.abs(zp).max() < 8
        best = min(nn_risk(w / 4, b / 4, zp, z, prior) for w in range(-8, 33) for b in range(-16, 17))
        mine = nn_risk(model.weights[0], model.bias, zp, z, prior)
        assert mine <= best + 0.01, (prior, mine, best)
        parts = quality.risk(np.r_[model.weights, model.bias], zp[:, None], z[:, None], prior)
        assert parts[0] + max(0, parts[1]) == pytest.approx(mine)


def test_nnpu_stays_where_the_negative_part_would_go_below_zero():
    # five positives far from all unlabelled rows: the unbiased risk has no lower bound, as its second part falls below zero
    p, u = np.array([[3.0], [3.1], [2.9], [3.2], [3.05]]), np.linspace(-1, 1, 200)[:, None]
    model = quality.fit_nnpu(p, u, 0.9, rounds=800, decay=0.0)
    x = [quality._standard(a, model.mean, model.scale) for a in (p, u)]
    first, second = quality.risk(np.r_[model.weights, model.bias], *x, 0.9)
    assert second > -0.1 and first + max(0, second) < 0.3
    assert sum(quality.risk(np.array([40.0, -60.0]), *x, 0.9)) < -10


def test_nnpu_without_features_gives_the_prior():
    for prior in (0.2, 0.5, 0.85):
        model = quality.fit_nnpu(np.ones((50, 1)), np.ones((70, 1)), prior, rounds=2000, decay=0.0)
        assert model.score(np.ones((1, 1)))[0] == pytest.approx(prior, abs=0.01)


def test_prior_from_positives_and_unlabelled_alone():
    rng = np.random.default_rng(4)
    for share in (0.3, 0.6, 0.9):
        good = lambda n: rng.normal(1.5, 1, (n, 3))
        u = np.concatenate([good(int(3000 * share)), rng.normal(-1.5, 1, (3000 - int(3000 * share), 3))])
        assert quality.estimate_prior(good(2500), rng.permutation(u)) == pytest.approx(share, abs=0.06)


def test_quality_edges(spark):
    assert all(np.isfinite(quality.features(t)).all() and len(quality.features(t)) == quality.N_FEATURES for t in (None, "", " ", "x", "A!" * 400_000))
    kinds = "doc_id long, text string, score string", "doc_id long, quality int"
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "some words", "c"), (3, "some words", "c"), (None, "z", "d")], kinds[0])
    none = quality.classify(docs, spark.createDataFrame([], kinds[1])).collect()
    assert [r["score"] for r in none] == [0.5] * 5 and len(none) == 5
    some = quality.classify(docs, spark.createDataFrame([(1, 1), (2, None), (3, 0), (None, 1), (3, 0)], kinds[1])).collect()
    assert len(some) == 5 and all(0 <= r["score"] <= 1 for r in some)
    assert quality.classify(docs.limit(0), spark.createDataFrame([(1, 1)], kinds[1])).collect() == []


def test_small_ranks_are_compared_too(spark):
    link = lambda host, n=1: f'<a href="http://{host}/">' * n
    rows, to = [(0, "http://bad.com/de/", "")], "bad.com"
    for i in (1, 2, 3):  # of 20,001 links to a host, one comes from the next
        rows += [(i, f"http://h{i}.net/", link(to)), (10 + i, f"http://x{i}.net/", link(to, 20000))]
        to = f"h{i}.net"
    got = {r["page_id"]: r for r in hosts.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert 0 < got[3]["distrust"] < 5e-13 and got[3]["trust"] == 0
    assert {r["verdict"] for r in got.values()} == {"block"}
