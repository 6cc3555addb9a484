import random

import numpy as np

from trailhead.llm import periodic

KIND = "doc_id long, text string, runs int, collapsed double, words string, n int, ab string"


def brute(words):
    """Runs of at least 6 words and 4 periods by comparing all words that are a period apart."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q) and not any(q % p == 0 and s <= i and s + m >= i + length for s, m, p in found):
                found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    return b" ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs))


def samples():
    r = random.Random(11)
    out = [[], [b"a"], [b"a"] * 5, [b"a"] * 6, [b"a"] * 400, [b"a", b"b"] * 4, ([b"a"] * 7 + [b"b"]) * 5, [b"x", *[b"a", b"b", b"a"] * 9, b"y"] * 6]
    for n in (8, 12, 30, 90, 200):
        for letters in (b"ab", b"abc", b"abcdefgh"):
            out += [[bytes([r.choice(letters)]) for _ in range(n)] for _ in range(12)]
    for _ in range(60):
        t = []
        while len(t) < 150:
            block = [bytes([r.choice(b"abcdef")]) for _ in range(r.randint(1, 9))]
            t += (block * r.randint(1, 7))[: r.randint(1, 60)]
        out.append(t)
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 1500:
        a, b = b, b + a
    return [*out, b, b * 3, [b"w%d" % (i % 501) for i in range(3000)]]


def test_runs_by_brute_force():
    texts = samples()
    got = periodic.find(texts)
    for t, found in zip(texts, got, strict=True):
        want = brute(t)
        assert found == want, (t, found, want)
        assert periodic.collapse(t, found) == collapsed(t, want)


def test_all_squares_of_small_rows():
    """The method itself, without the parts being chosen first: all runs of two periods or more."""
    r = random.Random(5)
    for _ in range(400):
        row = np.array([r.randint(0, r.choice((1, 2, 4))) for _ in range(r.randint(1, 60))] + [99], np.int64)
        n, want = len(row), set()
        for q in range(1, n // 2 + 1):
            i = 0
            while i + q < n:
                j = i
                while j + q < n and row[j] == row[j + q]:
                    j += 1
                if j - i >= q and not any(q % p == 0 and s <= i and s + m >= j + q for s, m, p in want):
                    want.add((i, j - i + q, q))
                i = j + 1
        got = set(zip(*[x.tolist() for x in periodic.runs_of(row, n)], strict=True))
        assert got == want, (row, got ^ want)


def test_find_runs_over_odd_tables(spark):
    long = " ".join(["word", "other", "third"] * 60_000)
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a a a a a a a"), (4, "x  a\x0bb a b\na b  a b y"), (4, "x  a\x0bb a b\na b  a b y"), (5, "no run"), (6, long)]
    docs = spark.createDataFrame([(*r, 3, 0.5, "w", 9, "z") for r in rows], KIND).withColumnRenamed("ab", "a.b")
    got = periodic.find_runs(docs).collect()
    assert got[0].asDict().keys() == {"doc_id", "words", "n", "a.b", "runs", "collapsed"} and len(got) == len(rows)
    for (key, text), r in zip(rows, got, strict=True):
        words = (text or "").encode().split()
        want = brute(words) if key != 6 else [(0, 180_000, 3)]
        assert (r["doc_id"], r["a.b"], [tuple(x) for x in r["runs"]]) == (key, "z", want)
        assert r["collapsed"] == ("word other third" if key == 6 else collapsed(words, want).decode())
    assert periodic.find_runs(docs.limit(0)).collect() == []
