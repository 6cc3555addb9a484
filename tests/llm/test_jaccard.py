import random
import re

from trailhead.llm.jaccard import keep_one, set_components
from trailhead.llm.textops import runs, shingle_set, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def brute(rows, k=4, percent=85):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        low[r] = d if low.get(r) is None else low[r] if d is None else min(low[r], d)
    return sorted(((d, len(s), d if not s else low[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def got(df, **how):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in set_components(df, **how).collect()), key=str)


def corpus(seed, n=260):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(900)]
    line, passage = [r.choice(vocab) for _ in range(14)], [r.choice(vocab) for _ in range(60)]
    texts = [[r.choice(vocab) for _ in range(r.randint(1, 120))] for _ in range(n // 2)]
    for t in list(texts)[: n // 4]:
        t[:0] = line
        if r.random() < 0.5:
            t += passage
    while len(texts) < n:
        t = list(r.choice(texts))
        for _ in range(r.choice([0, 1, 1, 2, 4, 8])):
            i = r.randrange(len(t))
            t[i : i + 1] = r.choice([[r.choice(vocab)], [], [r.choice(vocab), t[i]]])
            t = t or ["x"]
        texts.append(t)
    chain = [r.choice(vocab) for _ in range(100)]
    for i in range(60):  # each links to the next few, the ends don't link
        chain = chain[1:] + [r.choice(vocab)]
        texts.append(list(chain))
    r.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_words_like_the_pattern():
    for t in ["", " ", "a", " A b\x0bc\x1fd  ", "É ß x y", "x" * 50, "Ab aB ab"]:
        assert len(word_hashes(t)) == len(WORD.findall(t))
    a, b = word_hashes("Foo foo"), word_hashes("bar foo FOO x")
    assert a[0] == a[1] == b[1] == b[2] != b[0]
    long = ("word " * 300_000 + "y" * 1_200_000 + " tail")
    assert len(word_hashes(long)) == 300_002 and len(shingle_set(long, 4)) == len(shingles(long, 4))
    assert len(runs(word_hashes("a b"), 4)) == 1 and shingle_set("a b", 4)[0] != shingle_set("a b c", 4)[0]


def test_components_against_brute_force(spark):
    for seed, k, percent in ((1, 4, 85), (2, 5, 80)):
        rows = corpus(seed)
        df = spark.createDataFrame([(d, t, "x", 3) for d, t in rows], "doc_id long, text string, node string, s int")
        assert got(df, k=k, percent=percent) == brute(rows, k, percent)


def test_long_lists_and_groups(spark, monkeypatch):
    from trailhead.llm import jaccard

    monkeypatch.setattr(jaccard, "LONG", 4)  # most lists are long: the recounted index must find what the short ones leave
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == brute(rows)


def test_edges_of_components(spark):
    kind = "doc_id long, text string"
    assert got(spark.createDataFrame([], kind)) == []
    rows = [(5, None), (6, ""), (7, " \t"), (8, "a b"), (9, "A  b"), (10, "a b c"), (None, "one two three four five"), (3, "one two three four five"), (3, "zz yy xx ww vv"), (4, "zz yy xx ww vv"), (None, "q"), (None, "q"), (11, "x " * 40000), (12, "x " * 3)]
    assert got(spark.createDataFrame(rows, kind)) == brute(rows)


def test_keep_one(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (3, "g h i j k"), (3, "g h i j k"), (4, None), (5, ""), (None, "m n"), (None, "m n")]
    df = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, source string")
    out = sorted(((r["doc_id"], r["text"]) for r in keep_one(df).collect()), key=str)
    assert out == sorted([(1, "a b c d e f"), (3, "g h i j k"), (4, None), (5, ""), (None, "m n"), (None, "m n")], key=str)
    assert keep_one(df).columns == df.columns


def test_truncated_copies_link_where_their_reference_does_not(spark):
    rows = []
    for seed in range(24):  # the reference is the smallest hash: A in about one case of three
        w = [f"s{seed}w{i}" for i in range(115)]
        a = w[:103]
        rows += [a, a[:93], a[:91] + w[103:]]
    rows = [(i, " ".join(t)) for i, t in enumerate(rows)]
    want = brute(rows)
    assert all(c == d - d % 3 for d, _, c in want)
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == want


def test_shingles_alone_in_the_crowd_may_be_the_reference_s(spark):
    from trailhead.llm.jaccard import _candidates

    index = spark.createDataFrame([(7, 1, 100, 0, 0, True, 5), (7, 2, 100, 0, 0, True, 5), (7, 3, 100, 0, 0, True, 0)], "s long, node long, n int, pos int, h int, stays boolean, alone int")
    ref = spark.createDataFrame([(1, 11, 5, None), (2, 12, 5, True)], "node long, ref long, extra int, inside boolean")
    comp = spark.createDataFrame([(1, 1), (2, 2)], "node long, root long")
    e = {r[f"ref{i}"]: r[f"e{i}"] for r in _candidates(index, ref, comp, 85, 0).collect() for i in (1, 2)}
    assert e == {11: 5, 12: 0, 3: 0}


def test_keep_one_of_repeated_keys_with_different_texts(spark):
    a, b, c, d = "a b c d e f", "g h i j k", "m n o p q r", "s t u v w x"
    rows = [(1, a), (2, a), (2, b), (2, b), (3, c), (3, d), (4, d), (5, None), (5, a), (6, b)]
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    out = keep_one(df)
    assert out.columns == df.columns
    # (2, a) is a copy of 1; keys 2 and 3 keep their other texts
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted([(1, a), (2, b), (3, c), (3, d), (5, None)], key=str)


def test_tables_go_when_no_later_step_reads_them(spark, monkeypatch):
    from trailhead.llm import jaccard

    made, alive, cut = [], {}, jaccard.cut

    def there(path):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)

    def noted(df, name="cut"):
        out = cut(df, name)
        made.append((name, out.cut_path))
        alive.setdefault(name, set()).update(n for n, path in made if there(path))
        return out

    monkeypatch.setattr(jaccard, "cut", noted)
    rows = corpus(1)
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    assert {"jj-heads", "jj-index"} <= alive["jj-index"] and "jj-pairs" in alive
    assert "jj-heads" not in alive["jj-refs"] | alive["jj-pairs"]
    assert "jj-compared" not in alive["jj-pairs"] and not any(there(path) for name, path in made if name in ("jj-heads", "jj-index", "jj-compared"))


def test_short_lists_are_shuffled_once(spark):
    from trailhead.llm.jaccard import _candidates

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        # sizes a block apart, and two blocks apart
        index = spark.createDataFrame([(s, node, n, 0, 0, True, 0) for s in range(30) for node, n in ((1, 100), (2, 110), (3, 150))], "s long, node long, n int, pos int, h int, stays boolean, alone int")
        ref = spark.createDataFrame([], "node long, ref long, extra int, inside boolean")
        out = _candidates(index, ref, spark.createDataFrame([], "node long, root long"), 85)
        assert [tuple(r) for r in out.collect()] == [(1, 2, 100, 110, 0, 0)]
        plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning(s#" in x and "ReusedExchange" not in x]
        assert dealt and not any("block" in x for x in dealt)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
