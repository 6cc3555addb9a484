"""Committed tables and the stored index."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trailhead.operators import fts
from trailhead.operators.text_index import HELD, TextIndex, _posting_batches, plan_of, plans_of
from trailhead.sources.snapshots import BucketTable, Conflict, scratch_table

KIND = "k string, v long, more array<int>"


def files_of(table):
    return {f for f in table.frame().inputFiles()}


def test_upserts_touch_only_their_buckets(spark):
    t = BucketTable(spark, scratch_table(spark, "t"), KIND, "k", buckets=8)
    assert t.frame().collect() == [] and t.snapshots.number() == -1
    t.apply(spark.createDataFrame([(f"k{i}", i, [i]) for i in range(40)] + [(None, 1, None)], KIND))
    before = files_of(t)
    t.apply(spark.createDataFrame([("k3", 300, None), ("k3", 299, None), ("new", 1, None)], KIND), spark.createDataFrame([("k4",), ("absent",), ("k3",)], "k string"))
    got = {r["k"]: r["v"] for r in t.frame().collect()}
    assert got == {f"k{i}": i for i in range(40) if i not in (3, 4)} | {"k3": 300, "new": 1}
    kept = before & files_of(t)
    assert kept and kept != before
    # the state before is still there, until it is vacuumed
    assert {r["k"]: r["v"] for r in t.frame(0).collect()}["k3"] == 3
    assert t.vacuum() and {r["k"]: r["v"] for r in t.frame().collect()} == got
    t.apply(None, spark.createDataFrame([(k,) for k in got], "k string"))
    assert t.frame().collect() == [] and t.snapshots.number() == 2


def test_failed_and_late_writes_change_nothing(spark):
    t = BucketTable(spark, scratch_table(spark, "t"), KIND, "k", buckets=4)
    t.apply(spark.createDataFrame([("a", 1, None)], KIND))
    broken = spark.range(5).select(F.concat(F.lit("k"), "id").alias("k"), F.when(F.col("id") == 3, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("long").alias("v"), F.lit(None).cast("array<int>").alias("more"))
    with pytest.raises(Exception, match="broken"):
        t.apply(broken)
    assert [tuple(r) for r in t.frame().collect()] == [("a", 1, None)]
    with pytest.raises(Conflict):
        t.snapshots.commit({"buckets": {}}, after=-1)
    assert [tuple(r) for r in t.frame().collect()] == [("a", 1, None)] and t.snapshots.names(f"{t.path}/states") == ["0.json"]


WORDS = "alpha beta gamma delta menu the café licence license licences".split()


def chunk(path, n, text):
    return (f"{path}:{n}", path, f"sym_{n}", text, "block")


def tree(seed, n=30):
    r = random.Random(seed)
    return {f"src/{'en' if i % 2 else 'de'}/f{i}.txt": [" ".join(r.choice(WORDS) for _ in range(r.randint(0, 30))) for _ in range(r.randint(0, 3))] for i in range(n)}


def build(spark, index, files):
    df = spark.createDataFrame([(p, str(c), c) for p, c in files.items()], "file_path string, content_hash string, parts array<string>")

    def chunks_of(some):
        e = some.select("file_path", F.posexplode("parts").alias("n", "content"))
        return e.select(F.concat_ws(":", "file_path", "n").alias("chunk_id"), "file_path", F.concat(F.lit("sym_"), "n").alias("symbol_name"), "content", F.lit("block").alias("symbol_kind"))

    return index.build(df, chunks_of), chunks_of(df)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_index_equals_a_scan_through_changes(spark):
    index = TextIndex(spark, scratch_table(spark, "ix"), buckets=8)
    q = spark.createDataFrame([(1, ["alpha", "menu"]), (2, ["license"]), (3, ["en", "cafe"]), (4, ["absent"]), (5, ["alpha", "alpha"])], "query_id int, terms array<string>")
    one, two = tree(1), tree(1) | {k: v for k, v in tree(2, 9).items()} | {"src/en/new.txt": ["alpha menu alpha"]}
    del two["src/en/f11.txt"]
    report, chunks = build(spark, index, one)
    assert report == {"files_new": 30, "files_updated": 0, "files_removed": 0, "total_chunks": chunks.count()}
    assert rows(index.bm25(q)) == rows(fts.bm25(chunks, q))
    stored = set(index.snapshots.names(f"{index.path}/postings"))
    report, chunks = build(spark, index, two)
    assert (report["files_new"], report["files_removed"], report["total_chunks"]) == (1, 1, chunks.count()) and 0 < report["files_updated"] <= 9
    assert stored < set(index.snapshots.names(f"{index.path}/postings"))  # a delta beside what was there
    want = rows(fts.bm25(chunks, q))
    assert rows(index.bm25(q)) == want
    assert build(spark, index, two)[0]["files_updated"] == 0
    index.compact()
    index.vacuum()
    assert rows(index.bm25(q)) == want and len(index.snapshots.names(f"{index.path}/postings")) == 1
    report, chunks = build(spark, index, {})
    assert report["total_chunks"] == 0 and index.bm25(q).collect() == [] and index.search(spark.createDataFrame([(1, "alpha")], "query_id int, query string")).collect() == []


def test_stemmed_index(spark):
    index = TextIndex(spark, scratch_table(spark, "ix"), buckets=4, stem=True)
    _, chunks = build(spark, index, tree(3))
    q = spark.createDataFrame([(1, ["licensing", "menus"]), (2, ["licences"])], "query_id int, terms array<string>")
    assert rows(index.bm25(q)) == rows(fts.bm25(chunks, q, stem=True)) != []


def test_a_search_reads_only_its_buckets(spark):
    index = TextIndex(spark, scratch_table(spark, "ix"), buckets=8)
    build(spark, index, tree(1))
    plan = index.postings(buckets=[3])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (= 3|IN \(3\))", plan), plan


def holds(query, text, path):
    """Whether a chunk matches, by reading the query with Python's own operators over its tokens."""
    fields = {"content": text, "file_path": path, "symbol_name": None, "symbol_kind": "block"}
    tokens = {f: fts.query_words(t or "") for f, t in fields.items()}

    def leaf(field, words, begun):
        def at(t, i):
            return t[i : i + len(words)] == words if not begun else t[i : i + len(words) - 1] == words[:-1] and i + len(words) <= len(t) and t[i + len(words) - 1].startswith(words[-1])

        return any(at(t, i) for f, t in tokens.items() if field in (None, f) for i in range(len(t)))

    def walk(tree, field):
        if tree[0] in ("and", "or"):
            return (all if tree[0] == "and" else any)(walk(t, field) for t in tree[1:])
        if tree[0] == "not":
            return walk(tree[1], field) and not any(walk(t, field) for t in tree[2:])
        if tree[0] == "in":
            return walk(tree[2], tree[1])
        return leaf(tree[1] or field, tree[2] if tree[0] == "phrase" else fts.query_words(tree[2]), tree[0] == "prefix")

    return walk(fts.Parser(query).parse(), None)


QUERIES = ["alpha", "alpha beta", "alpha OR menu", '"alpha beta"', '"the license gamma"', "lic*", "licence*", "alpha NOT (beta OR gamma)", "content:(alpha menu) NOT the", "file_path:en AND beta", 'content:"menu the" OR delta', "CAFÉ", "(alpha OR beta) (gamma OR delta) NOT menu", 'alpha NOT "beta gamma"', "file_path:src beta NOT lic*", "l*", "absent OR alpha", "absent*"]


def test_search_strings_by_brute_force(spark):
    index = TextIndex(spark, scratch_table(spark, "ix"), buckets=8)
    files = tree(5, 40)
    build(spark, index, files)
    q = spark.createDataFrame([(i, x) for i, x in enumerate([*QUERIES, "(alpha", "AND", "%%"])], "query_id int, query string")
    got = {(r["query_id"], r["chunk_id"]) for r in index.search(q, k=None).collect()}
    want = {(i, f"{p}:{n}") for i, x in enumerate(QUERIES) for p, parts in files.items() for n, t in enumerate(parts) if holds(x, t, p)}
    assert got == want and len({i for i, _ in want}) > 12
    top = index.search(q, k=2).collect()
    assert max(r["place"] for r in top) == 2 and all(r["score"] <= 0 for r in top)
    assert {r["query_id"] for r in plans_of(q).where("error is not null").collect()} == {len(QUERIES), len(QUERIES) + 1, len(QUERIES) + 2}


def test_plans_are_bounded():
    assert plan_of("a b") == ([(0, "term", None, ["a"]), (1, "term", None, ["b"])], [(3, 0)])
    assert plan_of("a NOT a")[1] == []
    for bad in (" ".join(f"w{i}" for i in range(70)), " ".join(f"(a{i} OR b{i})" for i in range(12))):
        with pytest.raises(ValueError):
            plan_of(bad)


def test_postings_leave_in_small_batches():
    names = ["path", "content"]
    lists = [[f"w{j % (90 + i % 7)}" for j in range(1000)] for i in range(400)]
    chunks = pa.RecordBatch.from_arrays([pa.array([f"c{i}" for i in range(400)]), pa.array([f"f{i}" for i in range(400)]), pa.array([["f"]] * 400), pa.array(lists)], ["chunk_id", "file_path", *names])
    got = list(_posting_batches(iter([chunks]), names))
    assert len(got) > 5 and max(b.num_rows + len(b.column("positions").flatten()) for b in got) < HELD + 1200
    rows = [r for b in got for r in b.to_pylist()]
    assert len(rows) == 400 * 2 + sum(len(set(x)) for x in lists) and {r["dl"] for r in rows} == {1001}
    assert [r["positions"] for r in rows if r["chunk_id"] == "c3" and r["term"] == "w5"] == [[j for j, w in enumerate(lists[3]) if w == "w5"]]


def test_chunk_counts_shuffle_no_postings(spark):
    rows = [("a", "f", "x x y"), ("b", "f", "y"), ("b", "g", "y z"), ("c", "h", "")]
    chunks = spark.createDataFrame(rows, "chunk_id string, file_path string, content string")
    assert {tuple(r) for r in fts.term_totals(chunks).collect()} == {("x", 2, 1), ("y", 3, 2), ("z", 1, 1), ("f", 2, 2), ("g", 1, 1), ("h", 1, 1)}
    sizes = {("a", "file_path", 1, 1, 1), ("a", "content", 2, 3, 2), ("b", "file_path", 2, 2, 1), ("b", "content", 2, 3, 2), ("c", "file_path", 1, 1, 1)}
    assert {tuple(r) for r in fts.field_sizes(chunks).collect()} == sizes
    plan = fts.field_sizes(chunks.where("file_path <> 'g'"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_blocks_give_back_their_postings(monkeypatch):
    from trailhead.operators import text_index

    monkeypatch.setattr(text_index, "HELD", 1000)
    monkeypatch.setattr(text_index, "BLOCK", 3000)
    r, names = random.Random(4), ["path", "content"]
    texts = [[r.choice(WORDS) for _ in range(r.randint(0, 60))] for _ in range(300)] + [["far"] * 20_000]
    chunks = pa.RecordBatch.from_arrays([pa.array([f"c{i}" for i in range(301)]), pa.array([f"f{i // 2}" for i in range(301)]), pa.array([["src", f"p{i}"] for i in range(301)]), pa.array(texts)], ["chunk_id", "file_path", *names])
    given = list(_posting_batches(iter([chunks]), names))
    packed = list(text_index._packed_batches(iter(given), 7))
    assert [b["block"][0].as_py() for b in packed] == list(range(7, 7 + len(packed))) and len(packed) > 3
    sent = [text_index._received(*text_index._sent(b)) for b in packed]
    blocks = [text_index._Block([b.slice(0, 1).select(["chunks"]), b.slice(1).select(["term", "field", "n", "data"])]) for b in sent]
    flat = lambda batches: sorted((x["term"], x["chunk_id"], x["field"], x["file_path"], x["dl"], x["tf"], x["positions"]) for b in batches for x in b.to_pylist())
    assert flat(p for b in blocks for p in b.postings()) == flat(given)
    # a chunk counts once for a term, in whatever fields it holds it
    df = sum(x["df"] for b in packed for x in b.to_pylist() if x["term"] == "src")
    assert df == 301


def bytes_in(spark, folder):
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def test_an_index_takes_few_bytes_a_token(spark):
    """A posting carries no chunk id, and what is shuffled is packed."""
    r = random.Random(6)
    words = [f"{r.choice(WORDS)}{i}" for i in range(3000)]
    text = lambda: " ".join(words[min(2999, int(r.paretovariate(0.4)))] for _ in range(r.randint(100, 500)))
    files = {f"src/en/some/longer/path/file{i}.txt": [text()] for i in range(1500)}
    index = TextIndex(spark, scratch_table(spark, "ix"), buckets=4)
    build(spark, index, files)
    assert bytes_in(spark, f"{index.path}/postings") < 5 * index.state()["tokens"]


def test_searches_in_passes(spark, monkeypatch):
    """More words than a pass holds, and more terms than are broadcast: the same rows."""
    from trailhead.operators import text_index

    index = TextIndex(spark, scratch_table(spark, "ix"), buckets=8)
    build(spark, index, tree(5, 40))
    build(spark, index, tree(6, 30))  # some chunks are dead
    q = spark.createDataFrame(list(enumerate(QUERIES)), "query_id int, query string")
    terms = spark.createDataFrame([(1, ["alpha", "menu"]), (2, ["the"]), (3, ["alpha", ""]), (4, ["beta", None])], "query_id int, terms array<string>")
    want, best = rows(index.search(q, k=None)), rows(index.bm25(terms))
    monkeypatch.setattr(text_index, "SMALL", 7)
    assert rows(index.search(q, k=None)) == want != [] and rows(index.bm25(terms)) == best and {x[0] for x in best} <= {1, 2}


def test_chunks_without_an_id_count_as_none(spark):
    """As count(DISTINCT chunk_id) has it; their tokens are counted, and chunks of one id are one."""
    for rows_, want in (([(None, "x y x"), ("a", "x")], {("x", 3, 1), ("y", 1, 0)}), ([(None, "x"), (None, "x y"), ("a", "x"), ("a", "y x")], {("x", 4, 1), ("y", 2, 1)})):
        assert {tuple(r) for r in fts.term_totals(spark.createDataFrame(rows_, "chunk_id string, content string")).collect()} == want


def test_few_queries_by_text_store_no_encodings(spark, monkeypatch):
    from trailhead.operators import vectors
    from trailhead.operators.graph import shared_dir
    from trailhead.sources.snapshots import Snapshots

    r = random.Random(8)
    texts = [" ".join(r.choice(WORDS) for _ in range(r.randint(0, 6))) for _ in range(1200)]
    chunks = spark.createDataFrame([(f"c{i % 1100}", t) for i, t in enumerate(texts)] + [("none", None)], "chunk_id string, content string").repartition(5)
    queries = spark.createDataFrame([(i, t) for i, t in enumerate(texts[::100])] + [(99, None), (100, "")], "query_id long, text string")
    there = lambda: {n for n in Snapshots(spark, shared_dir(spark)).names(f"{shared_dir(spark)}/trailhead") if n.startswith("encoded-")}
    before = there()
    few = rows(vectors.semantic(chunks, queries, k=7))
    assert there() == before and len(few) == 7 * 14
    monkeypatch.setattr(vectors, "FEW_QUERIES", 3)
    assert rows(vectors.semantic(chunks, queries, k=7)) == few


def test_totals_are_of_stems(spark):
    """The index's tokenizer is unicode61 and porter; a chunk with two words of a stem counts once for it, also where its id is repeated."""
    for ids in ("abc", "aac"):
        df = spark.createDataFrame([(ids[0], "licensing licensed café"), (ids[1], "Licenses the cafe"), (ids[2], "running runs")], "chunk_id string, content string")
        n = 2 if ids == "abc" else 1
        assert {tuple(r) for r in fts.term_totals(df).collect()} == {("licens", 3, n), ("cafe", 2, n), ("the", 1, 1), ("run", 2, 1)}
