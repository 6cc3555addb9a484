"""The pipeline's stages over odd rows: null, empty and very long texts, repeated keys, ties and columns with clashing names."""

import pytest

from trailhead.llm import bpe, jaccard, mixing, quality

#: Columns that documents have, and some whose names plans use inside.
KIND = "doc_id long, text string, lang string, source string, n_chars long, node string, __node string, row int, doc string, component_id double, score string, predicted string, features string, label string, size string, taken string, rank string, p string, n string, part string"
EXTRA = ("node", "73", 7, "doc", 0.5, "score", "predicted", "features", "label", "size", "taken", "rank", "p", "n", "part")


def words(seed, n):
    return " ".join(f"w{(seed * 7919 + i * i) % 9973}" for i in range(n))


ROWS = [(1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t", None, None), (4, words(1, 90), "en", "a"), (5, words(1, 90) + " more", "en", "a"), (6, words(2, 60), "en", "b"), (6, words(3, 60), "en", "b"), (6, words(3, 60), "en", "b"), (7, words(3, 60), None, "b"), (None, words(4, 50), "en", "c"), (None, words(4, 50), "en", "c"), (8, words(5, 60_000), "en", "c"), (9, "x" * 300_000, "en", "c")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, len(r[1] or ""), *EXTRA) for r in ROWS], KIND).withColumnRenamed("part", "a.b").repartition(3)


def keyed(df):
    return sorted(((r["doc_id"], len(r["text"] or "")) for r in df.collect()), key=str)


def whole(df, docs):
    """The other columns came along as they were."""
    assert df.columns == docs.columns and all(tuple(r)[5:] == EXTRA for r in df.collect())


def test_near_copies(docs):
    out = jaccard.keep_one(docs, k=5, percent=80)
    whole(out, docs)
    gone = [(5, len(ROWS[4][1])), (6, len(ROWS[7][1])), (7, len(ROWS[8][1]))]
    want = [(r[0], len(r[1] or "")) for r in ROWS]
    for g in gone:
        want.remove(g)
    assert keyed(out) == sorted(want, key=str)


def test_quality(spark, docs):
    labels = spark.createDataFrame([(4, 1, 0, "s"), (6, 0, 0, "s"), (8, 1, 0, "s"), (9, 0, 1, "s"), (1, 0, 0, "s")], "doc_id long, quality int, toxic int, score string")
    out = quality.keep_good(docs, labels)
    whole(out, docs)
    want = keyed(docs)
    for r in keyed(out):
        want.remove(r)  # nothing new, nothing twice


def test_mixing(docs):
    out = mixing.apply_mix(docs)
    whole(out, docs)
    assert {r[0] for r in keyed(out)} <= {r[0] for r in keyed(docs)} and {1, 2} <= {r[0] for r in keyed(out)}  # a source without words has no target


def test_encoding(docs):
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    out = bpe.encode(docs, path, pattern, cache=1 << 20)
    assert out.columns == [c for c in docs.columns if c != "text"] + ["bpe_ids", "n_tokens"]
    got = sorted(((r["doc_id"], r["n_tokens"], r["a.b"]) for r in out.collect()), key=str)
    codec = bpe.Codec.load(path, pattern)
    want = sorted(((r["doc_id"], len(codec.encode_batch([r["text"] or ""])[0]) // 4, "part") for r in docs.collect()), key=str)
    assert got == want


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (jaccard.keep_one(none, k=5, percent=80), quality.keep_good(none, labels), mixing.apply_mix(none)):
        assert out.collect() == [] and out.columns == docs.columns
