import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trailhead.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def texts():
    r = random.Random(7)
    letters = "aB'sStT lĹé̀ Σσςİﬁ日1½\x1c\x85\xa0🙂\n\t\x0b\r​　ÅÅ"
    out = [None, "", " \n", "don't 'll", "<|endoftext|> a<|startoftext|>", "x" * 5000, "word other " * 4000, "Ünter élan ÿ ª µ ßtraße " * 9]
    return out + ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(400)]


def fewest(sizes, capacity):
    """The optimum by trying every place for each piece."""
    sizes = sorted(sizes, reverse=True)
    best = len(sizes)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for j, room in enumerate(bins):
            if room >= sizes[i] and room not in bins[:j]:
                place(i + 1, [*bins[:j], room - sizes[i], *bins[j + 1 :]])
        place(i + 1, [*bins, capacity - sizes[i]])

    place(0, [])
    return best


def check(rows, capacity):
    """Sequences are gapless from 0 and within the capacity; how many there are."""
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for found in by.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pieces_are_the_library_s(spark, library):
    docs = spark.createDataFrame([(i, t, "q", 4) for i, t in enumerate(texts())], "doc_id long, text string, ids string, ab int").withColumnRenamed("ab", "a.b")
    got = {}
    for r in packing.pieces(docs, PATH, 64).collect():
        assert r["a.b"] == 4 and r["length"] * 4 == len(r["ids"]) and r["start"] == r["piece"] * 64
        got.setdefault(r["doc_id"], []).append((r["piece"], bytes(r["ids"])))
    for i, t in enumerate(texts()):
        want = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        pieces = sorted(got[i])
        assert [p for p, _ in pieces] == list(range(-(-len(want) // 64))) and all(len(x) == 256 for _, x in pieces[:-1])
        assert np.frombuffer(b"".join(x for _, x in pieces), "<u4").tolist() == want
    assert packing.pieces(docs.limit(0), PATH).collect() == []


def test_small_cache(library, monkeypatch):
    monkeypatch.setattr(packing, "KEPT", 50)
    coder = packing.Encoder(PATH)
    for _ in range(2):
        for t in texts():
            assert np.frombuffer(coder.encode([t, "tail"])[0], "<u4").tolist() == library.encode(t or "", add_special_tokens=False).ids


def test_bounds_and_best_fit_hold():
    r = random.Random(3)
    for _ in range(300):
        capacity = r.choice((7, 10, 12, 20))
        sizes = np.array([r.randint(1, capacity) for _ in range(r.randint(1, 9))], np.int64)
        which, offset, free = packing.best_fit(sizes, capacity)
        best = fewest(sizes.tolist(), capacity)
        bound = packing._least(packing.lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity))
        assert bound <= best <= len(free) <= -(-3 * best // 2)
        used = np.bincount(which, sizes).astype(int)
        assert (used + free == capacity).all() and check([{"sequence_id": w, "offset": o, "length": s} for w, o, s in zip(which.tolist(), offset.tolist(), sizes.tolist(), strict=True)], capacity) == len(free)
        better = packing.packed_group(sizes, capacity)
        assert bound <= len(better[2]) <= len(free) and check([{"sequence_id": w, "offset": o, "length": s} for w, o, s in zip(better[0].tolist(), better[1].tolist(), sizes.tolist(), strict=True)], capacity) == len(better[2])
        assert len(better[2]) == best or bound < best
    # a bound that the sum of lengths doesn't give
    assert packing.lower_bound(np.bincount([6] * 5, minlength=11), 10) == 5


def test_exchange_reaches_the_bound(spark):
    r = random.Random(1)
    sizes = [min(2048, max(1, int(r.lognormvariate(6, 1)))) for _ in range(4000)]
    items = spark.createDataFrame([(i, s, "k", 1) for i, s in enumerate(sizes)], "doc_id long, length long, row string, part int").repartition(5)
    got = packing.pack(items, group=300).collect()
    assert sorted(x["doc_id"] for x in got) == list(range(4000)) and got[0]["row"] == "k"
    assert check(got, 2048) <= packing._least(packing.lower_bound(np.bincount(sizes, minlength=2049), 2048)) + 2
    once = packing.pack(items, group=300, rounds=1).collect()
    assert check(once, 2048) > check(got, 2048)


def test_odd_rows(spark):
    kind = "length long, sequence_id string, offset int, free int"
    items = spark.createDataFrame([(None, "", 1, 1), (0, "", 1, 1), (-3, "", 1, 1), (11, "", 1, 1), (10, "", 1, 1), (4, "", 1, 1), (4, "", 1, 1), (6, "", 1, 1), (6, "", 1, 1)], kind)
    got = packing.pack(items, capacity=10).collect()
    assert sorted((r["length"] for r in got if r["sequence_id"] is None), key=str) == [-3, 0, 11, None]
    assert check([r for r in got if r["sequence_id"] is not None], 10) == 3
    assert packing.pack(items.limit(0)).collect() == []
    big = spark.createDataFrame([(6, "", 1, 1)] * 40, kind)
    assert check(packing.pack(big, capacity=10, group=7).collect(), 10) == 40


def test_query(spark, library):
    from trailhead.llm.queries import op11_packing

    sf = "/root/testdata/sf0.001"
    rows = op11_packing(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert check(rows, 2048) <= -(-sum(r["length"] for r in rows) // 2048) + 1
    got = {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows}
    want = {}
    for d in docs:
        ids = [*library.encode(d["text"] or "", add_special_tokens=False).ids, 0]
        for p in range(-(-len(ids) // 2048)):
            part = ids[p * 2048 : (p + 1) * 2048]
            want[d["doc_id"], p] = (p * 2048, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert got == want and len(rows) == len(want)
