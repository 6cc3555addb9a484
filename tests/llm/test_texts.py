import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from trailhead.llm import bpe, lengths, licenses

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def reference():
    codec = bpe.Codec.load(PATH, PATTERN)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def texts():
    r = random.Random(4)
    letters = " \n\tabcdeFG'!?é日1½\x1c\x85\xa0 🙂"
    out = ["", " ", "  a", "it's  a\n\n b\t", "a \n b", "don't 'll", "x" * 3000, "ab" * 1500 + " " + "é" * 200, "<|endoftext|>", "Ĥello wörld " * 50, None]
    return out + ["".join(r.choice(letters) for _ in range(r.randint(0, 70))) for _ in range(600)]


def test_encoding_is_the_library_s(spark, reference):
    rows = [(i, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame([(i, t, 1, "y") for i, t in rows], "doc_id long, text string, n_tokens int, bpe_ids string")
    got = {r["doc_id"]: r for r in bpe.encode(df, PATH, PATTERN).collect()}
    digest = {r["doc_id"]: r for r in bpe.digests(df, PATH, PATTERN).collect()}
    back = {r["doc_id"]: bytes(r["bpe_bytes"]) for r in bpe.decode(bpe.encode(df, PATH, PATTERN), PATH, PATTERN).collect()}
    for i, t in rows:
        want = np.array(reference.encode_ordinary(t or ""), "<u4").tobytes()
        assert bytes(got[i]["bpe_ids"]) == want and got[i]["n_tokens"] == digest[i]["n_tokens"] == len(want) // 4
        assert back[i] == (t or "").encode()
        assert digest[i]["ids_sha256"] == hashlib.sha256(want).hexdigest() and digest[i]["decoded_sha256"] == hashlib.sha256(back[i]).hexdigest()
    assert bpe.encode(df.limit(0), PATH, PATTERN).collect() == []


def test_small_cache(reference):
    codec = bpe.Codec(bpe.Codec.load(PATH, PATTERN).ranks, PATTERN, cache=600)
    for _ in range(3):
        for t in texts()[:40]:
            assert codec.encode_batch([t or "", "tail " + (t or "")])[0] == np.array(reference.encode_ordinary(t or ""), "<u4").tobytes()


def test_patterns_whose_matches_span_blanks():
    ranks = bpe.Codec.load(PATH, PATTERN).ranks
    for pattern in (r"[a-z]+ [a-z]+|\s+|\S+?", r"[^b]+|b"):
        codec, library = bpe.Codec(ranks, pattern), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for t in ("ab cd ef gh", " the of in", "x y  z", "b b", "one two three four" * 9):
            assert codec.encode_batch([t])[0] == np.array(library.encode_ordinary(t), "<u4").tobytes()


def test_long_texts_in_chunks(reference):
    codec = bpe.Codec.load(PATH, PATTERN)
    text = ("word, it's  two\n blank é" * 40 + " ") * 2500
    assert len(text) > 2 << 20 and len(list(bpe.chunks(text))) > 1 and "".join(bpe.chunks(text)) == text
    assert codec.encode_batch([text, "short"]) == [np.array(reference.encode_ordinary(t), "<u4").tobytes() for t in (text, "short")]
    for t in ("a b c d e f", "  a  b ", "x" * 9, " ", "", "a\u3000 b c"):
        assert "".join(bpe.chunks(t, 2)) == t
        assert b"".join(codec.encode_batch(list(bpe.chunks(t, 2)))) == np.array(reference.encode_ordinary(t), "<u4").tobytes()


def test_long_and_short_trees_agree():
    codec, r = bpe.Codec.load(PATH, PATTERN), random.Random(1)
    for _ in range(300):
        data = bytes(r.choice(b"abcetaoin shrdlu\xc3\xa9") for _ in range(r.randint(1, 32)))
        assert codec.merge_short([data])[0] == np.array(codec.merge_long(data), "<u4").tobytes()


def test_lengths_answer_every_limit(spark, reference):
    rows = [t for t in texts() for _ in range(2)]
    n = [len(reference.encode_ordinary(t or "")) for t in rows]
    df = spark.createDataFrame([(t,) for t in rows], "text string")
    sums = lengths.suffix_sums(lengths.histogram(df, PATH, PATTERN), step=8)
    for r in sums.collect():
        c = r["n_tokens"]
        assert r["n_docs"] == n.count(c) and r["docs_at_least"] == sum(x >= c for x in n) and r["tokens_at_least"] == sum(x for x in n if x >= c)
        assert r["truncated_total"] == sum(min(x, c) for x in n) and abs(r["cumulative_share"] - sum(x <= c for x in n) / len(n)) < 1e-12
    limits = spark.createDataFrame([(c,) for c in (0, 1, 7, 100, 10**6)], "context long")
    for r in lengths.totals(sums, limits).collect():
        assert r["truncated_total"] == sum(min(x, r["context"]) for x in n) and r["docs_over"] == sum(x > r["context"] for x in n)
    assert lengths.quantile(sums, 0.5).first()[0] == sorted(n)[(len(n) + 1) // 2 - 1]
    assert {r["share"]: r["n_tokens"] for r in lengths.quantiles(sums, (0.5, 1.0)).collect()} == {0.5: sorted(n)[(len(n) + 1) // 2 - 1], 1.0: max(n)}
    assert {r["context"] for r in lengths.totals(sums, limits.union(limits).union(spark.createDataFrame([(None,)], "context long"))).collect()} == {0, 1, 7, 100, 10**6}
    none = lengths.suffix_sums(lengths.histogram(df.limit(0), PATH, PATTERN))
    assert [tuple(r) for r in lengths.totals(none, limits.limit(1)).collect()] == [(0, 0, 0)]
    assert none.collect() == [] and lengths.quantile(none, 0.5).first()[0] is None


def brute_licenses(text, least=0.8):
    """Longest common subsequence of every template with every window of the text's words, without index and band."""
    index, found = licenses.Index(licenses.TEMPLATES, 5, 4), set()
    words, _, _ = licenses.word_hashes(text, licenses._BREAK, spans=True)
    for t, tmpl in enumerate(index.words):
        for lo in range(len(words)):
            win, row = words[lo : lo + len(tmpl) + 8], np.zeros(len(tmpl) + 1, int)
            if len(win) < least * len(tmpl):
                break
            for w in win:
                new = row.copy()
                for i in range(len(tmpl)):
                    new[i + 1] = max(new[i], row[i + 1], row[i] + 1 if tmpl[i] == w else 0)
                row = new
            if row[-1] >= least * len(tmpl):
                found.add(index.names[t])
                break
    return found


def brute_spans(text, name, words, least=0.8):
    """(matched, first character, end character) of occurrences: the longest common subsequence of the template with every window of at most
    eight more words that holds five of its words in a row (or all of fewer), best first, then shortest, then first, none sharing a word."""
    own, start, end = licenses.word_hashes(text, licenses._BREAK, spans=True)
    own, words, found = own.tolist(), words.tolist(), []
    k = min(5, len(words))
    grams = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}
    places = [i for i in range(len(own) - k + 1) if tuple(own[i : i + k]) in grams]
    for a in range(len(own)):
        row = [0] * (len(words) + 1)
        for b in range(a, min(len(own), a + len(words) + 8)):
            new = [0]
            for i, w in enumerate(words):
                new.append(row[i] + 1 if w == own[b] else max(new[i], row[i + 1]))
            row = new
            if row[-1] >= least * len(words) and any(a <= i <= b + 1 - k for i in places):
                found.append((-row[-1], b - a, a, b))
    out = []
    for m, _, a, b in sorted(found):
        if all(b < x or a > y for _, x, y in out):
            out.append((-m, a, b))
    return sorted((m, int(start[a]), int(end[b])) for m, a, b in out)


def test_license_spans_against_brute_force():
    r = random.Random(6)
    kept = {n: licenses.TEMPLATES[n] for n in ("apache-2.0-line", "cc-by-4.0", "gpl-3.0-line", "mit-line", "mpl-2.0")} | {"two": "All rights", "four": "see the LICENSE file"}
    index = licenses.Index(kept, 5, 4)
    for _ in range(25):
        text = []
        for _ in range(r.randint(1, 4)):
            w = kept[r.choice(sorted(kept))].split()
            if len(w) > 9 and r.random() < 0.6:  # a word put in, left out or changed behind the first eight
                i = r.randint(8, len(w) - 1)
                w[i : i + 1] = r.choice([[], ["odd"], [w[i], "odd"]])
            text += w + ["x"] * r.choice([0, 1, 9])
        text = " ".join(text)
        got = licenses.scan_text(text, index, 8, 0.8)
        for t, name in enumerate(index.names):
            assert sorted((x[1], x[4], x[5]) for x in got if x[0] == name) == brute_spans(text, name, index.words[t]), (name, text)


def test_whole_license_texts():
    index = licenses.Index(licenses.TEMPLATES | licenses.TEXTS, 5, 4)
    for name, body in licenses.TEXTS.items():
        text = f"Copyright (c) somebody\n\n{body.replace('. ', '.\n\n').replace('the following', 'these following', 1)}\nint main() {{}}"
        got = {x[0]: x for x in licenses.scan_text(text, index, 8, 0.8)}
        assert got[name][3] > 0.97 and text[got[name][4] : got[name][5]].split()[0] == body.split()[0], name


def test_license_scan(spark):
    t = licenses.TEMPLATES
    gap = t["gpl-3.0-notice"].replace("redistribute it", "redistribute  THIS thing").replace("hope", "wish")
    docs = ["", None, "no license here at all", "x y. Released under the MIT license!\nmore", t["apache-2.0-notice"] + " tail", "a " * 30000 + t["isc"], gap, "Licensed under CC BY-NC 4.0.", "Licensed under CC", "Permission is hereby granted, free"]
    df = spark.createDataFrame([(i, x, "z") for i, x in enumerate(docs)], "doc_id long, text string, license string")
    got = licenses.scan(df, templates=licenses.TEMPLATES).collect()
    for i, x in enumerate(docs):
        names = {r["license"] for r in got if r["doc_id"] == i}
        assert names == (brute_licenses((x or "")[-3000:])), i
    for r in got:
        assert docs[r["doc_id"]][r["span_start"] : r["span_end"]] == r["matched_text"] and 0.8 <= r["coverage"] <= 1
    assert [r["matched_text"] for r in got if r["doc_id"] == 3] == ["Released under the MIT license"]
    assert licenses.scan(df.limit(0)).collect() == []


def test_license_with_words_put_in_at_several_places():
    index, words = licenses.Index(licenses.TEMPLATES, 5, 4), licenses.TEMPLATES["gpl-3.0-notice"].split()
    for places, size in ((2, 6), (3, 8), (4, 6)):
        parts = [words[len(words) * i // (places + 1) : len(words) * (i + 1) // (places + 1)] for i in range(places + 1)]
        text = "before it " + (" " + "put in " * (size // 2)).join(" ".join(p) for p in parts) + " after it"
        got = {r[0]: r[1:] for r in licenses.scan_text(text, index, 8, 0.8)}
        assert got["gpl-3.0-notice"][2] == 1, (places, size)
        assert text[got["gpl-3.0-notice"][3] : got["gpl-3.0-notice"][4]] == text[10:-10]


def test_license_lines_back_to_back():
    index = licenses.Index(licenses.TEMPLATES, 5, 4)
    for name in ("mit-line", "apache-2.0-line", "cc-by-nc-4.0-line", "mpl-2.0"):
        line = licenses.TEMPLATES[name]
        for between in (" ", " and then ", " x" * 7 + " ", " x" * 30 + " "):
            text = between.join([line] * 40)
            spans = [(r[4], r[5]) for r in licenses.scan_text(text, index, 8, 0.8) if r[0] == name]
            assert len(spans) == 40 and all(text[a:b] == line.rstrip(".") for a, b in spans), (name, between)
    line = licenses.TEMPLATES["apache-2.0-line"]  # the first without its last word, the second without its first
    spans = [r[1] for r in licenses.scan_text(line[:-2] + " x y z " + line[len("Licensed ") :], index, 8, 0.8) if r[0] == "apache-2.0-line"]
    assert spans == [7, 7]
