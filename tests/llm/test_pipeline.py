import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from tests.llm.test_jaccard import brute
from tests.llm.test_tables import brute_mix
from trailhead.llm import quality
from trailhead.llm.bpe import Codec


def test_pipeline_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = corpus_pipeline.run(spark, sf)
    got = sorted((r["doc_id"], r["n_tokens"], bytes(r["bpe_ids"])) for r in out.collect())
    model = quality.fit(docs, labels)
    rows = sorted((r["doc_id"], r["text"], r["source"]) for r in docs.collect())
    rows = [r for r in rows if model.score(quality.features(r[1])[None])[0] >= 0.3]
    kept = {d for d, _, c in brute([r[:2] for r in rows], 5, 80) if d == c}
    rows = [r for r in rows if r[0] in kept]
    codec = Codec.load(public_tokenizers.path(corpus_pipeline.RANKS), public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    want = []
    for (d, t, _), (_, size, _, _, taken) in zip(rows, brute_mix(rows), strict=True):
        ids = np.array(library.encode_ordinary(t), "<u4").tobytes()
        want += [(d, len(ids) // 4, ids)] * (taken // size if size else 0)
    assert got == sorted(want)
    assert set(out.columns) == {"doc_id", "lang", "source", "n_chars", "bpe_ids", "n_tokens"}
    names = docs.columns
    assert all(stage(spark, docs, sf).columns == names for _, stage in corpus_pipeline.STAGES[:-1])


def test_stages_on_an_empty_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).collect() == []
