"""The queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailhead.llm import ann, bpe, hosts, jaccard, lengths, licenses, manifest, mixing, near_vectors, oracles, packing, periodic, quality, warc

RANKS = "byte_bpe_multi_50k.tiktoken"
WORDS = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bpe() -> tuple[str, str]:
    return public_tokenizers.path(RANKS), public_tokenizers.PATTERN


def op1_near_vectors(spark, sf_dir):
    return near_vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op2_license_scan(spark, sf_dir):
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op3_warc(spark, sf_dir):
    return warc.round_trip(spark, _table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_nearest(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings")
    index = ann.build_index(rows, "vec_id", "embedding")
    return ann.search(rows.where("vec_id % 20 = 0"), index, "vec_id", "embedding")


def op5_quality(spark, sf_dir):
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_mix(spark, sf_dir):
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_hosts(spark, sf_dir):
    return hosts.judge(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op8_bpe(spark, sf_dir):
    return bpe.digests(_table(spark, sf_dir, "documents"), *_bpe())


def op9_lengths(spark, sf_dir):
    return _sums(spark, sf_dir)


def _sums(spark, sf_dir):
    return lengths.suffix_sums(lengths.histogram(_table(spark, sf_dir, "documents"), *_bpe()))


def token_totals(spark, sf_dir):
    """What context limits from 2^7 to 2^17 tokens leave of all documents."""
    return lengths.totals(_sums(spark, sf_dir), spark.range(7, 18).select(F.pow(F.lit(2), "id").cast("long").alias("context")))


def token_quantiles(spark, sf_dir):
    return lengths.quantiles(_sums(spark, sf_dir), (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0))


def op10_jaccard(spark, sf_dir):
    return jaccard.set_components(_table(spark, sf_dir, "documents"))


def op11_packing(spark, sf_dir):
    p = packing.pieces(_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(WORDS))
    return packing.pack(p.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


def op12_manifest(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    first = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    # a copy of the table in which half of the documents lost their line breaks is held against the manifest
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    seen = manifest.leaf(*first, F.when(tampered, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text")))
    m = manifest.build(docs, ["doc_id", "source", "lang", "n_chars", "text"], "source", "doc_id", {"doc_id": F.col("doc_id"), "seen": seen})
    rows = manifest.proofs(m).withColumn("root", F.lit(m.root)).withColumn("folded_root", manifest.fold(F.col("seen"), F.col("path")))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(manifest.siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_runs(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    docs = docs.withColumn("words", words).withColumn("n", F.size("words")).withColumn("g", F.floor(h / 10))
    docs = docs.withColumn("a", F.expr("if(n > 0, g % n, null)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    repeated = F.array_join(F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))), " ")
    docs = docs.select("doc_id", F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias("text"))
    best = F.array_sort("runs", lambda x, y: F.when(x["length"] != y["length"], F.signum(y["length"] - x["length"])).otherwise(F.signum(x["start"] - y["start"])).cast("int"))[0]
    rows = periodic.find_runs(docs).withColumn("best", F.when(F.size("runs") > 0, best))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    milli = F.expr("best.length * 1000 div best.period").alias("exponent_milli")
    return rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", milli, F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_near_vectors, op2_license_scan, op3_warc, op4_nearest, op5_quality, op6_mix, op7_hosts, op8_bpe, op9_lengths, op10_jaccard, op11_packing, op12_manifest, op13_runs, pipeline, token_totals, token_quantiles)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
