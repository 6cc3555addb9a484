"""A training-data pipeline over documents: quality, near copies, mixing, encoding.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept and returns a DataFrame; the
results are written as Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from trailhead.llm import bpe, jaccard, mixing, quality
from trailhead.llm.common import BATCH, cut

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Bytes of the encoder's cache in a task: its executor still holds the heap that the near-copy stage has touched.
CACHE = 16 << 20


def _settle(spark: SparkSession) -> None:
    """A stage's own plan runs when its result is written: small Arrow batches leave executors and workers room for long texts."""
    for k, v in BATCH.items():
        spark.conf.set(k, v)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; labels come from the labels table, held-out rows aside. Null and empty texts are
    scored as empty; rows that repeat a key are each judged by their own text."""
    _settle(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group linked by five-word shingles with a similarity of 0.8 or more.
    Texts that are null or hold no word stay, as do rows without a key; rows that repeat a key go or stay each by its own text."""
    _settle(spark)
    return jaccard.keep_one(docs, k=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Texts without words have no size and come once an epoch; a null source is a source."""
    return mixing.apply_mix(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids: doc_id, lang, source, n_chars, bpe_ids, n_tokens. Null and empty texts have no ids."""
    _settle(spark)
    return bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, cache=CACHE)


STAGES = [("quality", quality_stage), ("near_copies", near_copies_stage), ("mixing", mixing_stage), ("encoding", encoding_stage)]

#: The classifier and the tokenizer have no SQL form; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
