"""Feature-hash embeddings and exact nearest neighbours."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailhead.operators.graph import written


# What isn't a letter or digit of ASCII is a blank to the encoder; A-Z are lower-cased.
_ENCODED = bytes(c if chr(c).isalnum() and c < 128 else 32 for c in range(256)).lower()
_CODE = np.full(256, 0, np.int64)
_CODE[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = range(36)
#: Words whose digests a worker keeps.
KEPT_WORDS = 200_000
#: Queries by text up to which each task holds all of them.
FEW_QUERIES = 2_000


class _Hasher:
    """Slots and signed weights of features by their digests; those of all trigrams are a table."""

    _made: dict[int, _Hasher] = {}

    def __init__(self, dims: int):
        self.dims = dims
        letters = b"0123456789abcdefghijklmnopqrstuvwxyz"
        self.grams = self.of([bytes((x, y, z)) for x in letters for y in letters for z in letters])
        self.words: dict[bytes, int] = {}
        self.known = (np.zeros((0, 3), np.int64), np.zeros((0, 3)))

    @classmethod
    def get(cls, dims: int) -> _Hasher:
        if dims not in cls._made:
            cls._made[dims] = cls(dims)
        return cls._made[dims]

    def of(self, features: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Per feature three slots, and the weights that it adds there, by 32 and 8 bits of its digest each."""
        d = np.frombuffer(b"".join(hashlib.md5(f).digest() for f in features), np.uint8).reshape(-1, 16)
        slots = np.ascontiguousarray(d[:, :12]).view(">u4").astype(np.int64) % self.dims
        sign = 1.0 - 2.0 * (d[:, 12:14] % 2)
        return slots, np.stack([sign[:, 0], 0.5 * sign[:, 1], np.full(len(d), 0.25)], 1)

    def rows(self, words: list[bytes]) -> np.ndarray:
        if len(self.words) > KEPT_WORDS:
            self.words, self.known = {}, (np.zeros((0, 3), np.int64), np.zeros((0, 3)))
        fresh = list(dict.fromkeys(w for w in words if w not in self.words))
        if fresh:
            slots, weights = self.of(fresh)
            weights = weights * np.array([1.0 + min(len(w), 12) / 12.0 for w in fresh])[:, None]
            self.words |= dict(zip(fresh, range(len(self.words), len(self.words) + len(fresh)), strict=True))
            self.known = np.concatenate([self.known[0], slots]), np.concatenate([self.known[1], weights])
        return np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Normalised vectors of texts, a row each, and which slots their features touched."""
        out, touched = np.zeros((len(texts), self.dims)), np.zeros((len(texts), self.dims), bool)
        split = [(t or "").encode("utf-8", "surrogatepass").translate(_ENCODED).split() for t in texts]
        rows = self.rows([w for words in split for w in words])
        ends = np.cumsum([len(words) for words in split])
        for i, words in enumerate(split):
            if not words:
                out[i, 0], touched[i, 0] = 1.0, True
                continue
            code = _CODE[np.frombuffer(b"".join(words), np.uint8)]
            grams = code[:-2] * 1296 + code[1:-1] * 36 + code[2:]
            at = rows[ends[i] - len(words) : ends[i]]
            slots = np.concatenate([self.grams[0][grams].ravel(), self.known[0][at].ravel()])
            weights = np.concatenate([0.35 * self.grams[1][grams].ravel(), self.known[1][at].ravel()])
            out[i] = np.bincount(slots, weights, self.dims)
            touched[i, slots] = True
            norm = np.sqrt((out[i] ** 2).sum())
            if norm > 0:
                out[i] /= norm
        return out, touched


def _encoded(texts: DataFrame, key: str, text: str, dims: int, more: str, give) -> DataFrame:
    schema = texts.select(key).schema
    for field in texts.sparkSession.createDataFrame([], more).schema:
        schema = schema.add(field)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher.get(dims)
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), *give(*hasher.encode(part.column(1).to_pylist()))], names)

    return texts.select(key, text).mapInArrow(run, schema)


def embed_features(texts: DataFrame, key: str, text: str, dims: int = 384) -> DataFrame:
    """(key, dim, value): L2-normalised feature-hash embeddings in sparse form.

    A token weighs 1 + min(its length, 12) / 12, a trigram of the text without blanks 0.35; each adds to three slots chosen, like two of the
    signs, by its digest. Null texts and texts without tokens give 1 at slot 0. One narrow pass: a text is encoded on its own.
    """

    def give(v: np.ndarray, touched: np.ndarray) -> list[pa.Array]:
        ends = np.concatenate(([0], np.cumsum(touched.sum(1)))).astype(np.int32)
        pairs = pa.StructArray.from_arrays([pa.array(np.nonzero(touched)[1], pa.int32()), pa.array(v[touched])], ["dim", "value"])
        return [pa.ListArray.from_arrays(pa.array(ends), pairs)]

    return _encoded(texts, key, text, dims, "m array<struct<dim: int, value: double>>", give).select(key, F.inline("m"))


def embed(texts: DataFrame, key: str, text: str, dims: int = 384, kind: str = "float") -> DataFrame:
    """(key, vector): dense embeddings, of single precision or another kind of number."""

    def give(v: np.ndarray, touched: np.ndarray) -> list[pa.Array]:
        return [pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, dims, dtype=np.int32)), pa.array(v.ravel()))]

    dense = _encoded(texts, key, text, dims, "vector array<double>", give)
    return dense if kind == "double" else dense.withColumn("vector", F.col("vector").cast(f"array<{kind}>"))


def _packed(df: DataFrame, key: str, vec: str, extra: str | None, size: int, name: str) -> tuple[DataFrame, int]:
    """Rows of about size vectors: their keys, labels and vectors as bytes. Dealt by a hash of the key, so no block is hot."""
    n = df.count()
    blocks = max(1, -(-n // size))
    d = df.select(F.col(key).alias("k"), F.transform(vec, lambda a: a.cast("double")).alias("v"), (F.col(extra) if extra else F.lit("")).cast("string").alias("x")).withColumn("b", F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int"))
    schema = f"{name}_block int, keys array<{dict(df.dtypes)[key]}>, labels array<string>, vec binary"
    kind = pa.int64() if dict(df.dtypes)[key] == "bigint" else pa.string()

    def pack(p: pa.Table) -> pa.Table:
        p = p.combine_chunks()
        rows = np.array(p.column("v").to_pylist(), np.float64).tobytes()
        return pa.table([pa.array([p.column("b")[0].as_py()], pa.int32()), pa.array([p.column("k").to_pylist()], pa.list_(kind)), pa.array([p.column("x").to_pylist()], pa.list_(pa.string())), pa.array([rows], pa.binary())], [f"{name}_block", "keys", "labels", "vec"])

    return d.groupBy("b").applyInArrow(pack, schema), blocks


def knn(vectors: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", key: str = "vec_id", vec: str = "embedding", same: str | None = None, size: int = 4096) -> DataFrame:
    """The k nearest vectors of each query, exactly: query_id, place, the key, distance, score = 1 / (1 + max(distance, 0)).

    Vectors and queries are packed in blocks. A task holds one block of vectors and streams all blocks of queries past it, with one matrix product
    each, so vectors move once; a block returns its best k per query, so what is shuffled after that is k rows per query and block. same:
    a column that must be equal on both sides. Ties go to the smaller key (bigint or string).
    """
    v, nv = _packed(vectors, key, vec, same, size, "v")
    q, _ = _packed(queries, key, vec, same, 1024, "q")
    q = q.withColumn("v_block", F.explode(F.sequence(F.lit(0), F.lit(nv - 1))))
    stream = v.withColumn("q_block", F.lit(-1)).unionByName(q).repartition(nv, "v_block").sortWithinPartitions("v_block", "q_block").select("q_block", "keys", "labels", "vec")
    kind = dict(vectors.dtypes)[key]
    column = pa.int64() if kind == "bigint" else pa.string()

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, x = None, None, None
        for b in batches:
            for i in range(b.num_rows):
                at, keys, names, raw = (b.column(c)[i].as_py() for c in range(4))
                y = np.frombuffer(raw, np.float64).reshape(len(keys), -1)
                if at < 0:
                    ids, labels, x = np.array(keys), np.array(names), y
                    continue
                if metric == "cosine":
                    norm = np.linalg.norm(y, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]
                    d = 1 - np.divide(y @ x.T, norm, out=np.zeros((len(y), len(x))), where=norm > 0)
                else:
                    d = np.maximum(0, (y * y).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * y @ x.T)
                if same:
                    d = np.where(np.array(names)[:, None] == labels[None, :], d, np.inf)
                d = np.round(d, 9)
                out = [(q, j, d[n, j]) for n, q in enumerate(keys) for j in np.lexsort((ids, d[n]))[:k].tolist() if np.isfinite(d[n, j])]
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], column), pa.array([ids[o[1]].item() for o in out], column), pa.array([o[2] for o in out], pa.float64())], ["query_id", key, "distance"])

    found = stream.mapInArrow(near, f"query_id {kind}, `{key}` {kind}, distance double")
    return _placed(found, k, key)


def _placed(found: DataFrame, k: int, key: str) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy("distance", key)
    r = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
    return r.select("query_id", "place", key, F.round("distance", 6).alias("distance"), F.round(1 / (1 + F.greatest(F.col("distance"), F.lit(0.0))), 6).alias("score"))


def _near_texts(chunks: DataFrame, queries: pa.Table, k: int, dims: int, kind: str) -> DataFrame:
    """(query_id, chunk_id, distance): the k nearest chunks of each task's for each query (query_id, text). One narrow pass: no encoding is stored or shuffled."""
    ids, texts = pa.concat_arrays(queries["query_id"].chunks or [pa.array([], queries.schema.field("query_id").type)]), queries["text"].to_pylist()

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher.get(dims)
        y, _ = hasher.encode(texts)
        size = np.linalg.norm(y, axis=1)[:, None]
        best: list[list[tuple]] = [[] for _ in texts]
        last = np.full(len(texts), np.inf)  # the distance of the k-th so far
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                keys = part.column(0).to_pylist()
                x, _ = hasher.encode(part.column(1).to_pylist())
                norm = size * np.linalg.norm(x, axis=1)[None, :]
                d = np.round(1 - np.divide(y @ x.T, norm, out=np.zeros((len(y), len(x))), where=norm > 0), 9)
                closer = d <= last[:, None]
                for n in np.flatnonzero(closer.any(axis=1)).tolist():
                    best[n] = sorted(best[n] + [(d[n, j], keys[j]) for j in np.flatnonzero(closer[n]).tolist()])[:k]
                    if len(best[n]) == k:
                        last[n] = best[n][-1][0]
        of = np.repeat(np.arange(len(texts)), [len(x) for x in best])
        flat = [p for x in best for p in x]
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(of)), pa.array([p[1] for p in flat], pa.string()), pa.array([p[0] for p in flat], pa.float64())], ["query_id", "chunk_id", "distance"])

    return chunks.select("chunk_id", "content").mapInArrow(near, f"query_id {kind}, chunk_id string, distance double")


def semantic(chunks: DataFrame, queries: DataFrame, k: int = 10, dims: int = 384) -> DataFrame:
    """The k chunks (chunk_id, content) nearest to each query (query_id, text) by the cosine of their encodings: query_id, place, chunk_id, distance,
    score. Ties go to the smaller chunk_id. Up to ``FEW_QUERIES`` queries are held by each task, and chunks are compared as they are encoded; beyond,
    encodings are stored and meet in blocks."""
    some = queries.select("query_id", "text").limit(FEW_QUERIES + 1).toArrow().combine_chunks()
    if some.num_rows <= FEW_QUERIES:
        return _placed(_near_texts(chunks, some, k, dims, dict(queries.dtypes)["query_id"]), k, "chunk_id")
    c = written(embed(chunks.select(F.col("chunk_id").alias("id"), "content"), "id", "content", dims, "double"), "encoded")  # counted, then packed
    q = written(embed(queries.select(F.concat(F.lit("?"), "query_id").alias("id"), "text"), "id", "text", dims, "double"), "encoded")
    back = F.substring("query_id", 2, 64).cast(dict(queries.dtypes)["query_id"])
    return knn(c, q, k, key="id", vec="vector").select(back.alias("query_id"), "place", F.col("id").alias("chunk_id"), "distance", "score")


def store(there: DataFrame, new: DataFrame, dims: int, key: str = "chunk_id", vec: str = "vector") -> DataFrame:
    """The next snapshot of a vector table: the rows of new take the place of those with their keys. A vector of another length is an error that
    names its row, raised when the snapshot is written."""
    wrong = F.concat(F.lit("vector of "), F.col(key).cast("string"), F.lit(" has "), F.coalesce(F.size(vec), F.lit(0)).cast("string"), F.lit(f" dimensions, not {dims}"))
    checked = new.withColumn(vec, F.when(F.size(vec) == dims, F.col(vec)).otherwise(F.raise_error(wrong).cast(new.schema[vec].dataType)))
    return there.join(new.select(key), key, "left_anti").select(new.columns).unionByName(checked)


CACHE_KEY = ["query_fingerprint", "embedding_hash", "language_scope"]


def cache_write(cache: DataFrame, results: DataFrame, now: int, ttl: int = 1800) -> DataFrame:
    """The cache after results (key columns, top_k, result_json) of searches made just now: they take the place of entries with their key, expire
    after ttl seconds and carry their payload's hash. Empty results aren't kept, and entries that have expired go."""
    key = [*CACHE_KEY, "top_k"]
    kept = results.where("result_json is not null and result_json <> '[]'").groupBy(*key).agg(F.max("result_json").alias("result_json"))
    made = kept.select(*key, "result_json", F.sha2(F.col("result_json").cast("binary"), 256).alias("payload_hash"), F.lit(now + ttl).alias("expires_at"))
    return cache.where(F.col("expires_at") > now).join(made, key, "left_anti").select(made.columns).unionByName(made)


def cache_lookup(cache: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (query_fingerprint, embedding_hash, language_scope, top_k, now) answered from a cache: hit where an entry with the key is live
    and its payload agrees with its hash, expired, corrupt or miss."""
    r = requests.join(cache, ["query_fingerprint", "embedding_hash", "language_scope", "top_k"], "left")
    state = F.when(F.col("expires_at").isNull(), "miss").when(F.col("expires_at") <= F.col("now"), "expired").when(F.sha2(F.col("result_json").cast("binary"), 256) != F.col("payload_hash"), "corrupt").otherwise("hit")
    return r.select("query_fingerprint", "language_scope", "top_k", state.alias("state"))
