"""Byte-level BPE encoding and decoding.

Ranks come from a tiktoken rank file whose path is a parameter. Each match of the split pattern is encoded alone:
a match that is itself a token gives that token; any other starts as single bytes, and the adjacent pair whose
joined bytes have the lowest rank, leftmost among equals, is merged until no adjacent pair has a rank.

The pairs of a match stand in a segment tree over its byte positions; a node holds the leftmost minimum of
(rank, position), so the root names the next merge, and a merge is three logarithmic point updates: the merged
pair, its live left neighbour and the removed right part. Short matches go through the trees of a whole batch at
once (NumPy), long ones one by one. Encodings of words are kept in a cache, bounded in bytes, while a task runs.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailhead.llm.common import map_batches, named
from trailhead.llm.textops import parts, tidy

#: Bytes of a task's cache, by estimate, beyond which its oldest half goes; words of more characters than CACHED are not kept.
CACHE, CACHED = 96 << 20, 64
#: Bytes that Python takes for an entry of the cache besides its characters and ids.
ENTRY = 150
#: Longest match in bytes that is encoded in a batch.
SHORT = 32
# Split patterns in public use in whose matches a blank can only come first or stand among white space.
BLANK_FIRST = (
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""",
    r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s""",
)
_NONE = np.int64(1) << np.int64(62)
_made: dict = {}


class Cache:
    """Encodings by text (``of``), or their lengths, with an estimate of their size in bytes."""

    def __init__(self, weigh=len):
        self.of: dict = {}
        self.size, self.weigh = 0, weigh

    def learn(self, new: dict) -> None:
        self.of.update(new)
        self.size += ENTRY * len(new) + sum(map(len, new)) + sum(map(self.weigh, new.values()))

    def trim(self, most: int) -> None:
        """Drop the oldest half until what is left takes at most so many bytes."""
        while self.size > most and self.of:
            for k in list(islice(self.of, -(-len(self.of) // 2))):
                self.size -= ENTRY + len(k) + self.weigh(self.of.pop(k))

    def forget(self) -> None:
        self.of.clear()
        self.size = 0


def chunks(text: str, most: int = 1 << 20) -> Iterator[str]:
    """A long text cut before single blanks between words, into parts of about so many characters."""
    lo, at = 0, most
    while at < len(text) and (at := text.find(" ", at)) > 0 and at + 1 < len(text):
        if not text[at - 1].isspace() and not text[at + 1].isspace():
            yield text[lo:at]
            lo, at = at, at + most
        else:
            at += 1
    yield text[lo:]


class Codec:
    """Encoder and decoder for one rank file and split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache: int = CACHE):
        self.ranks, self.text = ranks, {v: k for k, v in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.cuts = pattern in BLANK_FIRST
        pairs = np.array([((ranks[whole[:i]] << 32) | ranks[whole[i:]], rank) for whole, rank in ranks.items() for i in range(1, len(whole)) if whole[:i] in ranks and whole[i:] in ranks], np.int64).reshape(-1, 2)
        pairs = pairs[np.argsort(pairs[:, 0])]
        self.keys, self.values = pairs[:, 0].copy(), pairs[:, 1].copy()
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.words, self.pieces, self.counts, self.cache = Cache(), Cache(), Cache(lambda n: 0), cache

    @classmethod
    def load(cls, path: str, pattern: str) -> Codec:
        """The codec of a rank file; kept per process."""
        if (path, pattern) not in _made:
            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
            _made[path, pattern] = cls(ranks, pattern)
        return _made[path, pattern]

    def pair(self, a: int, b: int) -> int | None:
        """The rank of two adjacent parts, if they merge."""
        return self.ranks.get(self.text[a] + self.text[b])

    def merge_long(self, data: bytes) -> list[int]:
        """Ids of one match by its own segment tree."""
        n = len(data)
        ids, pair = self.byte[np.frombuffer(data, np.uint8)].tolist(), self.pair
        width = 1 << max(0, n - 1).bit_length()
        none = int(_NONE)
        tree = [none] * (2 * width)
        for i in range(n - 1):
            r = pair(ids[i], ids[i + 1])
            if r is not None:
                tree[width + i] = (r << 32) | i
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]

        def put(i: int, key: int) -> None:
            i += width
            tree[i] = key
            i >>= 1
            while i:
                a, b = tree[2 * i], tree[2 * i + 1]
                low = a if a < b else b
                if tree[i] == low:
                    break
                tree[i] = low
                i >>= 1

        while (low := tree[1]) != none:
            i = low & 0xFFFFFFFF
            j = after[i]
            ids[i], k, h = low >> 32, after[j], before[i]
            ids[j] = -1
            after[i] = k
            put(j, none)
            r = None
            if k >= 0:
                before[k] = i
                r = pair(ids[i], ids[k])
            put(i, none if r is None else (r << 32) | i)
            if h >= 0:
                r = pair(ids[h], ids[i])
                put(h, none if r is None else (r << 32) | h)
        return [x for x in ids if x >= 0]

    def _pair_keys(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        key = (left << np.int64(32)) | right
        i = np.searchsorted(self.keys, key)
        i[i == len(self.keys)] = 0
        return np.where((right >= 0) & (self.keys[i] == key), (self.values[i] << np.int64(32)) | at, _NONE)

    def merge_short(self, datas: list[bytes]) -> list[bytes]:
        """Ids (little-endian 32-bit) of matches of at most SHORT bytes, one segment tree each, merged in step."""
        # blocks of like lengths: a block's trees are as wide as its longest match
        order = sorted(range(len(datas)), key=lambda i: len(datas[i]))
        out = [b""] * len(datas)
        for lo in range(0, len(datas), 8192):
            part = order[lo : lo + 8192]
            for i, ids in zip(part, self._merge_block([datas[i] for i in part]), strict=True):
                out[i] = ids
        return out

    def _merge_block(self, datas: list[bytes]) -> list[bytes]:
        sizes = np.array([len(d) for d in datas])
        n, width = len(datas), 1 << max(0, int(sizes.max()) - 1).bit_length()
        raw = np.frombuffer(b"".join(d.ljust(width, b"\0") for d in datas), np.uint8).reshape(n, width)
        ids = np.where(np.arange(width) < sizes[:, None], self.byte[raw], -1)
        tree = np.full((n, 2 * width), _NONE, np.int64)
        if width > 1:
            tree[:, width : 2 * width - 1] = self._pair_keys(ids[:, :-1], ids[:, 1:], np.arange(width - 1, dtype=np.int64))
        for i in range(width - 1, 0, -1):
            tree[:, i] = np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1])
        after = np.broadcast_to(np.arange(1, width + 1), (n, width)).copy()
        after[np.arange(1, width + 1)[None, :] >= sizes[:, None]] = -1
        before = np.broadcast_to(np.arange(-1, width - 1), (n, width)).copy()

        def put(rows: np.ndarray, i: np.ndarray, key: np.ndarray) -> None:
            i = i + width
            tree[rows, i] = key
            for _ in range(width.bit_length() - 1):
                i = i >> 1
                tree[rows, i] = np.minimum(tree[rows, 2 * i], tree[rows, 2 * i + 1])

        live = np.flatnonzero(tree[:, 1] != _NONE) if width > 1 else np.zeros(0, int)
        while len(live):
            low = tree[live, 1]
            i = low & np.int64(0xFFFFFFFF)
            j = after[live, i]
            k, h = after[live, j], before[live, i]
            merged = low >> np.int64(32)
            ids[live, i], ids[live, j], after[live, i] = merged, -1, k
            put(live, j, np.full(len(live), _NONE))
            right = np.where(k >= 0, ids[live, np.maximum(k, 0)], -1)
            put(live, i, self._pair_keys(merged, right, i))
            if (on := k >= 0).any():
                before[live[on], k[on]] = i[on]
            if (on := h >= 0).any():
                rows, hh = live[on], h[on]
                put(rows, hh, self._pair_keys(ids[rows, hh], merged[on], hh))
            live = live[tree[live, 1] != _NONE]
        kept = ids >= 0
        flat, ends = ids[kept].astype("<u4").tobytes(), np.cumsum(kept.sum(1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _learn(self, pieces: Iterable[str], into: dict[str, bytes]) -> None:
        """Put the encodings of matches into a dictionary."""
        names, short = [], []
        for p in pieces:
            data = p.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(data)
            if whole is not None:
                into[p] = whole.to_bytes(4, "little")
            elif len(data) <= SHORT:
                names.append(p)
                short.append(data)
            else:
                into[p] = np.array(self.merge_long(data), "<u4").tobytes()
        if short:
            into.update(zip(names, self.merge_short(short), strict=True))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, as little-endian 32-bit integers.

        With a pattern of BLANK_FIRST a text is cut at single blanks: a part that neither begins nor ends with white space is split and
        encoded alike wherever it stands, so its encoding is kept; a text with another part, and any text with another pattern, is split as a whole.
        """
        if self.cuts and max(map(len, texts), default=0) > 2 << 20:
            return [b"".join(b for c in chunks(t) for b in self._encode([c])) for t in texts]
        return self._encode(texts)

    def count_batch(self, texts: list[str]) -> list[int]:
        """How many ids ``encode_batch`` gives for whole texts: the words' numbers are kept and added, no ids are joined."""
        if self.cuts and max(map(len, texts), default=0) > 2 << 20:
            return [sum(n for c in chunks(t) for n in self._count([c])) for t in texts]
        return self._count(texts)

    def _count(self, texts: list[str]) -> list[int]:
        self.counts.trim(self.cache - self.cache // 3)
        self.pieces.trim(self.cache // 3)
        words = self.counts.of
        cut, matched, at_start, as_whole = self._parted(texts, words)
        known = {p: len(v) // 4 for p, v in self._known(matched, at_start, as_whole).items()}
        of = known.__getitem__
        made = {p: sum(map(of, found)) for p, found in matched.items()}
        self.counts.learn({p: n for p, n in made.items() if len(p) <= CACHED})
        long = {p: n for p, n in made.items() if len(p) > CACHED}
        out = []
        for n, parts in enumerate(cut):
            if n in as_whole:
                out.append(sum(map(of, as_whole[n])))
                continue
            head = sum(map(of, at_start.get(n, ())))
            try:
                out.append(head + sum(map(words.__getitem__, parts[1:])))
            except KeyError:
                out.append(head + sum(w if (w := words.get(p)) is not None else long[p] for p in parts[1:]))
        return out

    def _parted(self, texts: list[str], words: dict) -> tuple[list[list[str]], dict[str, list[str]], dict[int, list[str]], dict[int, list[str]]]:
        """Texts cut at blanks; the matches of parts that words doesn't know, of texts' first parts by number, and of texts that are split as a whole."""
        cut = [t.split(" ") for t in texts]
        fresh, whole = set(), set()
        for n, parts in enumerate(cut):
            first, missing = parts[0], set(parts[1:]).difference(words)
            if not self.cuts or any(not p or p[0].isspace() or p[-1].isspace() for p in missing) or first and (first[0].isspace() or first[-1].isspace()):
                whole.add(n)
            else:
                fresh |= missing
        matched = {p: self.split(" " + p) for p in fresh}
        at_start = {n: self.split(cut[n][0]) for n in range(len(texts)) if n not in whole and cut[n][0]}
        return cut, matched, at_start, {n: self.split(texts[n]) for n in whole}

    def _known(self, *found_by: dict) -> dict[str, bytes]:
        """The encodings of all matches in some dictionaries of lists of them."""
        need: set[str] = set()
        for found in found_by:
            for matches in found.values():
                need.update(matches)
        known = {p: v for p in need if (v := self.pieces.of.get(p)) is not None}
        new: dict[str, bytes] = {}
        self._learn(need.difference(known), new)
        self.pieces.learn({p: v for p, v in new.items() if len(p) <= CACHED})
        return known | new

    def _encode(self, texts: list[str]) -> list[bytes]:
        self.words.trim(self.cache - self.cache // 3)
        self.pieces.trim(self.cache // 3)
        words = self.words.of
        cut, matched, at_start, as_whole = self._parted(texts, words)
        known = self._known(matched, at_start, as_whole)
        of = known.__getitem__
        made = {p: b"".join(map(of, found)) for p, found in matched.items()}
        self.words.learn({p: v for p, v in made.items() if len(p) <= CACHED})
        long = {p: v for p, v in made.items() if len(p) > CACHED}
        out = []
        for n, parts in enumerate(cut):
            if n in as_whole:
                out.append(b"".join(map(of, as_whole[n])))
                continue
            head = b"".join(map(of, at_start.get(n, ())))
            try:
                out.append(head + b"".join(map(words.__getitem__, parts[1:])))
            except KeyError:
                out.append(head + b"".join([w if (w := words.get(p)) is not None else long[p] for p in parts[1:]]))
        return out

    def forget(self) -> None:
        """Drop the caches: a worker lives on after its task, and other stages need the memory."""
        self.words.forget()
        self.counts.forget()
        self.pieces.forget()

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids given as little-endian 32-bit integers."""
        return b"".join(map(self.text.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def in_blocks(texts: Iterable[str | None], most_chars: int = 1_000_000) -> Iterator[list[str]]:
    """Texts in lists of bounded length, nulls as empty texts; a longer text alone."""
    block, n = [], 0
    for t in texts:
        t = t or ""
        if block and n + len(t) > most_chars:
            yield block
            block, n = [], 0
        block.append(t)
        n += len(t)
    if block:
        yield block


def _over(path: str, pattern: str, column: int, of, cache: int = CACHE, made=Codec.encode_batch):
    """A function of Arrow batches: of(codec, part, ids of its texts, or what made gives) for parts of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.load(path, pattern)
        codec.cache = cache
        try:
            for part, texts in parts(batches, column, most=min(1 << 20, max(1 << 16, cache >> 6))):
                yield of(codec, part, made(codec, [t or "" for t in texts]))
        finally:
            codec.forget()

    return tidy(run)


def _lengths(got: list[bytes]) -> pa.Array:
    return pa.array([len(x) // 4 for x in got], pa.int64())


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: bool = True, cache: int = CACHE) -> DataFrame:
    """df's columns, less the text's, plus bpe_ids (binary, little-endian 32-bit ids; only with ids) and n_tokens long. cache: bytes of
    the cache of encoded words that each running task holds.

    One narrow pass: no shuffle, and a lost executor's part is computed again alone. A null text is an empty one;
    an empty text has no ids. A column of df named like a new one is replaced. Rows that repeat a key are encoded each; an empty table
    gives no rows. A match of any length is encoded whole.
    """
    new = ["bpe_ids", "n_tokens"] if ids else ["n_tokens"]
    keep = [c for c in df.columns if c not in (text, *new)]
    schema = df.select(*map(named, keep)).schema
    schema = schema.add("bpe_ids", "binary").add("n_tokens", "long") if ids else schema.add("n_tokens", "long")
    names = schema.names

    def of(codec: Codec, part: pa.RecordBatch, got: list) -> pa.RecordBatch:
        more = [pa.array(got, pa.binary()), _lengths(got)] if ids else [pa.array(got, pa.int64())]
        return pa.RecordBatch.from_arrays([*part.columns[:-1], *more], names)

    return map_batches(df.select(*map(named, keep), named(text)), _over(path, pattern, len(keep), of, cache, Codec.encode_batch if ids else Codec.count_batch), schema)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "bpe_ids", out: str = "bpe_bytes") -> DataFrame:
    """df plus out (binary): the bytes that the ids stand for. Null ids give null; unknown ids are an error."""

    @F.arrow_udf("binary")
    def run(column: pa.Array) -> pa.Array:
        codec = Codec.load(path, pattern)
        return pa.array([None if x is None else codec.decode(x) for x in column.to_pylist()], pa.binary())

    return df.withColumn(out, run(named(ids)))


def digests(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_tokens, ids_sha256 and decoded_sha256 (lower-case hex) of the whole text's encoding and of the
    bytes decoded from it. Encodes and decodes within one pass, so neither ids nor bytes leave the worker. Null texts and keys, repeated
    rows and empty tables are as in ``encode``."""
    schema = df.select(named(key)).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    names = schema.names

    def of(codec: Codec, part: pa.RecordBatch, got: list[bytes]) -> pa.RecordBatch:
        hexes = [[hashlib.sha256(x).hexdigest() for x in got], [hashlib.sha256(codec.decode(x)).hexdigest() for x in got]]
        return pa.RecordBatch.from_arrays([part.column(0), _lengths(got), *(pa.array(x, pa.string()) for x in hexes)], names)

    return map_batches(df.select(named(key), named(text)), _over(path, pattern, 1, of), schema)
