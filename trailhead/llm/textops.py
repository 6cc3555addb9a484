"""Vectorised hashing of words and shingles of whole texts. Works on UTF-8 bytes; separators and case are ASCII."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_CHUNK = 1 << 18
_power = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def release() -> None:
    """Give freed memory back: a Python worker lives on after its task, beside an executor that needs the room."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc keeps freed memory otherwise
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of a partition's batches that gives its memory back at its end, also where the task fails or its reader stops."""

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def parts(batches: Iterator[pa.RecordBatch], column: int, most: int = 4 << 20, rows: int = 1000) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of Arrow batches with their texts, which stand in a column by number: at most so many rows, and so many bytes of text or one row."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        lo = 0
        while lo < len(sizes):
            n = max(1, int(np.searchsorted(np.cumsum(sizes[lo : lo + rows], dtype=np.int64), most, "right")))
            part = b.slice(lo, n)
            yield part, part.column(column).to_pylist()
            lo += n


def list_column(values: list[np.ndarray]) -> pa.ListArray:
    """Arrays of 64-bit integers as an Arrow column of lists."""
    ends = np.cumsum([0, *map(len, values)], dtype=np.int32)
    flat = np.concatenate(values).view(np.int64) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; all bits of the result depend on all bits of x."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_power[0]) < n:
        for i, b in enumerate((_BASE, _INVERSE)):
            row = np.full(max(n, 1 << 16), b, np.uint64)
            row[0] = 1
            _power[i] = np.multiply.accumulate(row)
    return _power[0], _power[1]


def _spans(space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_hashes(text: str | None, space: np.ndarray = _SPACE, spans: bool = False):
    """One 64-bit hash per word of the text, A-Z lower-cased; with spans also the words' byte offsets.

    Long texts go in chunks that end between words, so memory follows the chunk or the longest word.
    """
    data = (text or "").encode("utf-8", "surrogatepass")
    raw = _LOWER[np.frombuffer(data, np.uint8)]
    got, at, ends = [], [], []
    lo = 0
    while lo < len(raw):
        hi = min(lo + _CHUNK, len(raw))
        if hi < len(raw):
            gap = np.flatnonzero(space[raw[lo:hi]])
            if len(gap):
                hi = lo + int(gap[-1]) + 1
            else:
                after = np.flatnonzero(space[raw[hi:]])
                hi = hi + int(after[0]) + 1 if len(after) else len(raw)
        part = raw[lo:hi]
        start, end = _spans(space[part])
        if len(start):
            up, down = _powers(len(part) + 1)
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
            h = (sums[end] - sums[start]) * down[start]
            got.append(mix(h ^ ((end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))))
            at.append(start + lo)
            ends.append(end + lo)
        lo = hi
    words = np.concatenate(got) if got else np.zeros(0, np.uint64)
    if not spans:
        return words
    return words, np.concatenate(at) if at else np.zeros(0, int), np.concatenate(ends) if ends else np.zeros(0, int)


def runs(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; of fewer words, one hash of them all; none without words."""
    n = len(words)
    if n == 0:
        return words
    width = min(k, n)
    acc = words[: n - width + 1]
    for i in range(1, width):
        acc = mix(acc * np.uint64(0xA0761D6478BD642F) + words[i : n - width + 1 + i])
    return mix(acc + np.uint64(width))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The distinct k-word shingles of a whole text as sorted 64-bit hashes."""
    s = np.sort(runs(word_hashes(text), k))
    return s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) else s
