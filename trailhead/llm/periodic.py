"""Periodic runs of words in whole texts, by the linear tandem-repeat method of Gusfield and Stoye (2004).

A text is a row of words; each text is searched on its own in one narrow pass, so nothing is shuffled and a lost executor's
part is computed again alone. For a batch of texts:

* Basic factors: the words' ranks, and by doubling the ranks of all stretches of 2, 4, 8, ... words. They give the suffix array, and in a few
  vector steps the common extension, forward or backward, of any number of pairs of places.
* Suffix tree: the intervals of the suffix array's common prefixes, with suffix links.
* LZ blocks: each block begins where the longest earlier factor ends. Around each block's borders the extensions give, per period, the leftmost
  squares; together they cover every kind of square (phase 1).
* These squares are marked in the tree from its leaves upward (phase 2); from each mark suffix links and one more word lead to the
  square's rotations until one is missing or marked, which completes the vocabulary of squares (phase 3).
* Squares whose half isn't a repetition itself are located by their leaves; consecutive starts with one period are one run.

Before that, parts of a text that can't hold a run are left out, without loss: a run of period q and at least 4 q words repeats each
4 words that begin after its first q words at a distance of q or less.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from trailhead.llm.common import map_batches, named
from trailhead.llm.textops import mix, parts, tidy

#: Words that a run has at least, and its length in periods.
LEAST, POWER = 6, 4
#: Words whose trees are built together; a longer part alone.
TOGETHER = 1 << 16


class Factors:
    """Ranks of all stretches of 2^h words of a row of integers; stretches that reach beyond the end are padded."""

    def __init__(self, row: np.ndarray):
        n = len(row)
        rank = np.unique(row, return_inverse=True)[1].astype(np.int32)
        self.n, self.levels, step = n, [rank], 1
        while step < n and int(rank.max()) + 1 < n:
            key = (rank.astype(np.int64) + 1) * (n + 1)
            key[:-step] += rank[step:].astype(np.int64) + 1
            rank = np.unique(key, return_inverse=True)[1].astype(np.int32)
            self.levels.append(rank)
            step *= 2
        self.rank = rank
        self.order = np.empty(n, np.int64)
        self.order[rank] = np.arange(n)

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words agree from places a and b on (a <> b)."""
        a, b, n = a.copy(), b.copy(), self.n
        start = a.copy()
        for h in reversed(range(len(self.levels))):
            r, w = self.levels[h], 1 << h
            ok = np.flatnonzero((a + w <= n) & (b + w <= n))
            ok = ok[r[a[ok]] == r[b[ok]]]
            a[ok] += w
            b[ok] += w
        return a - start

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words agree up to places a and b, these included; places may be -1."""
        a, b = a + 1, b + 1
        start = a.copy()
        for h in reversed(range(len(self.levels))):
            r, w = self.levels[h], 1 << h
            ok = np.flatnonzero((a >= w) & (b >= w))
            ok = ok[r[a[ok] - w] == r[b[ok] - w]]
            a[ok] -= w
            b[ok] -= w
        return start - a


class Tree:
    """The suffix tree of a row whose suffixes all differ before its end: leaves 0 to n-1 by place, then inner nodes."""

    def __init__(self, f: Factors):
        n, order = f.n, f.order
        lcp = np.zeros(n + 1, np.int64)
        if n > 1:
            lcp[1:n] = f.ahead(order[:-1], order[1:])
        self.row, self.n = f.levels[0].tolist(), n
        sa, common = order.tolist(), lcp.tolist()
        depth, parent, low, left, right = [n - i for i in range(n)], [0] * n, list(range(n)), f.rank.tolist(), f.rank.tolist()
        longest = [0] * n
        # one scan of the array: open inner nodes are on the stack; earlier factors come from the neighbours by place
        stack = [n]
        depth.append(0)
        parent.append(-1)
        low.append(n)
        left.append(0)
        right.append(n - 1)
        seen: list[tuple[int, int]] = []
        for i in range(n):
            place, here = sa[i], common[i]
            last = sa[i - 1] if i else -1
            while depth[stack[-1]] > here:
                v = stack.pop()
                right[v] = i - 1
                up = stack[-1]
                if depth[up] < here:
                    up = len(depth)
                    depth.append(here)
                    parent.append(stack[-1])
                    low.append(low[v])
                    left.append(left[v])
                    right.append(0)
                    stack.append(up)
                parent[v] = up
                if low[v] < low[up]:
                    low[up] = low[v]
                last = -1
            top = stack[-1]
            if depth[top] < here:
                # the last leaf hangs below a new node
                up = len(depth)
                depth.append(here)
                parent.append(top)
                low.append(last)
                left.append(i - 1)
                right.append(0)
                parent[last] = up
                stack.append(up)
                top = up
            parent[place] = top
            if place < low[top]:
                low[top] = place
            # longest earlier factors: the nearest smaller places on either side
            m = here
            while seen and seen[-1][0] > place:
                q, c = seen.pop()
                longest[q] = max(longest[q], m)
                m = min(m, c)
            if seen:
                longest[place] = m
            seen.append((place, m))
        while len(stack) > 1:
            v = stack.pop()
            right[v] = n - 1
            up = stack[-1]
            parent[v] = up
            if low[v] < low[up]:
                low[up] = low[v]
        self.depth, self.parent, self.low, self.left, self.right, self.longest = depth, parent, low, left, right, longest
        self.links: dict[int, int] = {n: n}
        below = np.delete(np.arange(len(depth)), n)
        up, first = np.array(parent)[below], np.array(low)[below]
        self.span = int(f.levels[0].max()) + 1
        keys = up * self.span + f.levels[0][first + np.array(depth)[up]]
        self.child = dict(zip(keys.tolist(), below.tolist(), strict=True))

    def down(self, v: int, place: int, size: int) -> int:
        """The node below v, or v, towards the suffix at a place whose depth is at least size first."""
        depth, child, row, span = self.depth, self.child, self.row, self.span
        while depth[v] < size:
            v = child[v * span + row[place + depth[v]]]
        return v

    def link(self, v: int) -> int:
        """The suffix link of an inner node."""
        todo = []
        while v not in self.links:
            todo.append(v)
            v = self.parent[v]
        got = self.links[v]
        for v in reversed(todo):
            got = self.down(got, self.low[v] + 1, self.depth[v] - 1)
            self.links[v] = got
        return got


def blocks(longest: list[int], n: int) -> list[int]:
    """Borders of the LZ blocks: from each border on, the longest earlier factor or one word."""
    borders, at = [0], 0
    while at < n:
        at += longest[at] or 1
        borders.append(at)
    return borders


def _steps(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of counts, its number and 1, 2, ... up to it."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + 1


def covering(f: Factors, borders: list[int], most: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of squares that cover all kinds of squares of periods up to most by leftmost occurrences."""
    edge = np.array(borders, np.int64)
    h, h1 = edge[:-1], edge[1:]
    h2 = np.append(edge[2:], edge[-1])
    # squares whose centre is in the block, right of which a word of the next block follows
    which, k = _steps(np.where(h1 < f.n, np.minimum(h1 - h, most), 0))
    a, q = h1[which], h1[which] - k
    fore, back = f.ahead(a, q), f.behind(a - 1, q - 1)
    ok = (fore > 0) & (fore + back >= k)
    starts, periods = [np.maximum(q - back, q - k + 1)[ok]], [k[ok]]
    # squares that begin before the block and whose first half ends in it
    which, k = _steps(np.minimum(h2 - h, most))
    a, q = h[which], h[which] + k
    inside = q < f.n
    which, k, a, q = which[inside], k[inside], a[inside], q[inside]
    fore, back = f.ahead(a, q), f.behind(a - 1, q - 1)
    start = np.maximum(a - back, a - k + 1)
    ok = (fore > 0) & (back > 0) & (fore + back >= k) & (start + k <= h1[which])
    starts.append(start[ok])
    periods.append(k[ok])
    return np.concatenate(starts), np.concatenate(periods)


def vocabulary(tree: Tree, starts: np.ndarray, periods: np.ndarray) -> list[tuple[int, int]]:
    """All kinds of squares, each as (node below or at its place in the tree, period), from a leftmost covering set."""
    depth, parent, low, row, child = tree.depth, tree.parent, tree.low, tree.row, tree.child
    marks: set[tuple[int, int]] = set()
    at, v = -1, -1
    for i in np.lexsort((-periods, starts)).tolist():
        place, k = int(starts[i]), int(periods[i])
        if place != at:
            at = v = place
        # the place's list goes up while it is the smallest leaf below
        while low[v] == place and depth[parent[v]] >= 2 * k:
            v = parent[v]
        if low[v] == place:
            marks.add((v, k))
    n = tree.n
    for v, k in list(marks):
        while True:
            place, size = low[v], 2 * k - 1
            # the square without its first word: by the suffix link of the node above and down again
            w = tree.down(tree.link(parent[v]), place + 1, size)
            first = row[place]
            if depth[w] == size:
                w = child.get(w * tree.span + first, -1)
                if w < 0:
                    break
            else:
                end = low[w] + size
                if end >= n or row[end] != first:
                    break
            if (w, k) in marks:
                break
            marks.add((w, k))
            v = w
    return list(marks)


def _primes(k: int) -> list[int]:
    found, p = [], 2
    while p * p <= k:
        if k % p == 0:
            found.append(p)
            while k % p == 0:
                k //= p
        p += 1
    return found + [k] * (k > 1)


def runs_of(row: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all maximal runs of at least two periods, of periods up to most, in a row whose last value is there once.
    Periods are the smallest ones."""
    f = Factors(row)
    tree = Tree(f)
    kinds = vocabulary(tree, *covering(f, blocks(tree.longest, f.n), most))
    none = np.zeros(0, np.int64)
    if not kinds:
        return none, none, none
    node, k = np.array(kinds, np.int64).T
    place = np.array(tree.low, np.int64)[node]
    # a half that is a repetition itself: its square has a smaller period, a prime part of it
    divided = {int(x): _primes(int(x)) for x in np.unique(k)}
    counts = np.array([len(divided[x]) for x in k.tolist()], np.int64)
    which = np.repeat(np.arange(len(k)), counts)
    smaller = k[which] // np.array([p for x in k.tolist() for p in divided[x]], np.int64)
    repeated = f.ahead(place[which], place[which] + smaller) >= 2 * k[which] - smaller
    whole = np.ones(len(k), bool)
    whole[which[repeated]] = False
    node, k = node[whole], k[whole]
    if not len(k):
        return none, none, none
    left, right = np.array(tree.left, np.int64)[node], np.array(tree.right, np.int64)[node]
    which, nth = _steps(right - left + 1)
    start, period = f.order[left[which] + nth - 1], k[which]
    by = np.lexsort((start, period))
    start, period = start[by], period[by]
    new = np.flatnonzero(np.concatenate(([True], (start[1:] != start[:-1] + 1) | (period[1:] != period[:-1]))))
    last = start[np.append(new[1:], len(start)) - 1]
    return start[new], last + 2 * period[new] - start[new], period[new]


def _zones(row: np.ndarray, text_of: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
    """(from, to, longest period) of the parts of a batch's words that can hold a run of at least LEAST words and POWER periods.

    row: words as integers, text_of: each word's text, ends: each text's end. Of a run, the 4 words at each of length - period - 3
    consecutive places were there before, at most a period earlier; of m such places in a row, runs have periods up to (m + 3) / (POWER - 1).
    """
    n = len(row)
    if n < LEAST:
        return []
    key = text_of.astype(np.uint64)
    for i in range(4):
        key[: n - i] = mix(key[: n - i] * np.uint64(0xA0761D6478BD642F) + row[i:].astype(np.uint64))
    fits = np.arange(n) + 4 <= ends[text_of]
    places = np.flatnonzero(fits)
    by = places[np.argsort(key[places], kind="stable")]
    same = np.flatnonzero(key[by[1:]] == key[by[:-1]])
    gap = np.full(n, n, np.int64)
    gap[by[same + 1]] = by[same + 1] - by[same]
    while True:
        there = np.concatenate(([False], gap < n, [False]))
        edge = np.flatnonzero(there[1:] != there[:-1])
        lo, hi = edge[::2], edge[1::2]
        # stretches of two texts don't touch: a text's last three places begin no four words
        far = (hi - lo + 3) // (POWER - 1)
        at = np.flatnonzero(gap < n)
        drop = at[gap[at] > np.repeat(far, hi - lo)]
        if not len(drop):
            break
        gap[drop] = n
    keep = far > 0
    lo, hi, far = lo[keep], hi[keep], far[keep]
    if not len(lo):
        return []
    stop = ends[text_of[lo]]
    first = np.concatenate(([0], ends[:-1]))[text_of[lo]]
    out: list[tuple[int, int, int]] = []
    for a, b, q in zip(np.maximum(lo - far, first).tolist(), np.minimum(hi + 3, stop).tolist(), far.tolist(), strict=True):
        while out and a < out[-1][1]:
            a0, b0, q0 = out.pop()
            a, b, q = min(a, a0), max(b, b0), max(q, q0)
        out.append((a, b, q))
    return [z for z in out if z[1] - z[0] >= LEAST]


def find(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """Per row of words its runs (start, length, period) of at least LEAST words and POWER periods, by start, then period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ids = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(texts)))}
    row = np.fromiter(map(ids.__getitem__, chain.from_iterable(texts)), np.int64, int(sizes.sum()))
    text_of, ends = np.repeat(np.arange(len(texts)), sizes), np.cumsum(sizes)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    todo, held = [], 0
    zones = _zones(row, text_of, ends)
    for i, z in enumerate(zones):
        todo.append(z)
        held += z[1] - z[0]
        if held < TOGETHER and i + 1 < len(zones):
            continue
        # a value of its own after each part: nothing common reaches across
        joined = np.concatenate([x for j, (a, b, _) in enumerate(todo) for x in (row[a:b], [len(ids) + j])])
        lengths = np.array([b - a + 1 for a, b, _ in todo], np.int64)
        shift = np.repeat(np.array([a for a, _, _ in todo]) - (np.cumsum(lengths) - lengths), lengths)
        start, length, period = runs_of(joined, max(min(q, (b - a) // POWER) for a, b, q in todo))
        fit = length >= np.maximum(LEAST, POWER * period)
        place, length, period = start[fit] + shift[start[fit]], length[fit], period[fit]
        text = text_of[place]
        place -= ends[text] - sizes[text]
        for t, *run in zip(text.tolist(), place.tolist(), length.tolist(), period.tolist(), strict=True):
            out[t].append(tuple(run))
        todo, held = [], 0
    for found in out:
        found.sort(key=lambda r: (r[0], r[2]))
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, less those that a run holds after its first period, joined by one blank."""
    if runs:
        kept, at = [], 0
        for lo, hi in sorted((s + q, s + n) for s, n, q in runs):
            if hi > at:
                kept += words[at : max(at, lo)]
                at = hi
        words = kept + words[at:]
    return b" ".join(words)


def find_runs(docs: DataFrame, text: str = "text", runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """docs' columns, less the text's, plus runs (array of (start, length, period), longs, by start, then period) and collapsed (string: the text's
    words without what repeats within a run, joined by one blank).

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. A run is a stretch of at least max(6, 4 * period) words, two words that are a period apart
    being identical, that no neighbouring word extends; period is its smallest one. Null and empty texts have no runs and collapse to an
    empty text. Texts of any length are searched whole, rows that repeat a key each on their own; an empty table gives no rows, and a column
    named like a new one is replaced.
    """
    keep = [c for c in docs.columns if c not in (text, runs, collapsed)]
    parts_of = ("start", "length", "period")
    schema = docs.select(*map(named, keep)).schema.add(runs, ArrayType(StructType([StructField(x, LongType()) for x in parts_of]))).add(collapsed, "string")
    names, inner = schema.names, pa.list_(pa.struct([(x, pa.int64()) for x in parts_of]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in parts(batches, len(keep), most=1 << 20):
            words = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
            found = find(words)
            made = [collapse(w, r).decode("utf-8", "surrogatepass") for w, r in zip(words, found, strict=True)]
            flat = [[dict(zip(parts_of, r, strict=True)) for r in rs] for rs in found]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(flat, inner), pa.array(made, pa.string())], names)

    return map_batches(docs.select(*map(named, keep), named(text)), tidy(run), schema)

