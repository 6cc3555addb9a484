"""Packing of documents into sequences of bounded length: bound-certified repacking.

* ``pieces`` encodes whole texts and cuts those that are longer than a sequence.
* ``pack`` deals the pieces to groups of bounded size by a hash, and packs each by best-fit decreasing: the longest piece first, each into the
  fullest sequence with room. Dual feasible functions of the group's lengths give a lower bound: no packing of it can have fewer sequences. A group
  that meets its bound is certified.
* A bound over all lengths (a histogram of at most ``capacity`` rows) certifies the whole. As long as there are more sequences than that, groups with gaps
  exchange pieces: all that stand in sequences that aren't full are dealt anew to fewer groups and packed again. Full sequences stay as they are, so each
  round holds a small part of the one before, and no task ever more than a group.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailhead.llm.common import cut, map_batches, named, sweep
from trailhead.llm.textops import parts, tidy

#: Pieces of a group, and rounds of exchange at most; the result is whole whatever round is the last.
GROUP, ROUNDS = 1 << 16, 12
#: Exchanges of a few sequences that a group tries while it has more of them than its bound.
TRIES = 2000
#: Encoded words that a worker keeps, and the longest of them in bytes.
KEPT, KEPT_BYTES = 500_000, 32
#: Marks that are matched together, and apart from the letters before them.
MARKS = b"!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"


class Encoder:
    """The ids of texts by a tokenizer whose matches never hold white space, so that each word is encoded on its own and kept.

    Only blanks of ASCII part words here; the tokenizer parts them further, lower-cases them and ends each match by a token that ends with </w>.
    Special tokens' strings are ordinary text.
    """

    _open: dict[str, Encoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.of = Tokenizer.from_file(path)
        self.of.encode_special_tokens = True
        self.ends = np.zeros(self.of.get_vocab_size(), bool)
        self.ends[[i for t, i in self.of.get_vocab().items() if t.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}

    @classmethod
    def load(cls, path: str) -> Encoder:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def _raw(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.of.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def _letters(word: bytes) -> bool:
        """Whether a word is one match whatever its case: letters that stay letters in lower case."""
        if word.isascii():
            return word.isalpha()
        s = word.decode("utf-8", "replace")
        return s.isalpha() and max(s) <= "\xff"

    def _matches(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The encodings of words that are one match each: many go in one text, which is cut after each match's end."""
        out = {}
        for lo in range(0, len(words), 4000):
            part = words[lo : lo + 4000]
            ids = self._raw([b" ".join(part).decode()])[0]
            cuts = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            flat = ids.tobytes()
            if len(cuts) == len(part):
                out.update(zip(part, [flat[i:j] for i, j in zip([0, *cuts[:-1]], cuts, strict=True)], strict=True))
            else:
                out.update((w, x.tobytes()) for w, x in zip(part, self._raw([w.decode() for w in part]), strict=True))
        return out

    def learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """The words' encodings. Letters, marks, and letters before marks need their one or two matches only, which may be known."""
        known, single, double, other = self.known, set(), [], []
        for w in words:
            core = w.rstrip(MARKS)
            if core and not self._letters(core):
                other.append(w)
            elif core and len(core) < len(w):
                double.append((w, core, w[len(core) :]))
            else:
                single.add(w)
        for _, core, tail in double:
            if core not in known:
                single.add(core)
            if tail not in known:
                single.add(tail)
        out = self._matches(list(single))
        for w, core, tail in double:
            x, y = out.get(core), out.get(tail)
            out[w] = (known[core] if x is None else x) + (known[tail] if y is None else y)
        if other:
            out.update((w, x.tobytes()) for w, x in zip(other, self._raw([w.decode("utf-8", "replace") for w in other]), strict=True))
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts as little-endian 32-bit integers; nulls are empty."""
        # the tokenizer lower-cases what it reads: words that differ in A-Z alone are one
        words = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
        if len(self.known) > KEPT:
            self.known.clear()
        new = self.learn(set().union(*words).difference(self.known))
        long = {w: x for w, x in new.items() if len(w) > KEPT_BYTES}
        self.known.update(new)
        out = [b"".join(map(self.known.__getitem__, w)) for w in words]
        for w in long:
            del self.known[w]
        return out


def pieces(docs: DataFrame, path: str, capacity: int = 2048, end: int = 0, text: str = "text") -> DataFrame:
    """docs' columns, less the text's, plus piece int, start long, length long and ids (binary, little-endian 32-bit): a row per piece of a document.

    A document is the ids of its whole text by the tokenizer file at path (the Encoder says which kind), then the id end. One longer than
    capacity is cut into pieces of capacity ids, the last of which may be shorter. Null and empty texts are the end alone. Rows that repeat a key are
    documents each, an empty table gives no rows, and a column named like a new one is replaced.
    """
    new = ["piece", "start", "length", "ids"]
    keep = [c for c in docs.columns if c not in (text, *new)]
    schema = docs.select(*map(named, keep)).schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids", "binary")
    names, step, tail = schema.names, 4 * capacity, end.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder.load(path)
        for part, texts in parts(batches, len(keep), most=1 << 20):
            got = [x + tail for x in coder.encode(texts)]
            which = np.repeat(np.arange(len(got)), [-(-len(x) // step) for x in got])
            piece = np.arange(len(which)) - np.searchsorted(which, which)
            made = [got[i][p * step : (p + 1) * step] for i, p in zip(which.tolist(), piece.tolist(), strict=True)]
            more = [pa.array(piece, pa.int32()), pa.array(piece * capacity, pa.int64()), pa.array([len(x) // 4 for x in made], pa.int64()), pa.array(made, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(part.column(i).take(pa.array(which)) for i in range(len(keep))), *more], names)

    return map_batches(docs.select(*map(named, keep), named(text)), tidy(run), schema)


def best_fit(lengths: np.ndarray, capacity: int, order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit of lengths, the longest first or in the given order: (bin, offset) of each, and the bins' free room."""
    order = np.argsort(-lengths, kind="stable") if order is None else order
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins, places = 0, [], []
    for x in lengths[order].tolist():
        fits = mask >> x
        if fits:
            free = x + (fits & -fits).bit_length() - 1
            b = room[free].pop()
            if not room[free]:
                mask &= ~(1 << free)
        else:
            free, b = capacity, len(bins)
            bins.append(capacity)
        places.append((b, capacity - free))
        free -= x
        bins[b] = free
        if free:
            room[free].append(b)
            mask |= 1 << free
    out = np.empty((len(lengths), 2), np.int64)
    out[order] = np.array(places, np.int64).reshape(-1, 2)
    return out[:, 0], out[:, 1], np.array(bins, np.int64)


def lower_bound(counts: np.ndarray, capacity: int) -> float:
    """Of counts[x] pieces of each length x, the share of bins that they fill at least: no packing has fewer bins, so its ceiling is a lower bound.
    The best of three families of dual feasible functions."""
    x = np.arange(capacity + 1)
    n, total = np.cumsum(counts), np.cumsum(counts * x)
    best = int(total[-1]) / capacity
    # short pieces count nothing, those that leave no room for a longer one fill a bin
    small = np.arange(1, capacity // 2 + 1)
    weight = (n[-1] - n[capacity - small]) * capacity + total[capacity - small] - total[small - 1]
    best = max(best, int(weight.max(initial=0)) / capacity)
    # multiples of 1 / (k + 1) of a bin stay, other lengths round down to multiples of 1 / k
    for k in range(1, min(capacity, 100) + 1):
        y = (k + 1) * x
        best = max(best, int((counts * np.where(y % capacity == 0, k * x, y // capacity * capacity)).sum()) / (k * capacity))
    # lengths in units of e, rounded down below half a bin and up above
    for e in range(1, capacity // 2 + 1):
        unit = capacity // e
        w = np.where(2 * x > capacity, 2 * (unit - (capacity - x) // e), np.where(2 * x == capacity, unit, 2 * (x // e)))
        best = max(best, int((counts * w).sum()) / (2 * unit))
    return best


def exchange(lengths: np.ndarray, capacity: int, which: np.ndarray, bound: int, tries: int = TRIES) -> np.ndarray:
    """A packing with fewer bins than the one given (each length's bin) if some are found before the bound is met: bins with gaps and a few others
    give up their pieces to be packed anew by best fit, the longest first but for small changes; what gathers the room in fewer bins stays."""
    rng = np.random.default_rng(len(lengths))
    bins = [x.tolist() for x in np.split(np.argsort(which, kind="stable"), np.cumsum(np.bincount(which))[:-1])]
    room = [capacity - int(lengths[b].sum()) for b in bins]
    while len(bins) > bound and tries > 0:
        tries -= 1
        chance = np.sqrt(np.array(room) + 1.0)
        some = sorted(rng.choice(len(bins), min(len(bins), int(rng.integers(2, 9))), replace=False, p=chance / chance.sum()).tolist(), reverse=True)
        own = np.array([i for b in some for i in bins[b]])
        sizes = lengths[own]
        to, _, free = best_fit(sizes, capacity, np.argsort(-sizes * (1 + 0.3 * rng.random(len(sizes))), kind="stable"))
        if len(free) > len(some):
            continue
        saved = len(some) - len(free)
        if (free**2).sum() + saved * capacity**2 < sum(room[b] ** 2 for b in some):
            continue
        for b in some:
            bins[b], room[b] = bins[-1], room[-1]
            bins.pop()
            room.pop()
        bins += [own[to == j].tolist() for j in range(len(free))]
        room += free.tolist()
    out = np.empty(len(lengths), np.int64)
    for j, b in enumerate(bins):
        out[b] = j
    return out


def packed_group(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """The packing of a group: bin and offset of each length, the bins' free room, and whether the bins hold more room than the bound explains."""
    which, offset, free = best_fit(lengths, capacity)
    filled = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
    if len(free) > _least(filled):
        which = exchange(lengths, capacity, which, _least(filled))
        by = np.argsort(which, kind="stable")
        ends = np.cumsum(lengths[by])
        used = np.bincount(which, lengths).astype(np.int64)
        offset[by] = ends - lengths[by] - np.repeat(np.cumsum(used) - used, np.bincount(which))
        free = capacity - used
    return which, offset, free, len(free) > filled + 1e-6


def _least(filled: float) -> int:
    """The bins that are filled so far at least; far from the next number by more than a rounding error."""
    return math.ceil(filled - 1e-9 * max(1.0, filled))


def pack(items: DataFrame, length: str = "length", capacity: int = 2048, group: int = GROUP, rounds: int = ROUNDS) -> DataFrame:
    """items' columns plus sequence_id long and offset long: each row's sequence and its place there; sequences hold at most capacity and no gaps.

    Runs eagerly, a job per round. Rows whose length is null, below 1 or above the capacity aren't packed: their sequence and offset are null. Equal
    rows are packed each; an empty table gives no rows. Columns named like the new ones are replaced, others come along unread.
    """
    spark = items.sparkSession
    keep = [c for c in items.columns if c not in ("sequence_id", "offset")]
    rows = cut(items.select(F.struct(*map(named, keep)).alias("row"), named(length).cast("long").alias("length"), F.monotonically_increasing_id().alias("rid")), "pk-items")
    counts = np.zeros(capacity + 1, np.int64)
    for r in rows.where(f"length between 1 and {capacity}").groupBy("length").count().collect():  # a row per length
        counts[r["length"]] = r["count"]
    full = int(counts[capacity])
    bound = _least(lower_bound(counts, capacity)) - full
    alone = F.when(F.col("length") == capacity, -1 - F.col("rid"))
    done = [rows.where(f"length is null or not length between 1 and {capacity - 1}").select("row", alone.alias("sequence_id"), F.when(F.col("length") == capacity, F.lit(0).cast("long")).alias("offset"))]
    open_, left, settled, best, least = rows.where(f"length between 1 and {capacity - 1}").select("row", "length", "rid"), int(counts.sum()) - full, 0, None, 0
    for i in range(rounds):
        if not left:
            break
        packed = cut(_round(open_, -(-left // group), i, capacity), f"pk-round{i}")
        first = F.col("offset") == 0
        bins, moving, after = packed.agg(F.count(F.when(first, 1)), F.count(F.when(first & F.col("moves"), 1)), F.count(F.when(F.col("moves"), 1))).first()
        if best is not None and bins >= least:
            break  # the exchange saved nothing: what was there before stays
        best, least = packed, bins
        if settled + bins <= bound or left <= group:
            break
        done.append(packed.where("not moves"))
        settled += bins - moving
        best, least, left = packed.where("moves"), moving, after
        open_ = best.select("row", "length", "rid")
    sweep(spark)
    for d in [*done[1:], *([best] if best is not None else [])]:
        done[0] = done[0].union(d.select("row", "sequence_id", "offset"))
    return done[0].select("row.*", "sequence_id", "offset")


def _round(rows: DataFrame, groups: int, number: int, capacity: int) -> DataFrame:
    """rows (row, length, rid), dealt anew to groups and packed there: sequence_id and offset, and moves: whether another packing with other groups
    may save room, as the sequence isn't full and the group has more sequences than its lengths fill by the bound."""
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("rid", F.lit(number)), F.lit(groups)))
    schema = rows.schema.add("sequence_id", "long").add("offset", "long").add("moves", "boolean")

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("rid")
        part = t.column("part")[0].as_py()
        lengths = t.column("length").to_numpy()
        which, offset, free, gaps = packed_group(lengths, capacity)
        made = [pa.array((number << 56) + (part << 24) + which), pa.array(offset), pa.array((free[which] > 0) & gaps)]
        return pa.table([*t.drop_columns(["part"]).columns, *made], names=schema.names)

    return dealt.groupBy("part").applyInArrow(run, schema)
