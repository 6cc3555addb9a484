"""Near-duplicate embeddings by a forest of random-projection trees with spill overlap.

1. Vectors that can link (no null, not zero, all components finite) are collapsed to one row per distinct
   (label, vector); copies are a weight.
2. Every row descends all trees. A node's hyperplane is drawn from a fixed pool by a hash of the node's path, so no
   tree is fitted, shipped or held anywhere; depth grows with the logarithm of the label's count. A row within
   ``spill`` of a hyperplane goes down both sides, so a pair that a tree separates must straddle a wide band. A deeper tree
   separates more pairs; there are as many trees as keep the chance that all separate a pair at the threshold below ``miss``.
3. A row's leaves are written beside its vector, once. Rows meet by leaf. A leaf above ``block`` rows is dealt out as
   pairs of salted blocks, so no task holds an unbounded leaf and no row is left out. Blocks are compared by one matrix
   product in double precision.
4. A pair seen in several leaves counts only in the first leaf that both rows share, so counts need no list of pairs.
   Leaves return per row a count and the smallest linked row; those star edges are united by ``components``.

Linked pairs are verified exactly; the forest may miss a pair only if every tree separates it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailhead.llm.common import components, cut, named, small_side
from trailhead.llm.textops import list_column, tidy

#: Distinct hyperplanes in the pool that nodes draw from.
POOL = 4096


def usable(vec: str):
    """A condition: the vector is not null or zero and no component is null or non-finite."""
    v = named(vec)
    x = F.transform(v, lambda a: a.cast("double"))
    return F.coalesce(v.isNotNull() & F.forall(x, lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) < F.lit(float("inf")))) & F.exists(x, lambda a: a != 0), F.lit(False))


def plain_vector(df: DataFrame, vec: str):
    """(column, NumPy type) of vectors as they go to Python: single precision stays so, anything else is double."""
    kind = df.schema[vec].dataType
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType):
        return named(vec), "f4"
    return F.transform(named(vec), lambda a: a.cast("double")), "f8"


def matrix(column: pa.Array, rows: np.ndarray, width: int) -> np.ndarray:
    """Some rows of a list column, all of one length, as a matrix."""
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    return column.flatten().to_numpy(zero_copy_only=False)[ends[rows][:, None] - width + np.arange(width)]


def units(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def trees_for(depth: int, threshold: float, spill: float, miss: float, least: int = 4, most: int = 24) -> int:
    """How many trees of a depth leave a pair at the threshold apart in all with a chance below miss; one where there is a single leaf.

    The difference of a pair's projections is normal with the pair's distance as deviation, and a node parts the pair if its hyperplane lies
    between them with the band on either side.
    """
    if depth < 1:
        return 1
    far = math.sqrt(2 - 2 * threshold)
    a = 2 * spill / far
    beyond = 2 * far * (math.exp(-a * a / 2) / math.sqrt(2 * math.pi) - a * math.erfc(a / math.sqrt(2)) / 2)
    parted = 1 - (1 - beyond / math.sqrt(2 * math.pi)) ** depth
    return max(least, min(most, math.ceil(math.log(miss) / math.log(parted))))


def _hash(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def leaves_of(unit: np.ndarray, depth: np.ndarray, trees: np.ndarray, group: np.ndarray, spill: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of unit vectors: each row's leaves in all trees of its group. Leaf ids begin with the tree's number."""
    pool = np.random.default_rng([seed, unit.shape[1]]).standard_normal((POOL, unit.shape[1]))
    rows, leaves = [], []
    for t in range(int(trees.max(initial=0))):
        at = np.flatnonzero(trees > t)
        node = _hash(group[at].astype(np.int64).view(np.uint64) + np.uint64(t * 7919 + seed))
        for level in range(int(depth[at].max(initial=0))):
            down = depth[at] > level
            plane = (node % np.uint64(POOL)).astype(np.int64)
            side = np.einsum("ij,ij->i", unit[at], pool[plane])
            left, right = down & (side < spill), down & (side > -spill)
            at = np.concatenate([at[~down], at[left], at[right]])
            node = np.concatenate([node[~down], _hash(node[left] * np.uint64(2)), _hash(node[right] * np.uint64(2) + np.uint64(1))])
        rows.append(at)
        leaves.append((np.uint64(t) << np.uint64(56)) | (node >> np.uint64(8)))
    return np.concatenate(rows), np.concatenate(leaves).view(np.int64)


_LINKS = pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("root", pa.int64())])


def _compare(part: pa.Table, threshold: float, kind: str) -> pa.Table:
    """Links of one block with itself or of two blocks: per row the weight linked first here, and the smallest row linked."""
    part = part.combine_chunks()
    mine, lo, hi = (part.column(c)[0].as_py() for c in ("leaf", "lo", "hi"))
    salt = part.column("salt").to_numpy()
    rep, w, d = (part.column(c).to_numpy() for c in ("rep", "w", "d"))
    vec, leaves = part.column("vec"), part.column("leaves")
    ia, ib = np.flatnonzero(salt == lo), np.flatnonzero(salt == hi)
    if not len(ia) or not len(ib) or len(rep) < 2:
        return _LINKS.empty_table()
    x, y = (units(np.frombuffer(b"".join(vec[i].as_py() for i in at.tolist()), kind).reshape(len(at), int(d[0]))) for at in (ia, ib))
    hit = x @ y.T >= threshold
    if lo == hi:
        np.fill_diagonal(hit, False)
    ja, jb = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
    if not len(ja):
        return _LINKS.empty_table()
    hit, ia, ib = hit[np.ix_(ja, jb)], ia[ja], ib[jb]
    la, lb = ([[v for v in leaves[i].as_py() if v < mine] for i in at.tolist()] for at in (ia, ib))
    place = {v: i for i, v in enumerate(sorted({v for r in la for v in r} & {v for r in lb for v in r}))}
    first = hit.copy()
    if place:
        ma, mb = np.zeros((len(la), len(place)), np.float32), np.zeros((len(lb), len(place)), np.float32)
        for m, rows in ((ma, la), (mb, lb)):
            for i, r in enumerate(rows):
                m[i, [place[v] for v in r if v in place]] = 1
        first &= ma @ mb.T == 0
    big = np.iinfo(np.int64).max
    out = [(rep[ia], first @ w[ib], np.minimum(np.where(hit, rep[ib], big).min(1), rep[ia]))]
    if lo != hi:
        out.append((rep[ib], first.T @ w[ia], np.minimum(np.where(hit.T, rep[ia], big).min(1), rep[ib])))
    return pa.table([np.concatenate(c) for c in zip(*out, strict=True)], _LINKS)


def near_duplicates(df: DataFrame, key: str = "vec_id", vec: str = "embedding", label: str = "label", threshold: float = 0.98, spill: float = 0.15, miss: float = 1e-6, leaf: int = 256, block: int = 2048, seed: int = 17) -> DataFrame:
    """One row per row of df: key, n_links long, component_id long, kept boolean.

    Rows link when their labels are equal and not null, their lengths are equal and their cosine is at least
    threshold. A vector that is null, zero or holds null or non-finite components, or whose label or key is null,
    links with nothing: n_links 0 and its own key as component. Rows that repeat a key with equal vectors are copies and
    link with one another. An empty table gives no rows; other columns are ignored, whatever their names. Equal vectors are found by
    128 bits of hashes of theirs.
    """
    column, kind = plain_vector(df, vec)
    rows = df.select(named(key).cast("long").alias("k"), column.alias("v"), named(label).alias("g"))
    ok = usable("v") & F.col("g").isNotNull() & F.col("k").isNotNull()
    same = ["g", "a", "b"]
    rows = rows.withColumn("ok", ok).withColumn("a", F.when(F.col("ok"), F.xxhash64("v"))).withColumn("b", F.when(F.col("ok"), F.xxhash64(F.lit(1), "v")))
    reps = rows.where("ok").groupBy(*same).agg(F.min("k").alias("rep"), F.count(F.lit(1)).alias("w"), F.first("v").alias("v"))
    reps = cut(reps.withColumn("d", F.size("v")), "nv-reps")
    sizes = cut(reps.groupBy("g", "d").agg(F.count(F.lit(1)).alias("n")), "nv-sizes")
    given = reps.join(small_side(sizes, sizes.count()), ["g", "d"]).select("rep", "w", "d", "n", F.xxhash64("g", "d").alias("h"), "v")

    def descend(batches):
        for b in batches:
            rep, w, d, n, h = (b.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            for width in np.unique(d).tolist():
                at = np.flatnonzero(d == width)
                x = matrix(b.column(5), at, width)
                depth = np.ceil(np.log2(np.maximum(1, n[at] / leaf))).astype(int)
                trees = np.array([trees_for(v, threshold, spill, miss) for v in range(int(depth.max()) + 1)])[depth]
                row, node = leaves_of(units(x), depth, trees, h[at], spill, seed)
                order = np.lexsort((node, row))
                own = np.split(node[order], np.cumsum(np.bincount(row, minlength=len(at)))[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(rep[at]), pa.array(w[at]), pa.array(d[at], pa.int32()), pa.array([r.astype(kind).tobytes() for r in x], pa.binary()), list_column(own)], ["rep", "w", "d", "vec", "leaves"])

    placed = cut(given.mapInArrow(tidy(descend), "rep long, w long, d int, vec binary, leaves array<long>"), "nv-leaves")
    large = placed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count(F.lit(1)).alias("m")).where(f"m > {block}")
    large = cut(large.select("leaf", F.ceil(F.col("m") / block).cast("int").alias("k")), "nv-large")
    dealt = placed.select("*", F.explode("leaves").alias("leaf")).join(small_side(large, large.count()), "leaf", "left").withColumn("k", F.coalesce("k", F.lit(1)))
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("k")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("o")
    dealt = dealt.select("*", other).select("leaf", "rep", "w", "d", "vec", "leaves", "salt", F.least("salt", "o").alias("lo"), F.greatest("salt", "o").alias("hi"))
    links = dealt.groupBy("leaf", "lo", "hi").applyInArrow(lambda p: _compare(p, threshold, kind), "rep long, n long, root long")
    links = cut(links.groupBy("rep", "root").agg(F.sum("n").alias("n")), "nv-links")
    counts = links.groupBy("rep").agg(F.sum("n").alias("n"))
    roots = components(links.select(F.col("rep").alias("u"), F.col("root").alias("v"))).withColumnsRenamed({"node": "rep"})
    done = reps.select(*same, "rep", "w").join(counts, "rep", "left").join(roots, "rep", "left")
    done = done.select(*[F.col(c).alias(f"{c}2") for c in same], (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    # rows that can't link have no hashes and find no match
    out = rows.select("k", *same).join(done, (F.col("g") == F.col("g2")) & (F.col("a") == F.col("a2")) & (F.col("b") == F.col("b2")), "left")
    comp = F.coalesce("component_id", "k")
    return out.select(F.col("k").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(F.col("k") == comp, F.lit(True)).alias("kept"))
