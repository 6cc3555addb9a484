"""Approximate nearest neighbours by largest inner product: a robust-pruned directed graph per shard, searched by beam.

Every row is in the index: rows are dealt by a hash into shards of about ``shard`` distinct vectors, so an index part has a bounded
size. A shard's graph is built in growing batches (greedy beam searches propose neighbours, relaxed distance pruning keeps
diverse edges, reverse edges are pruned when they overflow), as in DiskANN. Inner products become distances by one more
component. Where norms differ a shard holds a graph per band of norms, searched from the longest vectors on until no band can hold a
better score. A vector within a small ball around a node stands behind it: it isn't a node of its own (a group of near copies would
fill every beam that meets it) but is scored whenever the node is found. The index is a table, a packed row per shard. A task reads one
shard once and streams packed blocks of queries past it, so what moves are the queries; few shards are read by several tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailhead.llm.common import cut, named
from trailhead.llm.near_vectors import matrix, plain_vector, usable
from trailhead.llm.textops import list_column, tidy


class Graph:
    """A robust-pruned graph over the rows of x (float32), by Euclidean distance. rep: each row's node, itself or one at a
    squared distance of at most ball times both rows' scale (their own squared norms before they were lifted; 1 if none is given), so that
    how far apart near copies are doesn't hang on the longest vector."""

    #: Nodes of a beam that are expanded in one round.
    AT_ONCE = 4

    def __init__(self, x: np.ndarray, degree: int = 32, beam: int = 64, alpha: float = 1.2, ball: float = 0.05, seed: int = 3, scale: np.ndarray | None = None):
        self.scale = np.ones(len(x), np.float32) if scale is None else scale
        self.x, self.degree, self.slots, self.alpha, self.beam = x, degree, degree + degree // 2, alpha, beam
        n = len(x)
        self.edges, self.rep = np.full((n, self.slots), -1, np.int32), np.arange(n, dtype=np.int32)
        if n == 0:
            return
        order = np.random.default_rng(seed).permutation(n)
        middle = int(np.argmin(((x - x.mean(0)) ** 2).sum(1)))
        order = np.concatenate(([middle], order[order != middle]))
        self.start, done = middle, 1
        while done < n:
            batch = order[done : done + max(8, min(done, 2048))]
            done += len(batch)
            found, dist = self.search(x[batch], beam)
            near = dist[:, 0] <= ball * np.minimum(self.scale[batch], self.scale[found[:, 0]])
            self.rep[batch[near]] = found[near, 0]
            batch, found, dist = batch[~near], found[~near], dist[~near]
            own = self._balls(batch, ball)
            batch, found, dist = batch[own], found[own], dist[own]
            self.edges[batch, :degree] = self._prune(batch, found, dist)
            self._reverse(batch)

    def _balls(self, batch: np.ndarray, ball: float) -> np.ndarray:
        """Which rows of a batch become nodes; the others stand behind an earlier row of it."""
        v = self.x[batch]
        vv = (v * v).sum(1)
        of = self.scale[batch]
        close = vv[:, None] + vv[None, :] - 2 * v @ v.T <= ball * np.minimum(of[:, None], of[None, :])
        free = np.ones(len(batch), bool)
        own = np.zeros(len(batch), bool)
        for i in range(len(batch)):
            if free[i]:
                own[i] = True
                self.rep[batch[close[i] & free]] = batch[i]
                free &= ~close[i]
        return own

    def behind(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows ordered by their node, and each node's first place and number of them."""
        count = np.bincount(self.rep, minlength=len(self.x))
        return np.argsort(self.rep, kind="stable"), np.cumsum(count) - count, count

    def search(self, q: np.ndarray, beam: int, block: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """The beam of each query after greedy expansion: (nodes, squared distances), nearest first, -1 where empty."""
        found = [self._search(q[lo : lo + block], beam) for lo in range(0, len(q), block)]
        return tuple(np.concatenate([f[i] for f in found]) if found else np.zeros((0, beam), (np.int32, np.float32)[i]) for i in (0, 1))

    def _search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        n, x = len(q), self.x
        ids, dist = np.full((n, beam), -1, np.int32), np.full((n, beam), np.inf, np.float32)
        ids[:, 0], dist[:, 0] = self.start, ((q - x[self.start]) ** 2).sum(1)
        met = np.full((n, len(x)), -1, np.int32)  # the place among a round's candidates at which a query met a node
        met[:, self.start] = 0
        open_ = ids >= 0
        live = np.arange(n)
        norm, qq = (x * x).sum(1), (q * q).sum(1)
        while len(live):
            # the nearest open nodes of each beam are expanded together: a node that two of them lead to counts once
            pick = open_[live]
            pick &= np.cumsum(pick, 1) <= self.AT_ONCE
            r, c = np.nonzero(pick)
            near = self.edges[ids[live[r], c]]
            open_[live[r], c] = False
            r = np.repeat(r, near.shape[1])
            near = near.reshape(-1)
            fresh = near >= 0
            fresh[fresh] = met[live[r[fresh]], near[fresh]] < 0
            r, near = r[fresh], near[fresh]
            met[live[r], near] = np.arange(len(r), dtype=np.int32)
            once = met[live[r], near] == np.arange(len(r))
            r, near = r[once], near[once]
            count = np.bincount(r, minlength=len(live))
            place = np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
            width = int(count.max(initial=0))
            ni, nd = np.full((len(live), beam + width), -1, np.int32), np.full((len(live), beam + width), np.inf, np.float32)
            no = np.zeros((len(live), beam + width), bool)
            ni[:, :beam], nd[:, :beam], no[:, :beam] = ids[live], dist[live], open_[live]
            ni[r, beam + place], no[r, beam + place] = near, True
            nd[r, beam + place] = norm[near] - 2 * np.einsum("ij,ij->i", x[near], q[live[r]]) + qq[live[r]]
            top = np.argsort(nd, 1, kind="stable")[:, :beam]
            a = np.arange(len(live))[:, None]
            ids[live], dist[live], open_[live] = ni[a, top], nd[a, top], no[a, top]
            live = live[open_[live].any(1)]
        return ids, dist

    def _prune(self, nodes: np.ndarray, cand: np.ndarray, dist: np.ndarray) -> np.ndarray:
        """Up to degree diverse candidates per node, filled up with the nearest of the others."""
        out = np.full((len(nodes), self.degree), -1, np.int32)
        step = max(1, 8_000_000 // max(1, cand.shape[1] ** 2))
        for lo in range(0, len(nodes), step):
            out[lo : lo + step] = self._prune_part(nodes[lo : lo + step], cand[lo : lo + step], dist[lo : lo + step])
        return out

    def _prune_part(self, nodes: np.ndarray, cand: np.ndarray, dist: np.ndarray) -> np.ndarray:
        order = np.argsort(dist, 1, kind="stable")
        a = np.arange(len(nodes))
        cand, dist = cand[a[:, None], order], dist[a[:, None], order]
        ok = (cand >= 0) & (cand != nodes[:, None]) & np.isfinite(dist)
        v = self.x[np.maximum(cand, 0)]
        vv = (v * v).sum(2)
        between = np.maximum(0, vv[:, :, None] + vv[:, None, :] - 2 * v @ v.transpose(0, 2, 1))
        alive, chosen = ok.copy(), np.zeros_like(ok)
        for _ in range(self.degree // 2):
            has = alive.any(1)
            if not has.any():
                break
            p = np.argmax(alive, 1)
            chosen[a[has], p[has]] = True
            # relaxed pruning: a candidate goes if it is nearer, by the factor alpha, to a kept one than to the node
            alive &= ~((self.alpha**2 * between[a, p] <= dist) & has[:, None])
            alive[a, p] = False
        rank = np.where(chosen, 0, np.where(ok, 1, 2))
        keep = np.argsort(rank, 1, kind="stable")[:, : self.degree]
        got = np.where(rank[a[:, None], keep] < 2, cand[a[:, None], keep], -1)
        if got.shape[1] < self.degree:
            got = np.pad(got, ((0, 0), (0, self.degree - got.shape[1])), constant_values=-1)
        return got

    def _reverse(self, batch: np.ndarray) -> None:
        """Add each new edge backwards; nodes without a free slot are pruned over all their edges."""
        near = self.edges[batch, : self.degree]
        r, c = np.nonzero(near >= 0)
        to, src = near[r, c].astype(np.int64), batch[r]
        order = np.argsort(to, kind="stable")
        to, src = to[order], src[order]
        nodes, first, count = np.unique(to, return_index=True, return_counts=True)
        used = (self.edges[nodes] >= 0).sum(1)
        fits = used + count <= self.slots
        place = np.arange(len(to)) - np.repeat(first, count)
        at = np.repeat(used, count) + place
        easy = np.repeat(fits, count)
        self.edges[to[easy], at[easy]] = src[easy]
        full = np.flatnonzero(~fits)
        if len(full):
            # of very many incoming edges the nearest are candidates: the pruned list holds degree edges anyway
            most = 2 * self.slots
            d = ((self.x[to] - self.x[src]) ** 2).sum(1)
            byd = np.lexsort((d, to))
            to, src = to[byd], src[byd]
            cand = np.full((len(full), self.slots + most), -1, np.int32)
            cand[:, : self.slots] = self.edges[nodes[full]]
            for i, f in enumerate(full):
                got = src[first[f] : first[f] + min(count[f], most)]
                cand[i, self.slots : self.slots + len(got)] = got
            cand = np.where(cand == nodes[full][:, None], -1, cand)
            srt = np.sort(cand, 1)
            same = np.zeros_like(srt, bool)
            same[:, 1:] = srt[:, 1:] == srt[:, :-1]
            cand = np.where(same, -1, srt)
            dist = np.where(cand >= 0, ((self.x[np.maximum(cand, 0)] - self.x[nodes[full]][:, None, :]) ** 2).sum(2), np.inf).astype(np.float32)
            self.edges[nodes[full]] = -1
            self.edges[nodes[full], : self.degree] = self._prune(nodes[full], cand, dist)


def _lift(x: np.ndarray) -> np.ndarray:
    """Vectors with one more component, after which the nearest by distance has the largest inner product; scaled to at most 1."""
    top = float(np.sqrt((x * x).sum(1).max(initial=0))) or 1.0
    x = x / top
    return np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))[:, None]], 1).astype(np.float32)


#: Norms of a band lie within this factor, but for bands of fewer vectors than this, which go with the next.
FACTOR, FEW = 1.25, 64


def _bands(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of vectors by bands of their norms, the longest first, and the bands' sizes. Among vectors of like norms the lifted ones'
    distances tell directions apart; where norms differ much they would mostly tell the norms apart."""
    norm = np.sqrt((x * x).sum(1))
    band = np.rint(np.log(norm.max(initial=0) / norm) / np.log(FACTOR)).astype(np.int64)
    order = np.argsort(band, kind="stable")
    sizes: list[int] = []
    for n in np.unique(band, return_counts=True)[1].tolist():
        if sizes and sizes[-1] < FEW:
            sizes[-1] += n
        else:
            sizes.append(n)
    return order, np.array(sizes, np.int64)


def _ranges(sizes: np.ndarray) -> list[tuple[int, int]]:
    ends = np.cumsum(sizes)
    return list(zip((ends - sizes).tolist(), ends.tolist(), strict=True))


INDEX = "dim int, shard int, shards int, ids binary, counts binary, vectors binary, edges binary, rep binary, starts binary, bands binary"


def _good(df: DataFrame, key: str, vec: str) -> tuple[DataFrame, str]:
    column, kind = plain_vector(df, vec)
    return df.where(usable(vec) & named(key).isNotNull()).select(named(key).cast("long").alias("k"), column.alias("v")).withColumn("dim", F.size("v")), kind


def build_index(df: DataFrame, key: str, vec: str, shard: int = 16384, degree: int = 32, beam: int = 48, alpha: float = 1.2) -> DataFrame:
    """The index as a written table, a row per shard and vector length: shard, shards, dim, n, ids and copies' offsets,
    vectors (in their own precision), edges. Rows with equal vectors share a node, where their keys stand in ascending order, a repeated key
    once. Rows without a key or a usable vector aren't in it; an empty table gives an empty index; other columns aren't read."""
    good, kind = _good(df, key, vec)
    sizes = good.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("shards"))
    dealt = good.join(sizes, "dim").withColumn("shard", F.pmod(F.xxhash64("k"), F.col("shards")).cast("int"))

    def build(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        dim, at, shards = (part.column(c)[0].as_py() for c in ("dim", "shard", "shards"))
        v = part.column("v")
        x = matrix(v.chunk(0) if isinstance(v, pa.ChunkedArray) else v, np.arange(len(part)), dim)
        nodes, of = np.unique(x, axis=0, return_inverse=True)
        order, bands = _bands(nodes)
        place = np.empty(len(nodes), np.int64)
        place[order] = np.arange(len(nodes))
        nodes = nodes[order]
        of, keys = np.unique(np.stack([place[of.reshape(-1)], part.column("k").to_numpy()]), axis=1)  # by node, then key
        graphs = []
        for lo, hi in _ranges(bands):
            lifted = _lift(nodes[lo:hi])
            graphs.append(Graph(lifted, degree, beam, alpha, scale=(lifted[:, :-1] ** 2).sum(1)))
        edges, rep, starts = (b"".join(x) for x in zip(*[(g.edges.tobytes(), g.rep.tobytes(), np.int32(g.start).tobytes()) for g in graphs], strict=True))
        made = (dim, at, shards, keys.tobytes(), np.bincount(of, minlength=len(nodes)).astype(np.int64).tobytes(), nodes.astype(kind).tobytes(), edges, rep, starts, bands.astype(np.int32).tobytes())
        names = [c.split()[0] for c in INDEX.split(", ")]
        return pa.table([[c] for c in made], pa.schema([(n, pa.binary() if isinstance(c, bytes) else pa.int32()) for n, c in zip(names, made, strict=True)]))

    # a stated number of partitions, so that adaptive execution doesn't put small shards, which are slow to build, in one task
    parts = 4 * (sizes.agg(F.sum("shards")).first()[0] or 1)
    out = cut(dealt.select("dim", "shard", "shards", "k", "v").repartition(parts, "dim", "shard").groupBy("dim", "shard").applyInArrow(build, INDEX), "ann-index")
    out.kind = kind
    return out


class Shard:
    """A shard of the index, unpacked for searches."""

    def __init__(self, dim: int, ids: bytes, counts: bytes, vectors: bytes, edges: bytes, rep: bytes, starts: bytes, bands: bytes, kind: str):
        self.x = np.frombuffer(vectors, kind).reshape(-1, dim).astype(np.float64)
        self.counts, self.ids = np.frombuffer(counts, np.int64), np.frombuffer(ids, np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        every, behind = np.frombuffer(edges, np.int32).reshape(len(self.x), -1), np.frombuffer(rep, np.int32)
        self.parts = []
        for (lo, hi), start in zip(_ranges(np.frombuffer(bands, np.int32)), np.frombuffer(starts, np.int32).tolist(), strict=True):
            g = Graph.__new__(Graph)
            g.x, g.start, g.edges, g.rep = _lift(self.x[lo:hi]), start, every[lo:hi], behind[lo:hi]
            self.parts.append((lo, float(np.sqrt((self.x[lo:hi] ** 2).sum(1).max())), g, g.behind()))

    def look(self, q: np.ndarray, qid: np.ndarray, k: int, beam: int) -> list[list[tuple[int, float]]]:
        """The k best (key, score) per query that beam searches find, best first, equal scores by the smaller key.

        Bands are searched from the longest vectors on; one that can't hold a score as large as a query's k-th so far is skipped, which loses nothing.
        """
        norm = np.linalg.norm(q, axis=1)
        lifted = np.concatenate([q / norm[:, None], np.zeros((len(q), 1))], 1).astype(np.float32)
        out: list[list[tuple[int, float]]] = [[] for _ in q]
        least = np.full(len(q), -np.inf)
        for lo, top, graph, (members, begin, size) in self.parts:
            go = np.flatnonzero(top * norm * (1 + 1e-9) >= least)
            if not len(go):
                break
            found, _ = graph.search(lifted[go], beam)
            for i, row in zip(go.tolist(), found, strict=True):
                row = row[row >= 0]
                many = size[row]
                row = lo + members[np.repeat(begin[row] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
                score = self.x[row] @ q[i]
                # equal scores go by the smallest key behind the vector, its keys being in ascending order
                best = np.lexsort((self.ids[self.first[row]], -score))[: k + 1]
                # copies of one vector: the k + 1 smallest keys suffice, one may be the query's own
                kk = [(v, s) for s, n in zip(score[best].tolist(), row[best].tolist(), strict=True) for v in self.ids[self.first[n] : self.first[n] + min(self.counts[n], k + 1)].tolist() if v != qid[i]]
                out[i] = sorted(out[i] + kk, key=lambda t: (-t[1], t[0]))[:k]
                least[i] = out[i][-1][1] if len(out[i]) == k else -np.inf
        return out


def search(queries: DataFrame, index: DataFrame, key: str, vec: str, k: int = 20, beam: int = 160, block: int = 1024, kind: str | None = None) -> DataFrame:
    """The k nearest rows that beam search finds per query in all shards: query_id, rank, vec_id, score.

    A row is never its own answer, nor is another row of its key. Scores are inner products of the original vectors in double precision;
    equal scores go by the smaller vec_id. Queries that are null, zero or hold null or non-finite components get no rows; of queries
    that repeat a key the one with the smallest vector is searched. An empty table or index gives no rows. kind: the NumPy type of the
    index's vectors, if it wasn't built just now.
    """
    kind = kind or getattr(index, "kind", "f8")
    good, own = _good(queries, key, vec)
    good = good.groupBy("k", "dim").agg(F.min("v").alias("v"))
    sizes = good.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    good = good.join(sizes, "dim").withColumn("block", F.pmod(F.xxhash64("k", F.lit(1)), F.col("blocks")).cast("int"))

    def pack(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        dim, at, v = part.column("dim")[0].as_py(), part.column("block")[0].as_py(), part.column("v")
        x = matrix(v.chunk(0) if isinstance(v, pa.ChunkedArray) else v, np.arange(len(part)), dim).astype(own)
        return pa.table({"dim": pa.array([dim], pa.int32()), "block": pa.array([at], pa.int32()), "qids": pa.array([part.column("k").to_numpy().tobytes()], pa.binary()), "qvectors": pa.array([x.tobytes()], pa.binary())})

    packed = cut(good.select("dim", "block", "k", "v").groupBy("dim", "block").applyInArrow(pack, "dim int, block int, qids binary, qvectors binary"), "ann-queries")
    # tasks of a shard: more than one only where there are fewer shards than cores
    plan = index.groupBy("dim").agg(F.max("shards").alias("shards")).join(packed.groupBy("dim").agg(F.count(F.lit(1)).alias("blocks")), "dim")
    cores = F.lit(2 * index.sparkSession.sparkContext.defaultParallelism)
    plan = cut(plan.withColumn("lanes", F.greatest(F.lit(1), F.least("blocks", F.ceil(cores / F.col("shards")))).cast("int")), "ann-plan")
    sent = packed.join(plan, "dim").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).withColumn("lane", F.pmod("block", "lanes"))
    there = index.drop("shards").join(plan.select("dim", "lanes"), "dim").withColumn("lane", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1))).withColumn("block", F.lit(-1))
    stream = there.drop("lanes").unionByName(sent.drop("shards", "blocks", "lanes"), allowMissingColumns=True)
    names = ["dim", "block", "ids", "counts", "vectors", "edges", "rep", "starts", "bands", "qids", "qvectors"]

    def look(batches):
        shard = None
        for b in batches:
            for i in range(b.num_rows):
                dim, at, *packed, qids, qvectors = (b.column(n)[i].as_py() for n in range(len(names)))
                if at < 0:
                    shard = None  # before the next is unpacked
                    shard = Shard(dim, *packed, kind)
                    continue
                q, qid = np.frombuffer(qvectors, own).reshape(-1, dim).astype(np.float64), np.frombuffer(qids, np.int64)
                for lo in range(0, len(q), 256):
                    found = shard.look(q[lo : lo + 256], qid[lo : lo + 256], k, beam)
                    ids, scores = list_column([np.array([v for v, _ in f], np.int64) for f in found]), [s for f in found for _, s in f]
                    yield pa.RecordBatch.from_arrays([pa.array(qid[lo : lo + 256]), ids, pa.ListArray.from_arrays(ids.offsets, pa.array(scores, pa.float64()))], ["query_id", "v", "s"])

    tasks = plan.agg(F.sum(F.col("shards") * F.col("lanes"))).first()[0] or 1
    stream = stream.repartition(max(1, min(tasks, 100_000)), "dim", "shard", "lane").sortWithinPartitions("dim", "shard", "lane", "block").select(*names)
    found = cut(stream.mapInArrow(tidy(look), "query_id long, v array<long>, s array<double>"), "ann-found")
    each = found.select("query_id", F.explode(F.arrays_zip("s", "v")).alias("a")).select("query_id", F.col("a.v").alias("vec_id"), F.col("a.s").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = each.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return top.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
