"""N-gram Jaccard join by set-relation skipping (after Wang et al., "Leveraging set relations in exact set similarity join").

A document's set is its distinct word shingles as 64-bit hashes. Equal sets are one node from the start. All sets
share one order of shingles: by a class of how common a shingle is (from a fixed-size sketch of all documents' counts,
rarest first), then by hash. By the prefix principle two sets can only link if they share a shingle among the
first few of each; these form the inverted index, whose entries hold set size and position.

* Counting: the index takes a twelfth of a set more than the principle asks, so sets that link share at least a twelfth as
  many lists (and one); pairs that share fewer are skipped. A set with fewer long lists than that shares a short one with
  whatever it links to, so all sets are searched by short lists. Sets with more long lists are a crowd (copies of one thing, or
  mostly a passage that thousands share): among these shingles are counted exactly and ordered anew, rarest first.
* Relation first: every set is compared with the reference set that shares most index lists with it (the smallest node of
  each list), which unites most groups of near copies by as many comparisons as there are members. In the crowd the reference
  is the set with the fewest shingles of its own: copies that differ too much from one another still link to their original.
* Index-level skipping: lists are cut into blocks by set size, so only blocks of sizes that can link meet, and entries
  whose positions leave too few shingles are skipped. Within a list, entries with one reference set stand together as one entry
  with their bounds; entries of one component are not compared.
* Answer-level skipping: the overlap of two reference sets is computed once; a set that differs from its reference by few
  shingles gets its answers from it, as its overlap with any set lies within that difference; shingles that it alone has in the crowd don't
  count. Only pairs that stay open are expanded to
  their members and verified one by one.

All comparisons are exact, so components are those of all links. Nothing is sampled or capped.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailhead.llm.common import components, cut, discard, extend, named, small_side, sweep
from trailhead.llm.textops import list_column, parts, shingle_set, tidy

#: Counters in the sketch from which the order's classes come; its size doesn't depend on the data.
SLOTS, CHUNKS = 1 << 20, 32
#: The index holds one entry more per so many shingles than the prefix principle asks; linking sets share that many lists and one.
MORE = 12
#: Lists of so many entries are long: they are left to the sets that could link by long lists alone.
LONG = 32
#: Parts of the index, by list name, that are shuffled one after another: disk holds the shuffle files of one only.
PASSES = 3
#: First halves of digests that several sets may have; with 10^11 sets some 300 are expected.
CLASHES = 1_000_000


def _digest(prints: np.ndarray) -> tuple[int, int]:
    """The halves of a 128-bit digest of a set."""
    d = hashlib.blake2b(prints.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _node(prints: np.ndarray, clash: frozenset[int]) -> int:
    """A set's name: half of its digest, the other half where several sets have the first."""
    a, b = _digest(prints)
    return b if a in clash else a


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(named(key).alias("doc"), named(text).alias("text"))


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """Of docs (doc, text) a row per document (kind 0: doc, n, node, other) and a few per task (kind 1: counters of shingles, packed)."""
    schema = docs.select(F.lit(0).alias("kind"), "doc").schema.add("n", "long").add("node", "long").add("other", "long").add("data", "binary")
    names = schema.names

    def run(batches):
        counts, kind = np.zeros(SLOTS, np.int64), None
        for part, texts in parts(batches, 1):
            sets = [shingle_set(t, k) for t in texts]
            kind = part.schema.field(0).type
            halves = [_digest(s) for s in sets]
            counts += np.bincount((np.concatenate(sets) >> np.uint64(40)).astype(np.int64) & (SLOTS - 1), minlength=SLOTS)
            m = len(texts)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(m, np.int32)), part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([a for a, _ in halves], pa.int64()), pa.array([b for _, b in halves], pa.int64()), pa.nulls(m, pa.binary())], names)
        step = SLOTS // CHUNKS
        some = [(c, zlib.compress(x.tobytes(), 1)) for c in range(CHUNKS) if (x := counts[c * step : (c + 1) * step]).any()]
        if some:
            m = len(some)
            zero = pa.array(np.zeros(m, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int32)), pa.nulls(m, kind), pa.array([c for c, _ in some], pa.int64()), zero, zero, pa.array([x for _, x in some], pa.binary())], names)

    return docs.mapInArrow(tidy(run), schema)


def _classes(sketch: DataFrame) -> np.ndarray:
    """The order's class of each slot: 0 for counts up to twice the mean, one more for each doubling. SLOTS bytes on the driver."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for c, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                part = np.frombuffer(zlib.decompress(data.as_buffer()), np.int64)
                sums[c] = sums[c] + part if c in sums else part
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["n", "data"])

    counts = np.zeros(SLOTS, np.int64)
    step = SLOTS // CHUNKS
    for r in sketch.repartition(CHUNKS, "n").mapInArrow(tidy(add), "n long, data binary").collect():  # CHUNKS rows, 8 * SLOTS bytes in all
        counts[r["n"] * step : (r["n"] + 1) * step] += np.frombuffer(r["data"], np.int64)
    mean = max(1.0, counts.mean())
    return np.maximum(0, np.floor(np.log2(np.maximum(counts, 1) / mean))).astype(np.uint8)


def _ordered(s: np.ndarray, classes: np.ndarray) -> np.ndarray:
    return s[np.lexsort((s, classes[(s >> np.uint64(40)).astype(np.int64) & (SLOTS - 1)]))]


def set_components(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4, percent: int = 85) -> DataFrame:
    """One row per row of docs: key, n_shingles long, component_id (smallest key reachable by links, its own included).

    Two documents link when 100 * |A and B| >= percent * |A or B| of their sets of distinct k-word shingles (A-Z
    lower-cased; a shorter text is one shingle). Texts that are null or hold no word have an empty set and link with nothing, not
    even with one another. Null keys take part but never name a component unless all its keys are null. Rows with one
    key may have different texts; each is a row of its own. An empty table gives no rows; other columns aren't read.
    """
    out, _ = _rows(_texts(docs, key, text), k, percent)
    return out.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), "component_id")


def _rows(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, frozenset[int]]:
    """Of docs (doc, text): (doc, n, node, root, component_id) per row, where root tells components apart that are named by one key; and the
    clashes by which ``_node`` names sets."""
    both = cut(_sets(docs, k), "jj-sets")
    sets = both.where("kind = 0").drop("kind", "data")
    classes = _classes(both.where("kind = 1").select("n", "data"))
    # equal first halves of different digests: these sets are named by the other half
    twice = sets.where("n > 0").groupBy("node").agg(F.min("other").alias("a"), F.max("other").alias("b")).where("a <> b").select("node")
    clash = frozenset(r["node"] for r in twice.limit(CLASHES + 1).collect())  # at most CLASHES
    if len(clash) > CLASHES:
        raise ValueError("too many sets share half of a digest")
    if clash:
        sets = sets.withColumn("node", F.when(F.col("node").isin(*clash), F.col("other")).otherwise(F.col("node")))
    nodes = sets.where("n > 0").groupBy("node", "n").agg(F.min("doc").alias("doc"))
    roots = _links(docs, k, percent, classes, nodes, clash)
    joined = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = joined.groupBy("root").agg(F.min("doc").alias("component_id"))
    many = joined.select("node", "root").join(best, "root").select("node", "root", "component_id")
    alone = F.when(F.col("n") == 0, F.col("doc"))
    out = sets.select("doc", "n", "node").join(many, "node", "left")
    return out.select("doc", "n", "node", "root", F.coalesce(alone, F.when(F.col("n") > 0, F.col("component_id"))).alias("component_id")), clash


def _need(a, b, percent: int):
    """Smallest overlap with which sets of these sizes link."""
    return F.floor((percent * (a + b) + 99 + percent) / (100 + percent))


def _links(docs: DataFrame, k: int, percent: int, classes: np.ndarray, nodes: DataFrame, clash: frozenset[int]) -> DataFrame:
    """(node, root): components of more than one node, equal sets being one node (nodes: node, n, doc). Tables and shuffle files go as soon as
    no later step reads them."""
    known_docs = nodes.select("node", "doc")

    def prefixes(batches):
        for _, texts in parts(batches, 0):
            sets = [s for t in texts if len(s := shingle_set(t, k))]
            # list names keep 40 bits of a hash: two shingles in one list only make more candidates
            heads = [_ordered(s, classes)[: len(s) - (percent * len(s) + 99) // 100 + 1 + len(s) // MORE] >> np.uint64(24) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array([_node(s, clash) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), list_column(heads)], ["node", "n", "head"])

    heads = docs.select("text").mapInArrow(tidy(prefixes), "node long, n int, head array<long>")
    heads = cut(heads.groupBy("node").agg(F.first("n").alias("n"), F.first("head").alias("head")), "jj-heads")
    index = heads.select("node", "n", F.posexplode("head").alias("pos", "s"))
    indexes = []
    for i in range(PASSES):
        some = index.where(F.pmod("s", F.lit(PASSES)) == i)
        lists = some.groupBy("s").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        indexes.append(cut(some.join(lists, "s"), "jj-index"))
        sweep(docs.sparkSession)
    shared = reduce(DataFrame.union, indexes)
    discard(heads)

    # relation first: the reference that shares most lists, if these are about as many as a link asks
    low = shared.groupBy("s").agg(F.min("node").alias("low"))
    votes = shared.join(low, "s").where("node <> low").groupBy("node", "low").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n"))
    refs = votes.where(f"c > n / {MORE}").groupBy("node").agg(F.max(F.struct("c", "low")).alias("m")).select(F.col("node").alias("u"), F.col("m.low").alias("v"))
    refs = cut(refs, "jj-refs")
    sweep(docs.sparkSession)

    linked = F.expr(f"100 * both >= {percent} * (nu + nv - both)")

    def compare(pairs: DataFrame, name: str, then: Callable[[DataFrame], DataFrame]) -> DataFrame:
        sets = _compared(docs, k, pairs, known_docs, clash)
        out = cut(then(_overlaps(pairs, sets)), name)
        discard(sets)
        sweep(docs.sparkSession)
        return out

    near = compare(refs, "jj-near", lambda met: met.where(linked))
    first = near.select("u", "v")
    comp = components(first)

    # short lists: all sets; a pair may share some of the long ones too, at most as many as either set has
    ref = near.select(F.col("u").alias("node"), F.col("v").alias("ref"), (F.col("nu") - F.col("both")).alias("extra"))
    long = shared.where(f"c >= {LONG}")
    held = cut(long.groupBy("node").agg(F.count(F.lit(1)).alias("h"), F.first("n").alias("n")), "jj-held")
    short = shared.where(f"c < {LONG}").select("s", "node", "n", "pos").join(held.select("node", "h"), "node", "left").withColumn("h", F.coalesce("h", F.lit(0)))
    short = short.withColumn("stays", F.col("h") > F.floor(percent * F.col("n") / (100 * MORE)))

    # long lists: only sets that have more of them than a link may leave to the short ones, and that meet another component there. Among
    # these few sets shingles are counted exactly and ordered anew, rarest first, so what many of them share comes last
    stay = held.where(f"h > floor({percent} * n / {100 * MORE})").select("node")
    rooted = long.select("s", "node").join(stay, "node", "left_semi").join(comp, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rooted.groupBy("s").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("s")
    crowd = cut(rooted.join(mixed, "s", "left_semi").select("node").distinct(), "jj-crowd")
    crowded = not crowd.isEmpty()
    if crowded:
        own = _sets_of(docs, k, crowd, known_docs, clash).select("node", F.size("s").alias("n"), F.explode("s").alias("s")).withColumn("s", F.shiftrightunsigned("s", 24))
        own = cut(own, "jj-own")
        counts = own.groupBy("s").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        common = own.join(counts, "s").withColumn("common", F.count(F.lit(1)).over(Window.partitionBy("node")))
        order = Window.partitionBy("node").orderBy("c", "s")  # a window holds one document's shingles
        common = common.withColumn("pos", F.col("n") - F.col("common") + F.row_number().over(order) - 1)
        least = F.floor((percent * F.col("n") + 99) / 100)  # a set with fewer shingles in common with the rest links with none of it
        common = cut(common.where(F.col("common") >= least).select("s", "node", "n", "pos", (F.col("n") - F.col("common")).alias("alone")), "jj-common")

        # copies that differ from one another more than from what they were made of: their reference is the set with the fewest shingles of its own
        hubs = common.groupBy("s").agg(F.min(F.struct("alone", "node")).alias("m")).select("s", F.col("m.node").alias("hub"))
        votes = common.join(hubs, "s").where("node <> hub").groupBy("node", "hub").agg(F.count(F.lit(1)).alias("c"))
        refs2 = cut(votes.groupBy("node").agg(F.max(F.struct("c", "hub")).alias("m")).select(F.col("node").alias("u"), F.col("m.hub").alias("v")), "jj-refs")
        near2 = compare(refs2, "jj-near", lambda met: met.where(linked))
        comp = extend(comp, near2.select("u", "v"))
        ref2 = near2.select(F.col("u").alias("node"), F.col("v").alias("ref"), (F.col("nu") - F.col("both")).alias("extra"))
        ref = ref2.union(ref.join(ref2.select("node"), "node", "left_anti"))
        ref = cut(ref.join(crowd.select(F.col("node").alias("ref"), F.lit(True).alias("inside")), "ref", "left").select("node", "ref", "extra", "inside"), "jj-ref")
    else:
        ref = ref.withColumn("inside", F.lit(None).cast("boolean"))

    # shingles that a set has alone in the crowd are in no other set of it; its reference may hold them if it isn't inside the crowd
    apart = cut(common.select("node", "alone").distinct(), "jj-apart") if crowded else None
    pairs = _candidates(short.withColumn("alone", F.lit(0)), ref, comp, percent).withColumn("crowd", F.lit(False))
    if crowded:
        head = F.col("n") - least + 1
        pairs2 = _candidates(common.where(F.col("pos") < head).select("s", "node", "n", "pos", "alone", F.lit(0).alias("h"), F.lit(True).alias("stays")), ref, comp, percent, 0)
        pairs = pairs.union(pairs2.withColumn("crowd", F.lit(True))).groupBy("ref1", "ref2").agg(F.min("lo1").alias("lo1"), F.min("lo2").alias("lo2"), F.max("e1").alias("e1"), F.max("e2").alias("e2"), F.min("crowd").alias("crowd"))
    pairs = cut(pairs, "jj-pairs")
    discard(*indexes, refs, crowd, *((own, common) if crowded else ()))
    sweep(docs.sparkSession)
    bounds = pairs.withColumnsRenamed({"ref1": "u", "ref2": "v"})
    over = compare(bounds.select("u", "v"), "jj-over", lambda met: bounds.join(met, ["u", "v"]).withColumn("link", linked))
    comp = extend(comp, over.where("link").select("u", "v"))

    # answers from the reference's: members' overlap is at most the references' plus what they hold beyond them
    # (a member smaller than its reference needs less overlap, so it may link even if it holds nothing beyond); linked pairs are one component
    open_ = over.where("not link").where(F.col("both") + F.col("e1") + F.col("e2") >= _need(F.col("lo1"), F.col("lo2"), percent))
    open_ = open_.select("u", "v", "both", "crowd", "lo2", "e2")
    if open_.isEmpty():
        return comp
    who = nodes.select("node", "n").join(ref, "node", "left").join(comp, "node", "left")
    who = who.join(apart, "node", "left") if crowded else who.withColumn("alone", F.lit(None).cast("int"))
    who = who.select("node", "n", F.when(F.col("alone").isNotNull(), F.when(F.col("inside"), F.col("alone")).otherwise(0)).alias("alone"), F.coalesce("ref", "node").alias("ref"), F.coalesce("extra", F.lit(0)).alias("extra"), F.coalesce("root", "node").alias("root"))
    a = who.select(*[F.col(c).alias(f"{c}1") for c in who.columns])
    b = who.select(*[F.col(c).alias(f"{c}2") for c in who.columns])
    # a pair of references that only the crowd's index gave is of interest for members in the crowd, whose own shingles are known
    beyond = [F.when(F.col("crowd"), F.greatest(F.lit(0), F.col(f"extra{i}") - F.col(f"alone{i}"))).otherwise(F.col(f"extra{i}")) for i in (1, 2)]
    near_enough = (F.col("both") + beyond[0] + beyond[1] >= _need(F.col("n1"), F.col("n2"), percent)) & (100 * F.col("n1") >= percent * F.col("n2")) & (100 * F.col("n2") >= percent * F.col("n1"))
    half = open_.join(a, (F.col("u") == F.col("ref1")) & (F.col("both") + beyond[0] + F.col("e2") >= _need(F.col("n1"), F.col("lo2"), percent)))
    rest = half.join(b, (F.col("v") == F.col("ref2")) & (F.col("root1") != F.col("root2")) & near_enough)
    rest = cut(rest.select(F.col("node1").alias("u"), F.col("node2").alias("v")).distinct(), "jj-open")
    more = compare(rest, "jj-more", lambda met: met.where(linked))
    return extend(comp, more.select("u", "v"))


def _candidates(index: DataFrame, ref: DataFrame, comp: DataFrame, percent: int, extra_lists: int = 1) -> DataFrame:
    """(ref1, ref2, lo1, lo2, e1, e2): pairs of reference sets of different components whose members may link by an index (s, node, n, pos, h, stays, alone).
    What a set has alone is beyond its reference only where that is inside the crowd (ref: node, ref, extra, inside).

    A linking pair shares a list; with extra_lists it shares more than 1 / MORE of the smaller set's size, less the h lists that the index leaves out
    of either, unless both sets stay in these, which are then searched beside it. The entries of one list with one reference are one entry with their bounds.
    Lists of an index with extra_lists are short: they are shuffled whole, once, and meet themselves. Long ones are dealt out by list and block.
    """
    known = index.join(ref, "node", "left").join(comp, "node", "left")
    known = known.select("s", "n", "pos", "h", "stays", F.coalesce("ref", "node").alias("ref"), F.greatest(F.lit(0), F.coalesce("extra", F.lit(0)) - F.when(F.col("inside"), F.col("alone")).otherwise(0)).alias("extra"), F.coalesce("root", "node").alias("root"))
    size = float(np.log(100 / percent)) * 1.02
    known = known.withColumn("block", F.floor(F.log(F.col("n").cast("double")) / size).cast("int"))
    if extra_lists:
        known = known.repartition("s")
    else:
        mixed = known.groupBy("s").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("s")
        known = known.join(mixed, "s", "left_semi")
    entry = known.groupBy("s", "block", "ref", "root").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.col("n") - F.col("pos")).alias("rest"), F.max("extra").alias("extra"), F.max("h").alias("h"), F.min("stays").alias("stays"))
    if not extra_lists:
        entry = cut(entry, "jj-entries")
    names = ("ref", "root", "lo", "hi", "rest", "extra", "h", "stays")
    fits = (
        (F.col("root1") < F.col("root2"))
        & (100 * F.col("hi1") >= percent * F.col("lo2"))
        & (100 * F.col("hi2") >= percent * F.col("lo1"))
        # a linking pair's first shared lists, as many as are counted below, leave the rest of the needed overlap behind them in both
        & (F.least("rest1", "rest2") >= _need(F.col("lo1"), F.col("lo2"), percent) - extra_lists * (F.floor(F.least("lo1", "lo2") / MORE) + 1))
    )
    left, right = (entry.select("s", F.col("block").alias(f"block{i}"), *[F.col(c).alias(f"{c}{i}") for c in names]) for i in (1, 2))
    if extra_lists:
        pairs = left.join(right, "s").where(fits & (F.abs(F.col("block1") - F.col("block2")) <= 1))
    else:
        left = left.withColumn("block2", F.explode(F.array(F.col("block1") - 1, F.col("block1"), F.col("block1") + 1)))
        pairs = left.join(right, ["s", "block2"]).where(fits)
    pairs = pairs.groupBy("ref1", "ref2").agg(F.min("lo1").alias("lo1"), F.min("lo2").alias("lo2"), F.max("extra1").alias("e1"), F.max("extra2").alias("e2"), F.count(F.lit(1)).alias("c"), F.max(F.when(F.col("stays1") & F.col("stays2"), 0).otherwise(F.least("h1", "h2"))).alias("slack"))
    return pairs.where(f"c > {extra_lists} * floor(least(lo1, lo2) / {MORE}) - slack").select("ref1", "ref2", "lo1", "lo2", "e1", "e2")


def _compared(docs: DataFrame, k: int, pairs: DataFrame, known_docs: DataFrame, clash: frozenset[int]) -> DataFrame:
    """(node, s): the sets of the nodes in pairs (u, v), written. Sets are made anew for one document of each node that occurs."""
    wanted = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
    sets = cut(_sets_of(docs, k, wanted, known_docs, clash), "jj-compared")
    sweep(docs.sparkSession)
    return sets


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (u, v) of nodes plus nu, nv and both (the exact overlap)."""
    with_u = pairs.join(sets.select(F.col("node").alias("u"), F.col("s").alias("su")), "u")
    met = with_u.join(sets.select(F.col("node").alias("v"), F.col("s").alias("sv")), "v")
    return met.select("u", "v", F.size("su").alias("nu"), F.size("sv").alias("nv"), F.size(F.array_intersect("su", "sv")).alias("both"))


def _sets_of(docs: DataFrame, k: int, nodes: DataFrame, known_docs: DataFrame, clash: frozenset[int]) -> DataFrame:
    """(node, s): the sets of some nodes, made anew from one document of each."""
    wanted = cut(nodes.join(known_docs, "node"), "jj-wanted")
    n = wanted.count()

    def run(batches):
        for _, texts in parts(batches, 0):
            sets = [shingle_set(t, k) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array([_node(s, clash) for s in sets], pa.int64()), list_column(sets)], ["node", "s"])

    # a node without a named document is found among the rows without a key
    chosen = docs.join(small_side(wanted.where("doc is not null").select("doc").distinct(), n), "doc", "left_semi").select("text")
    made = chosen.union(docs.where("doc is null").select("text")).mapInArrow(tidy(run), "node long, s array<long>")
    # documents may share a name
    made = made.join(small_side(wanted.select("node"), n), "node", "left_semi")
    return made.groupBy("node").agg(F.first("s").alias("s"))


def _node_of(text: Column, k: int, clash: frozenset[int]) -> Column:
    """The name of a text's set; null for an empty one."""

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([_node(s, clash) if len(s) else None for s in (shingle_set(t.as_py(), k) for t in texts)], pa.int64())

    return run(text)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4, percent: int = 85) -> DataFrame:
    """docs without the rows whose key isn't their component's smallest; rows that repeat a key stay one if their texts are in one component.

    Rows to remove are found by key and anti-joined; the texts are shuffled only if the keys to remove are too many to broadcast.
    Rows of a key that occurs more than once are kept or removed each by its own text. Rows with an empty set (null texts, texts without a
    word) and rows with a null key all stay. An empty table gives no rows; docs' other columns come along, whatever their names.
    """
    rows, clash = _rows(_texts(docs, key, text), k, percent)
    c = cut(rows, "jj-result")
    twice = cut(c.where("doc is not null").groupBy("doc").count().where("count > 1").select("doc"), "jj-twice")
    n = twice.count()
    lost = cut(c.where("doc <> component_id").select("doc").union(twice).distinct(), "jj-lost")
    # a row travels as one value, so no column of docs' can clash with a column of the plan
    whole = docs.select(named(key).alias("doc"), named(text).alias("text"), F.struct(*map(named, docs.columns)).alias("row"))
    out = whole.join(small_side(lost, lost.count()), "doc", "left_anti").select("row.*")
    if not n:
        return out
    # of the rows with a component's smallest key one stays, that of the smallest node
    stay = c.where("doc = component_id and n > 0").join(small_side(twice, n), "doc", "left_semi").groupBy("doc", "root").agg(F.min("node").alias("node"))
    again = whole.join(small_side(twice, n), "doc", "left_semi").withColumn("node", _node_of(F.col("text"), k, clash))
    full = again.join(stay.select("doc", "node").distinct(), ["doc", "node"], "left_semi").dropDuplicates(["doc", "node"])
    return out.unionByName(full.select("row.*")).unionByName(again.where("node is null").select("row.*"))
