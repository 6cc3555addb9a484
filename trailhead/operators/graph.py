"""The intent dependency graph: readiness, closure, cycles, transitions, locks."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

DONE = ("verified", "merged")
# The legal status changes besides any status to blocked.
TRANSITIONS = (("draft", "approved"), ("draft", "rejected"), ("approved", "in_progress"), ("approved", "rejected"), ("in_progress", "in_review"), ("in_progress", "rejected"), ("in_review", "verified"), ("in_review", "rejected"), ("in_review", "in_progress"), ("verified", "merged"), ("blocked", "approved"))


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where the setting is absent a folder under /tmp serves if all of Spark runs on this machine; on a
    cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (base or "file:///tmp/checkpoints").rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read back: iterative plans restart from files. Its rows, counted as they are written, are ``written_rows``."""
    spark, seen = df.sparkSession, Observation()
    path = f"{shared_dir(spark)}/trailhead/{name}-{uuid.uuid4().hex}"
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path, out.written_rows = path, seen.get["n"]
    return out


def dropped(*frames: DataFrame) -> None:
    """Delete the files of frames that came from ``written`` and that no later plan reads."""
    for df in frames:
        if path := getattr(df, "written_path", None):
            p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def direct(edges: DataFrame, intents: DataFrame) -> DataFrame:
    """(from_id, to_id, to_status): depends_on edges with the target's status."""
    return edges.where("kind = 'depends_on'").join(intents.select(F.col("id").alias("to_id"), F.col("status").alias("to_status")), "to_id")


def ready(intents: DataFrame, edges: DataFrame) -> DataFrame:
    """Approved intents without a dependency that isn't done."""
    waiting = direct(edges, intents).where(~F.col("to_status").isin(*DONE)).select(F.col("from_id").alias("id"))
    return intents.where("status = 'approved'").join(waiting, "id", "left_anti")


def deps_satisfied(intents: DataFrame, edges: DataFrame) -> DataFrame:
    open_ = direct(edges, intents).groupBy(F.col("from_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~F.col("to_status").isin(*DONE), 1)).alias("open"))
    return intents.select("id").join(open_, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("deps"), (F.coalesce("open", F.lit(0)) == 0).alias("satisfied"))


def context(intents: DataFrame, edges: DataFrame) -> DataFrame:
    """Per intent: number and smallest of its dependencies and dependants, and whether the dependencies are done."""
    e = edges.where("kind = 'depends_on'")
    back = e.groupBy(F.col("to_id").alias("id")).agg(F.count(F.lit(1)).alias("dependents"), F.min("from_id").alias("first_dependent"))
    fore = e.groupBy(F.col("from_id").alias("id")).agg(F.min("to_id").alias("first_dep"))
    return deps_satisfied(intents, edges).join(fore, "id", "left").join(back, "id", "left").select("id", "deps", "first_dep", F.coalesce("dependents", F.lit(0)).alias("dependents"), "first_dependent", "satisfied")


def auto_block(intents: DataFrame, edges: DataFrame) -> DataFrame:
    """Intents that become blocked as a direct dependency was rejected (one hop)."""
    hit = direct(edges, intents).where("to_status = 'rejected'").select(F.col("from_id").alias("id"))
    return intents.where(~F.col("status").isin("blocked", "rejected", "merged", "verified")).join(hit, "id", "left_semi").select("id", "status", F.lit("blocked").alias("new_status"))


#: Walks of one length are doubled while they are at most so many times the edges, or FEW in all.
JUMPS = 4
FEW = 4_000_000
#: A closure goes on by plain rounds while more edges than so many are left to be walked.
PLAIN = 500_000
#: Edges are trimmed by plain rounds while a round leaves at most this share of them.
SHRINKS = 0.8
#: Edges up to which what is left of a graph is gone through by one task, in memory: rounds of jobs over so few cost more than they do.
LOCAL = 4_000_000


def _joined(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs (from_id, to_id) over an edge of a and then one of b."""
    return a.select("from_id", F.col("to_id").alias("via")).join(b.select(F.col("from_id").alias("via"), "to_id"), "via").select("from_id", "to_id").distinct()


def _grouped(starts: DataFrame) -> DataFrame:
    """(g, bit, start), written: starts in the order of their ids, 64 to a group. Neighbours in that order often lead to the same nodes."""
    order = starts.where("id is not null").select("id").distinct().repartitionByRange("id").sortWithinPartitions("id")
    n = order.select(F.monotonically_increasing_id().alias("n"), F.col("id").alias("start"))
    return written(n.select(F.expr("shiftright(n, 6)").alias("g"), F.expr("cast(n & 63 as int)").alias("bit"), "start"), "starts")


def _carried(front: DataFrame, walks: DataFrame) -> DataFrame:
    """(g, id, mask): front's bits at the ends of walks from its ids, a row per walk."""
    return front.join(walks, F.col("id") == F.col("from_id")).select("g", F.col("to_id").alias("id"), "mask")


def transitive(edges: DataFrame, starts: DataFrame, kind: str | None = "depends_on", most: int = 10_000, every: int = 8) -> DataFrame:
    """(start, id): what each start depends on, over any number of edges; a start on a cycle reaches itself. Runs jobs while the plan is built.

    Pairs are held as rows (g, id, mask): of a group's 64 starts those that reach id, as bits. They become pairs in the returned plan only, so a node that
    many starts reach moves once a group.

    Plain rounds come first, while the edges are many and each round leaves only a part of them to be walked yet: those from nodes that the last
    round's edges lead to. A round's pairs are the ends of walks of its length; what a start reaches by longer walks is reached from these.
    After that ``walks`` joins the ends of walks of exactly 1, 2, 4, 8 ... edges; a round adds to the pairs found (up to as many edges) those one walk further
    and doubles the walks, so a path of d edges takes log d rounds. Where the walks become too many they stay as they are, and each round only
    carries on the pairs that the last one found. Ends when a round finds nothing new; if that isn't so after ``most`` rounds, it is an error.
    """
    e = edges if kind is None else edges.where(F.col("kind") == kind)
    walks = written(e.where("from_id is not null and to_id is not null").select("from_id", "to_id").distinct(), "walks")
    members = _grouped(starts)
    own = members.select("g", F.col("start").alias("id"), F.expr("shiftleft(1L, bit)").alias("mask"))
    front = written(_carried(own, walks).groupBy("g", "id").agg(F.bit_or("mask").alias("mask")), "closure")
    levels = []
    while front.written_rows and walks.written_rows > PLAIN:
        left = written(walks.join(walks.select(F.col("to_id").alias("from_id")).distinct(), "from_id", "left_semi").select("from_id", "to_id"), "walks")
        falls = left.written_rows <= SHRINKS * walks.written_rows
        dropped(walks)
        walks = left
        if not falls:
            break
        levels.append(front)
        front = written(_carried(front, walks).groupBy("g", "id").agg(F.bit_or("mask").alias("mask")), "closure")
    bound, grow = max(JUMPS * walks.written_rows, FEW), True
    seen = front
    parts = [seen]

    def pairs() -> DataFrame:
        found = seen
        for level in levels:
            found = found.union(level)
        if levels:  # else no bit stands in two rows
            found = found.groupBy("g", "id").agg(F.bit_or("mask").alias("mask"))
        return found.join(members, "g").where("shiftright(mask, bit) & 1 = 1").select("start", "id")

    for _ in range(most):
        # the walks are as long as the longest path to a pair of seen, so those of front and one walk more are all that can be new
        both = _carried(front, walks).withColumn("known", F.lit(0).cast("long")).union(seen.select("g", "id", F.lit(0).cast("long"), "mask"))
        step = both.groupBy("g", "id").agg(F.bit_or("mask").alias("mask"), F.bit_or("known").alias("known"))
        new = written(step.select("g", "id", F.expr("mask & ~known").alias("mask")).where("mask <> 0"), "closure")
        if not new.written_rows:
            dropped(new, walks)
            return pairs()
        parts.append(new)
        if len(parts) > every:
            seen = written(seen.union(new), "closure")
            dropped(*parts[:-1])
            parts = [seen, new]
        else:
            seen = seen.union(new)
        if grow:
            longer = written(_joined(walks, walks), "walks")
            grow = longer.written_rows <= bound
            dropped(walks if grow else longer)
            walks = longer if grow else walks
        front = seen if grow else new
    raise RuntimeError(f"transitive: still finding pairs after {most} rounds")


def _inner(walks: DataFrame) -> DataFrame:
    """(id): nodes that walks both end in and start from."""
    return walks.select(F.col("to_id").alias("id")).distinct().join(walks.select(F.col("from_id").alias("id")).distinct(), "id", "left_semi")


def _within(e: DataFrame, nodes: DataFrame) -> DataFrame:
    return e.join(nodes.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(nodes.withColumnRenamed("id", "to_id"), "to_id", "left_semi").select("from_id", "to_id")


def _trimmed(e: DataFrame, most: int) -> DataFrame:
    """Edges (from_id, to_id) between nodes that have paths of any length both into and out of them: cycles and what lies between cycles.

    Plain rounds, each of which cuts the edges to nodes with an edge in and one out, come first, as long as one takes a good part of the edges: together they
    cost no more than a few passes over all edges. What is left then goes on by walks, unless it is so little that one task is to have it (``LOCAL``).
    Walks of exactly 1, 2, 4 ... edges are doubled while they are few, so long tails go in few rounds. Where as many nodes have walks of twice the length into and
    out of them, all those nodes have longer ones too: a node whose longest walk is finite follows one for which it is just too short.
    Where walks become too many, the edges are cut to the nodes found, and walks begin anew with them.
    """
    given, falls = e, True
    while falls and e.written_rows:
        kept = written(_within(e, _inner(e)), "trimmed")
        falls = kept.written_rows <= SHRINKS * e.written_rows
        same = kept.written_rows == e.written_rows
        if e is not given:
            dropped(e)
        e = kept
        if same:
            return e
    if e.written_rows <= LOCAL:
        return e
    bound = max(JUMPS * e.written_rows, FEW)
    walks, n = e, -1
    for _ in range(most):
        m = _inner(walks).count()
        if m == n:
            out = written(_within(e, _inner(walks)), "trimmed")
            if walks is not e:
                dropped(walks)
            dropped(e)
            return out
        longer = written(_joined(walks, walks), "walks")
        if longer.written_rows <= bound:
            if walks is not e:
                dropped(walks)
            walks, n = longer, m
            continue
        # too many: go on with the edges between the nodes found, whose own walks of one edge are few
        kept = written(_within(e, _inner(walks)), "trimmed")
        dropped(longer)
        if walks is not e:
            dropped(walks)
        if kept.written_rows == e.written_rows:
            return kept
        e = walks = kept
        n = -1
    raise RuntimeError(f"cycle_nodes: nodes still go after {most} rounds")


def _least(e: DataFrame, most: int) -> DataFrame:
    """(id, low): per node of edges the least rank of a node that reaches it, its own included. A node's rank is a hash and its id, so that ranks
    along a path are in no order. The edges are doubled while they stay few, as in ``_trimmed``: after that, jumps of their length go on."""
    nodes = e.select(F.col("from_id").alias("id")).union(e.select(F.col("to_id").alias("id"))).distinct()
    low = written(nodes.select("id", F.struct(F.xxhash64("id").alias("h"), F.col("id").alias("i")).alias("low")), "low")
    hops, bound, grow, before = e, max(JUMPS * e.count(), FEW), True, None
    for _ in range(most):
        sent = hops.join(low.select(F.col("id").alias("from_id"), "low"), "from_id").select(F.col("to_id").alias("id"), "low")
        less = written(low.union(sent).groupBy("id").agg(F.min("low").alias("low")), "low")
        dropped(low)
        low = less
        state = tuple(low.agg(F.sum(F.xxhash64("id", "low").cast("decimal(38,0)"))).first())
        if state == before:
            if hops is not e:
                dropped(hops)
            return low
        before = state
        if grow:
            wider = written(_joined(hops, hops), "hops")
            grow = wider.written_rows <= bound
            if not grow:
                dropped(wider)
            elif hops is not e:
                dropped(hops)
            hops = wider if grow else hops
    raise RuntimeError(f"cycle_nodes: ranks still fall after {most} rounds")


def _in_components(src: np.ndarray, dst: np.ndarray, n: int) -> list[int]:
    """The nodes of 0 to n - 1 that are in a strongly connected component with another, by Tarjan's algorithm: time and memory grow with the edges."""
    while len(src):  # nodes without an edge in or out go, as long as that is a good part of the edges
        keep = (np.bincount(dst, minlength=n)[src] > 0) & (np.bincount(src, minlength=n)[dst] > 0)
        shrinks = keep.sum() <= SHRINKS * len(src)
        src, dst = src[keep], dst[keep]
        if not shrinks:
            break
    to = dst[np.argsort(src, kind="stable")].tolist()
    ends = np.cumsum(np.bincount(src, minlength=n))
    at, ends = np.append(0, ends[:-1]).tolist() if n else [], ends.tolist()
    index, low, done = [0] * n, [0] * n, bytearray(n)
    stack, found, seen = [], [], 0
    for root in range(n):
        if index[root] or at[root] == ends[root]:
            continue
        path = [root]
        while path:
            v = path[-1]
            if not index[v]:
                seen += 1
                index[v] = low[v] = seen
                stack.append(v)
            i = at[v]
            if i < ends[v]:
                at[v] = i + 1
                w = to[i]
                if not index[w]:
                    path.append(w)
                elif not done[w] and index[w] < low[v]:
                    low[v] = index[w]
                continue
            path.pop()
            if path and low[v] < low[path[-1]]:
                low[path[-1]] = low[v]
            if low[v] == index[v]:
                size = len(stack) - 1
                while stack[size] != v:
                    size -= 1
                own = stack[size:]
                del stack[size:]
                for w in own:
                    done[w] = 1
                if len(own) > 1:
                    found += own
    return found


def _local(e: DataFrame) -> DataFrame:
    """(id): nodes on cycles of at most ``LOCAL`` distinct edges, none from a node to itself; one task holds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [(b.column(0), b.column(1)) for b in batches]
        if not ends:
            return
        nodes = pa.concat_arrays([x[i] for i in (0, 1) for x in ends]).dictionary_encode()
        del ends
        code = nodes.indices.to_numpy()
        found = _in_components(code[: len(code) // 2], code[len(code) // 2 :], len(nodes.dictionary))
        yield pa.RecordBatch.from_arrays([nodes.dictionary.take(pa.array(found, pa.int64()))], ["id"])

    return e.select("from_id", "to_id").coalesce(1).mapInArrow(run, f"id {e.schema['from_id'].dataType.simpleString()}")


def cycle_nodes(edges: DataFrame, most: int = 10_000) -> DataFrame:
    """(id) of nodes on a cycle, an edge to itself included.

    First all nodes go that have no path of some length into or out of them. What is left, once it is at most ``LOCAL`` edges, is one task's.
    If else every node has one edge in and one out, the rest is cycles.
    Else components are found forward and backward: the nodes with one least rank among those that reach them are a
    class, and within it those whose least rank among reached nodes is the same are one strongly connected component. Components with more than
    one node are on cycles. They go, and what is left of each class is worked on alike; as ranks are hashes, classes shrink fast. Runs jobs while the
    plan is built; tables of rounds that are over are deleted.
    """
    e = written(edges.where("from_id is not null and to_id is not null").select("from_id", "to_id").distinct(), "graph")
    found = [e.where("from_id = to_id").select(F.col("from_id").alias("id"))]
    e = written(e.where("from_id <> to_id"), "graph")
    for _ in range(most):
        if e.written_rows > LOCAL:
            whole, e = e, _trimmed(e, most)
            if e is not whole:
                dropped(whole)
        if not e.written_rows:
            break
        if e.written_rows <= LOCAL:
            found.append(written(_local(e), "cyclic"))
            dropped(e)
            break
        ends = e.select(F.col("from_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(e.select("to_id", F.lit(0), F.lit(1)))
        if ends.groupBy("id").agg(F.sum("o").alias("o"), F.sum("i").alias("i")).where("o <> 1 or i <> 1").isEmpty():
            found.append(e.select(F.col("from_id").alias("id")))
            break
        fore = _least(e, most)
        a, b = (fore.select(F.col("id").alias(f"{x}_id"), F.col("low").alias(f"{x}_low")) for x in ("from", "to"))
        inside = written(e.join(a, "from_id").join(b, "to_id").where("from_low = to_low").select("from_id", "to_id"), "class")
        back = _least(inside.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id")), most)
        same = written(fore.join(back.withColumnRenamed("low", "back"), "id").where("low = back").select("id", "low"), "component")
        found.append(written(same.join(same.groupBy("low").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("low"), "low").select("id"), "cyclic"))
        left = written(inside.join(same.select(F.col("id").alias("from_id")), "from_id", "left_anti").join(same.select(F.col("id").alias("to_id")), "to_id", "left_anti"), "graph")
        dropped(e, fore, back, inside, same)
        e = left
    else:
        raise RuntimeError(f"cycle_nodes: classes are left after {most} rounds")
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out.distinct()


def validate(intents: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: has_cycles, cyclic (nodes on cycles of depends_on edges), first_cyclic, auto_blocked (intents that a rejected dependency blocks)."""
    c = cycle_nodes(edges.where("kind = 'depends_on'")).agg(F.count(F.lit(1)).alias("cyclic"), F.min("id").alias("first_cyclic"))
    blocked = auto_block(intents, edges).agg(F.count(F.lit(1)).alias("auto_blocked"))
    return c.crossJoin(F.broadcast(blocked)).select((F.col("cyclic") > 0).alias("has_cycles"), "cyclic", "first_cyclic", "auto_blocked")  # each is one row


def insert_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """new (from_id, to_id, kind) judged, once each: self_loop, duplicate or inserted. The inserted ones are to be appended."""
    key = ["from_id", "to_id", "kind"]
    there = edges.select(*key).distinct().withColumn("there", F.lit(True))
    outcome = F.when(F.col("from_id") == F.col("to_id"), "self_loop").when(F.col("there"), "duplicate").otherwise("inserted")
    return new.select(*key).distinct().join(there, key, "left").select(*key, outcome.alias("outcome"))


def remove_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select("from_id", "to_id", "kind"), ["from_id", "to_id", "kind"], "left_anti")


def edge_degrees(intents: DataFrame, edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("from_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select(F.col("to_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    d = both.groupBy("id").agg(F.sum("o").alias("outgoing"), F.sum("i").alias("incoming"))
    return intents.select("id").join(d, "id", "left").fillna(0)


def legal(current: Column, requested: Column) -> Column:
    ok = requested == "blocked"
    for a, b in TRANSITIONS:
        ok = ok | ((current == a) & (requested == b))
    return ok


def eval_gate(runs: DataFrame) -> DataFrame:
    """One row: pass, failed_eval or no_eval_history, from the latest run of all golden sets."""
    last = runs.orderBy(F.desc("created_at"), F.desc("id")).limit(1).agg(F.max("passed").alias("p"))
    return last.select(F.when(F.col("p").isNull(), "no_eval_history").when(F.col("p"), "pass").otherwise("failed_eval").alias("gate"))


def transition_outcomes(requests: DataFrame, gate: DataFrame) -> DataFrame:
    """requests (id, current, requested) judged: illegal pairs and, where the gate isn't open, promotions are rejected."""
    gated = ((F.col("current") == "in_review") & (F.col("requested") == "verified")) | ((F.col("current") == "verified") & (F.col("requested") == "merged"))
    r = requests.crossJoin(F.broadcast(gate))  # gate is one row
    outcome = F.when(~legal(F.col("current"), F.col("requested")), "invalid_transition").when(gated & (F.col("gate") != "pass"), F.col("gate")).otherwise("accepted")
    entering = (F.col("current") != "in_progress") & (F.col("requested") == "in_progress")
    leaving = (F.col("current") == "in_progress") & (F.col("requested") != "in_progress")
    return r.select("id", "current", "requested", outcome.alias("outcome"), F.when(outcome != "accepted", "none").when(entering, "acquire").when(leaving, "release").otherwise("none").alias("lock"))


def stale(intents: DataFrame, now: DataFrame, timeout_hours: int = 48) -> DataFrame:
    """In-progress intents not touched for timeout_hours; now: one row (now)."""
    return intents.where("status = 'in_progress'").crossJoin(F.broadcast(now)).where(F.col("now") - F.col("updated_at") > timeout_hours * 3600)


def recover_stale(intents: DataFrame, now: DataFrame, timeout_hours: int = 48) -> DataFrame:
    """(id, status, new_status): stale intents go back to approved."""
    old = (F.col("status") == "in_progress") & (F.col("now") - F.col("updated_at") > timeout_hours * 3600)
    return intents.crossJoin(F.broadcast(now)).select("id", "status", F.when(old, "approved").otherwise(F.col("status")).alias("new_status"))


def resolve_prefix(ids: DataFrame, prefixes: DataFrame, head: str = "") -> DataFrame:
    """Per prefix: found (with the id), ambiguous or missing. A prefix that is an id names it; any other is completed by head, which all ids
    begin with, if it doesn't begin so. Ids are matched by their heads of all the prefixes' lengths, an equi-join."""
    p = prefixes.select("prefix").distinct()
    full = F.when(F.col("prefix").startswith(head), F.col("prefix")).otherwise(F.concat(F.lit(head), "prefix"))
    p = p.join(ids.select(F.col("id").alias("prefix"), F.lit(True).alias("named")).distinct(), "prefix", "left").withColumn("full", F.when(F.col("named"), F.col("prefix")).otherwise(full))
    sizes = p.select(F.length("full").alias("size")).where("size is not null").distinct()
    heads = ids.select("id").join(F.broadcast(sizes), F.length("id") >= F.col("size"))  # a row per length, no more than the longest prefix has
    heads = heads.select("id", F.expr("substring(id, 1, size)").alias("full"))
    hit = heads.groupBy("full").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"), F.max((F.col("id") == F.col("full")).cast("int")).alias("same"))
    r = p.join(hit, "full", "left")
    n, same = F.coalesce("n", F.lit(0)), F.coalesce("same", F.lit(0)) == 1
    return r.select("prefix", n.alias("matches"), F.when(n == 0, "missing").when((n == 1) | same, "found").otherwise("ambiguous").alias("outcome"), F.when(same, F.col("full")).when(n == 1, F.col("id")).alias("id"))


def segments(df: DataFrame, group: str, *order: str) -> DataFrame:
    """df, written, in the order of (group, *order) and cut into segments (column seg) of a range each: a group with most of the rows is many segments.
    order must tell the rows of a group apart."""
    by = [group, *order]
    return written(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("seg", F.spark_partition_id()), "segments")


def by_pause(df: DataFrame, group: str, time: str, order: str, pause: int) -> DataFrame:
    """df plus run: within a group, rows in order of (time, order) are cut into runs where at least pause passes.

    Segments of the order are scanned in parallel, each to a summary (its first and last time, its pauses); the summaries of a group, a row a segment,
    give what comes before each segment.
    """
    s = segments(df, group, time, order)
    w = Window.partitionBy(group, "seg").orderBy(time, order)
    new = F.coalesce((F.col(time) - F.lag(time).over(w) >= pause).cast("long"), F.lit(0).cast("long"))
    local = s.withColumn("new", new).withColumn("run", F.sum("new").over(w))
    summary = local.groupBy(group, "seg").agg(F.min(time).alias("lo"), F.max(time).alias("hi"), F.sum("new").alias("inner"))
    every = Window.partitionBy(group).orderBy("seg")
    opens = F.coalesce((F.col("lo") - F.lag("hi").over(every) >= pause).cast("long"), F.lit(1).cast("long"))
    summary = summary.withColumn("opens", opens).withColumn("base", F.sum(F.col("opens") + F.col("inner")).over(every) - F.col("inner"))
    base = summary.select(F.col(group).alias("group_"), F.col("seg").alias("seg_"), "base")
    joined = local.join(base, F.col(group).eqNullSafe(F.col("group_")) & (F.col("seg") == F.col("seg_")))
    return joined.withColumn("run", F.col("run") + F.col("base")).drop("new", "seg", "group_", "seg_", "base")


def lock_outcomes(requests: DataFrame, lease: int = 3600) -> DataFrame:
    """requests (id, intent_id, worktree_id, action, ts) in order of (ts, id) per intent. acquire: acquired (or renewed), or conflict with the
    worktree that holds a live lease; expired leases are reclaimed. release: released if the worktree holds the lock, else not_held.
    Result: id, intent_id, outcome, held_by (the holder after it, or the one in the way). Blank worktrees are project-root.

    Where a lease's time passes between two requests nothing is held, so an intent's requests are cut there, and runs are folded in parallel;
    a run goes through in batches, and what is held between them is the current lease.
    """
    schema = "id long, intent_id string, outcome string, held_by string"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, holder, expires = None, None, 0
        for b in batches:
            ids, intents, runs, trees, actions, times = (b.column(i).to_pylist() for i in range(6))
            outcomes, held = [], []
            for intent, run, tree, action, ts in zip(intents, runs, trees, actions, times, strict=True):
                if (intent, run) != at or expires <= ts:
                    at, holder = (intent, run), None
                if action == "release":
                    mine = holder == tree
                    outcomes.append("released" if mine else "not_held")
                    holder = None if mine else holder
                elif holder is not None and holder != tree:
                    outcomes.append("conflict")
                else:
                    outcomes.append("acquired")
                    holder, expires = tree, ts + lease
                held.append(holder)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(intents, pa.string()), pa.array(outcomes, pa.string()), pa.array(held, pa.string())], ["id", "intent_id", "outcome", "held_by"])

    tree = F.coalesce(F.nullif(F.trim("worktree_id"), F.lit("")), F.lit("project-root"))
    cut = by_pause(requests, "intent_id", "ts", "id", lease).select("id", "intent_id", "run", tree.alias("worktree_id"), "action", "ts")
    return cut.repartition("intent_id", "run").sortWithinPartitions("intent_id", "run", "ts", "id").mapInArrow(fold, schema)


def live_locks(locks: DataFrame, now: DataFrame) -> DataFrame:
    return locks.crossJoin(F.broadcast(now)).where("expires_at > now").drop("now")


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row per key in an order (upsert semantics over appended rows)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def hash_id(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(c.cast("binary"), 256), 1, 8))


def one_row(spark: SparkSession, **values) -> DataFrame:
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
