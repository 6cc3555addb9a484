"""Co-access memory: which files are used together."""

from __future__ import annotations

import math
from collections import Counter, OrderedDict
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailhead.operators.graph import by_pause
from trailhead.operators.telemetry import scoped

#: Rows of sets in a task that counts pairs.
TASK_ROWS = 500_000


def co_access_pairs(sets: DataFrame, group: str = "set_id", item: str = "file_id", most: int = 10) -> DataFrame:
    """(file_a, file_b, n): pairs within the first ``most`` distinct items of a group, so a group gives a bounded number of pairs."""
    # few sets a task, however many there are: their pairs are counted in memory before they leave it
    tasks = max(sets.sparkSession.sparkContext.defaultParallelism, math.ceil(sets.count() / TASK_ROWS))
    first = Window.partitionBy(group).orderBy(item)
    s = sets.select(group, item).repartition(tasks, group).distinct().withColumn("r", F.row_number().over(first)).where(F.col("r") <= most)
    g = s.groupBy(group).agg(F.array_sort(F.collect_list(item)).alias("x"))
    pairs = F.flatten(F.transform("x", lambda a, i: F.transform(F.slice("x", i + 2, F.lit(most)), lambda b: F.struct(a.alias("file_a"), b.alias("file_b")))))
    return g.select(F.explode(pairs).alias("p")).groupBy("p.file_a", "p.file_b").agg(F.count(F.lit(1)).alias("n"))


def session_pairs(access: DataFrame, window: int = 300, files: int = 20, most: int = 10) -> DataFrame:
    """(file_a, file_b, n): updates by session proximity. Each access (id, session_id, worktree_id, file_path, accessed_at) updates the pairs
    among the ``most`` files last used in its session and worktree within window seconds, of the last ``files`` ones.

    A session's accesses are cut where nothing happens for longer than the window. Runs are folded in batches; what is held between these
    is the last use of ``files`` files. Pairs are counted within a batch before they leave the task.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, recent = None, OrderedDict()
        for b in batches:
            found: Counter = Counter()
            for *key, ts, file in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if key != at:
                    at, recent = key, OrderedDict()
                recent.pop(file, None)
                recent[file] = ts
                while len(recent) > files or next(iter(recent.values())) < ts - window:
                    recent.popitem(last=False)
                last = [f for f, _ in zip(reversed(recent), range(most), strict=False)]
                found.update(tuple(sorted(p)) for p in combinations(last, 2))
            pairs = list(found)
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.string()), pa.array([found[p] for p in pairs], pa.int64())], ["file_a", "file_b", "n"])

    a = scoped(access.where("file_path <> ''")).withColumn("group", F.to_json(F.array("session_id", "worktree_id")))
    runs = by_pause(a, "group", "accessed_at", "id", window + 1).select("group", "run", "accessed_at", "file_path", "id")
    runs = runs.repartition("group", "run").sortWithinPartitions("group", "run", "accessed_at", "id").drop("id")
    return runs.mapInArrow(fold, "file_a string, file_b string, n long").groupBy("file_a", "file_b").agg(F.sum("n").alias("n"))


def strengths(pairs: DataFrame) -> DataFrame:
    """n updates of s <- 0.95 s + 1, in closed form."""
    return pairs.select("file_a", "file_b", ((1 - F.pow(F.lit(0.95), "n")) / 0.05).alias("strength"))


def neighbours(edges: DataFrame) -> DataFrame:
    """Both directions of undirected edges: (file, other, strength)."""
    a = edges.select(F.col("file_a").alias("file"), F.col("file_b").alias("other"), "strength")
    return a.union(edges.select(F.col("file_b").alias("file"), F.col("file_a").alias("other"), "strength"))


def related(edges: DataFrame, k: int = 5) -> DataFrame:
    """The k strongest neighbours of every file; ties to the smaller file."""
    best = Window.partitionBy("file").orderBy(F.desc("strength"), "other")
    return neighbours(edges).withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def suggestions(sessions: DataFrame, edges: DataFrame, k: int = 5) -> DataFrame:
    """Per session (session_id, file): the k strongest related files that it hasn't used. A third of all uses may be of one session or
    file: neighbours are cut to k per file before the join, and only maxima are kept after it."""
    uses = sessions.select("session_id", "file").distinct()
    found = uses.join(related(edges, k), "file").groupBy("session_id", "other").agg(F.max("strength").alias("strength"))
    fresh = found.join(uses.withColumnRenamed("file", "other"), ["session_id", "other"], "left_anti")
    best = Window.partitionBy("session_id").orderBy(F.desc("strength"), "other")
    return fresh.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
