"""Soft locks as a stream: the lease of each intent is kept state with a timer, and can be read from the checkpoint."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: transformWithState needs this provider: set it before the stream starts.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Leases(StatefulProcessor):
    """Per intent the worktree that holds its lease and until when. A timer drops a lease that has run out by the watermark."""

    def __init__(self, lease: int):
        self.seconds = lease

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("lease", "holder string, expires long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        holder, expires = self.lease.get() if self.lease.exists() else (None, 0)
        if holder is not None:
            self.handle.deleteTimer(expires * 1000)
        out = []
        todo = pd.concat(list(rows)).sort_values(["ts", "id"])
        for i, tree, action, ts in zip(todo["id"], todo["worktree_id"], todo["action"], todo["ts"], strict=True):
            if holder is not None and expires <= ts:
                holder = None
            if action == "release":
                mine = holder == tree
                outcome, holder = ("released", None) if mine else ("not_held", holder)
            elif holder is not None and holder != tree:
                outcome = "conflict"
            else:
                outcome, holder, expires = "acquired", tree, int(ts) + self.seconds
            out.append((int(i), key[0], outcome, holder))
        if holder is None:
            self.lease.clear()
        else:
            self.lease.update((holder, expires))
            self.handle.registerTimer(expires * 1000)
        yield pd.DataFrame(out, columns=["id", "intent_id", "outcome", "held_by"])

    def handleExpiredTimer(self, key, timers, expired) -> Iterator[pd.DataFrame]:
        if self.lease.exists() and self.lease.get()[1] * 1000 <= expired.getExpiryTimeInMs():
            self.lease.clear()
        return iter([])

    def close(self) -> None:
        pass


def lock_stream(requests: DataFrame, lease: int = 3600, late: str = "10 minutes") -> DataFrame:
    """Outcomes of a stream of lock requests (id, intent_id, worktree_id, action, ts), as graph.lock_outcomes gives them for a table: id,
    intent_id, outcome, held_by. An intent's requests must come in order of time across batches; within a batch they are sorted. Blank worktrees are project-root."""
    tree = F.coalesce(F.nullif(F.trim("worktree_id"), F.lit("")), F.lit("project-root"))
    timed = requests.select("id", "intent_id", tree.alias("worktree_id"), "action", "ts", F.timestamp_seconds("ts").alias("at")).withWatermark("at", late)
    return timed.groupBy("intent_id").transformWithStateInPandas(_Leases(lease), "id long, intent_id string, outcome string, held_by string", "Append", "EventTime")


def leases(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The live leases that a stopped stream's checkpoint holds: intent_id, holder, expires."""
    s = spark.read.format("statestore").option("stateVarName", "lease").load(checkpoint)
    return s.select("key.intent_id", "value.holder", "value.expires")
