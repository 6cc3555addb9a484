"""Stateful streams over file activity: debounce and conflict detection.

A path's state lasts as long as it can matter: it times out in event time, once the watermark is past the last event by the gap or window.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def debounce_gap(debounce_ms: int) -> int:
    """Whole seconds, at least one."""
    return max(1, debounce_ms // 1000)


def _timed(events: DataFrame, late: str) -> DataFrame:
    return events.withColumn("at", F.timestamp_seconds("timestamp")).withWatermark("at", late)


def _until(state: GroupState, seconds: int) -> None:
    """Keep the state until the watermark is past a time; a time that has passed already is over at the next batch."""
    state.setTimeoutTimestamp(max(seconds * 1000, state.getCurrentWatermarkMs() + 1))


def debounce_stream(events: DataFrame, gap: int, late: str = "10 minutes") -> DataFrame:
    """Events (id, path, timestamp) less those within gap seconds of the last kept one of their path. State: a time per path that was
    active within gap seconds of the watermark. Events later than the watermark's delay are dropped."""

    def run(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values(["timestamp", "id"])
        kept = []
        for i, ts in zip(rows["id"], rows["timestamp"], strict=True):
            if last is None or ts - last >= gap:
                last = int(ts)
                kept.append((key[0], int(i)))
        state.update((last,))
        _until(state, last + gap)
        yield pd.DataFrame(kept, columns=["path", "id"])

    return _timed(events, late).groupBy("path").applyInPandasWithState(run, "path string, id long", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def conflict_stream(events: DataFrame, window: int, late: str = "10 minutes") -> DataFrame:
    """For each event the latest earlier event by another agent on its path, if at most window seconds old. State per path that was active
    within window seconds of the watermark: the last two agents' latest events, enough to name the most recent other agent."""

    def run(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        a, ta, b, tb = state.get if state.exists else (None, 0, None, 0)
        rows = pd.concat(list(parts)).sort_values(["timestamp", "id"])
        out = []
        for i, agent, ts in zip(rows["id"], rows["agent"], rows["timestamp"], strict=True):
            other, to = (a, ta) if a is not None and a != agent else (b, tb)
            if other is not None and other != agent and ts - to <= window:
                out.append((int(i), key[0], agent, other, int(ts - to)))
            if a != agent:
                b, tb = a, ta
            a, ta = agent, int(ts)
        state.update((a, ta, b, tb))
        _until(state, ta + window + 1)
        yield pd.DataFrame(out, columns=["id", "path", "agent", "other_agent", "age"])

    return _timed(events, late).groupBy("path").applyInPandasWithState(run, "id long, path string, agent string, other_agent string, age long", "a string, ta long, b string, tb long", "append", GroupStateTimeout.EventTimeTimeout)
