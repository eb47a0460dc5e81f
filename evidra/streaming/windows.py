"""Structured Streaming twins of the window and session operators, with watermarks for late events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling_counts(events: DataFrame, width: str, late: str) -> DataFrame:
    """Events and their mean value of each type and window; final once the watermark has passed."""
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), "event_type", "n", "mean")


def hopping_counts(events: DataFrame, width: str, slide: str, late: str) -> DataFrame:
    w = F.window("ts", width, slide)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    """Sessions of a user by gap: first and last event, and their number; the last is the event's, not the gap's end."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "user_id").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n")).select("user_id", "first", "last", "n")


def refractory(events: DataFrame, gap_ms: int, late: str = "1 day") -> DataFrame:
    """Events at least ``gap_ms`` after the last one accepted of their user, which is all the state that is kept.

    Events that come after a later one was accepted are left out. A user's state goes once the watermark, ``late`` behind
    the latest event, is past the time that the state can refuse.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        keep = []
        for t in (rows["ts"].astype("int64") // 1_000_000 if str(rows["ts"].dtype).endswith("[ns]") else rows["ts"].astype("datetime64[ms]").astype("int64")):
            ok = last is None or t - last >= gap_ms
            keep.append(ok)
            last = int(t) if ok else last
        if last + gap_ms > state.getCurrentWatermarkMs():
            state.update((last,))
            state.setTimeoutTimestamp(last + gap_ms)
        elif state.exists:
            state.remove()
        yield rows[keep][["user_id", "event_id"]]

    return events.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long", "last long", "append", GroupStateTimeout.EventTimeTimeout)
