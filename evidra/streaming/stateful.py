"""Greedy scans over streams: what arrives out of order is put in order before it is scanned.

Rows of a key wait in list state until the watermark says that none before them can come any more; a timer in event time
then hands them over in order to the same scan that the batch operators use, whose state is kept in list state too.
Results are final as they are emitted, and equal the batch result over the same rows as long as none came later than the
watermark allows; those that did are left out, as everywhere in Structured Streaming. Both states are emptied once the
watermark is past all that they can touch, so they are bounded by the watermark's delay and the scan's reach.

The state lives in the session's store; ``use_rocksdb`` chooses the one on disk that these operators need.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from evidra.functions.text import plain_text
from evidra.operators.greedy import OpenIncidents, OpenSightings


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class InOrder(StatefulProcessor):
    """Rows of a key in order, each scanned once the watermark has passed its time.

    ``load`` makes a scan from what its ``dump`` gave, or from None; ``scan(state, row)`` gives a row's result and
    ``until(state)`` the time from which on the state can't change any later row's result.
    """

    def __init__(self, columns: list[tuple[str, str]], order: list[str], load: Callable, dump: Callable, scan: Callable, until: Callable, result: str):
        self.columns, self.order = columns, order
        self.load, self.dump, self.scan, self.until, self.result = load, dump, scan, until, result

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ", ".join(f"{c} {kind}" for c, kind in self.columns))
        self.state = handle.getListState("state", "value string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = [c for c, _ in self.columns]
        after = timerValues.getCurrentWatermarkInMs()
        for part in rows:
            part = part[part["at"] > after]
            if len(part):
                self.waiting.appendList(list(part[names].astype(object).itertuples(index=False, name=None)))
                self.handle.registerTimer(int(part["at"].min()))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        names = [c for c, _ in self.columns]
        at = names.index("at")
        rows = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        ready, later = [r for r in rows if r[at] <= now], [r for r in rows if r[at] > now]
        kept = [r[0] for r in self.state.get()] if self.state.exists() else []
        state = self.load([json.loads(x) for x in kept])
        out = []
        by = [names.index(c) for c in self.order]
        for r in sorted(ready, key=lambda r: tuple(r[k] for k in by)):
            out.append((key[0], *self.scan(state, dict(zip(names, r, strict=True)))))
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        until = self.until(state)
        if until > now:
            self.state.put([(json.dumps(x),) for x in self.dump(state)])
        else:
            self.state.clear()
        due = ([min(r[at] for r in later)] if later else []) + ([until] if until > now else [])
        if due:
            self.handle.registerTimer(int(min(due)))
        if out:
            yield pd.DataFrame(out, columns=["entity", *self.result.split()])

    def close(self) -> None:
        pass


def incidents(findings: DataFrame, late: str, duration_ms: int = 0) -> DataFrame:
    """entity, ord and first: the first finding of each finding's incident, as the batch ``incidents`` groups them.

    ``findings(entity, ord, ts, end_ts, clause, category)``; ``ts`` is the time at which a finding begins.
    """
    columns = [("at", "long"), ("ord", "long"), ("start_ms", "long"), ("end_ms", "long"), ("clause", "string"), ("category", "string")]
    processor = InOrder(
        columns,
        ["start_ms", "end_ms", "ord"],
        lambda kept: OpenIncidents(duration_ms, latest=kept),
        lambda state: state.latest,
        lambda state, r: (r["ord"], state.take(r["ord"], r["start_ms"], r["end_ms"], r["clause"], r["category"])),
        lambda state: state.closed_from(),
        "ord first",
    )
    timed = findings.withWatermark("ts", late).select(
        "entity", "ts", "ord", F.unix_millis("ts").alias("at"), F.unix_millis("ts").alias("start_ms"), F.unix_millis("end_ts").alias("end_ms"), "clause", "category"
    )
    return timed.groupBy("entity").transformWithStateInPandas(processor, "entity long, ord long, first long", "append", "eventTime")


def sighting_clusters(sightings: DataFrame, late: str, floor: float = 0.85, overlap: float = 0.6, gap_ms: int = 5_000) -> DataFrame:
    """entity, ord and first: the first sighting of each sighting's cluster, as the batch ``cluster_sightings`` groups them.

    ``sightings(entity, ord, ts, text, confidence, x, y, w, h)``
    """
    columns = [("at", "long"), ("ord", "long"), ("text", "string"), ("key", "string")] + [(c, "double") for c in ("confidence", "x", "y", "w", "h")]

    def load(kept: list) -> OpenSightings:
        return OpenSightings(floor, overlap, gap_ms, [[n, key, best, tuple(box), seen] for n, key, best, box, seen in kept])

    processor = InOrder(
        columns,
        ["at", "text", "ord"],
        load,
        lambda state: state.active,
        lambda state, r: (r["ord"], state.take(r["ord"], r["at"], r["key"], r["confidence"], (r["x"], r["y"], r["w"], r["h"]))),
        lambda state: max((c[4] + gap_ms for c in state.active), default=0),
        "ord first",
    )
    numbers = [F.col(c).cast("double").alias(c) for c in ("confidence", "x", "y", "w", "h")]
    timed = sightings.withWatermark("ts", late).select("entity", "ts", "ord", F.unix_millis("ts").alias("at"), "text", plain_text(F.col("text")).alias("key"), *numbers)
    return timed.groupBy("entity").transformWithStateInPandas(processor, "entity long, ord long, first long", "append", "eventTime")
