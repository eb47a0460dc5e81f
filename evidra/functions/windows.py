"""Sliding windows as a table function, for SQL: one call a partition, rows in order, state of one window's reach."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf


@udtf(returnType="entity: bigint, turn: bigint, idx: bigint, s: bigint, e: bigint, n: bigint")
class SlidingWindows:
    """Windows of ``length`` every ``length - overlap`` over a partition's rows (entity, turn, start_ms, end_ms), with the words that each touches.

    Called as ``sliding_windows(TABLE(words) PARTITION BY (entity, turn) ORDER BY (start_ms), 30000, 5000)``. The last window
    ends where the last row does; none begins after one that reaches it. A row of a table with a column ``n`` stands for so
    many words (``alike_words``). Windows are emitted as soon as the rows have
    passed them, so only those that the current row can touch are held.
    """

    def __init__(self) -> None:
        self.open: list[list[int]] = []  # window number and rows so far
        self.next = 0
        self.end = 0
        self.key: tuple | None = None

    def eval(self, row: Row, length: int, overlap: int) -> Iterator[tuple]:
        self.key, self.length, self.step = (row["entity"], row["turn"]), length, max(1, length - overlap)
        self.end = max(self.end, row["end_ms"])
        words = row["n"] if "n" in row else 1
        # Every window that begins before this row's end, but none beyond the one that first reaches the end so far.
        while self.next * self.step < row["end_ms"]:
            self.open.append([self.next, 0])
            self.next += 1
        for window in self.open:
            start = window[0] * self.step
            if start < row["end_ms"] and row["start_ms"] < start + length:
                window[1] += words
        # A later row begins no earlier than this one: windows that end before it are done, except where they might be the last.
        done = [w for w in self.open if w[0] * self.step + length <= row["start_ms"]]
        self.open = self.open[len(done) :]
        for number, n in done:
            yield (*self.key, number, number * self.step, number * self.step + length, n)

    def terminate(self) -> Iterator[tuple]:
        if self.key is None:
            return
        for number, n in self.open:
            start = number * self.step
            if number and start - self.step + self.length >= self.end:
                return  # the window before reaches the end
            yield (*self.key, number, start, min(start + self.length, self.end), n)


def alike_words(words: DataFrame, keys: list[str], length: int, overlap: int) -> DataFrame:
    """Words (keys, start_ms, end_ms) that touch the same sliding windows as one row around them, with their number ``n``.

    The windows of the table function are the same for these rows, of which there are far fewer for it to take one by one.
    """
    step = max(1, length - overlap)
    first = F.greatest(F.floor((F.col("start_ms") - length) / step) + 1, F.lit(0))
    last = F.ceil(F.col("end_ms") / step) - 1
    alike = words.groupBy(*keys, first.alias("_first"), last.alias("_last"))
    return alike.agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n")).drop("_first", "_last")


def register(spark: SparkSession, name: str = "sliding_windows") -> None:
    spark.udtf.register(name, SlidingWindows)
