"""Gaps and islands: runs of a condition, sessions by gap, and edges, all in window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(samples: DataFrame, keys: list[str], order: str, flag: Column, step_ms: int, min_ms: int) -> DataFrame:
    """[start, end) in ms of the runs of samples where ``flag`` holds, those of ``min_ms`` or more."""
    every, same = Window.partitionBy(*keys).orderBy(order), Window.partitionBy(*keys, "_flag").orderBy(order)
    runs = samples.withColumn("_flag", flag).withColumn("_i", F.row_number().over(every) - 1)
    runs = runs.withColumn("_run", F.col("_i") - F.row_number().over(same)).filter("_flag").groupBy(*keys, "_run")
    out = runs.agg((F.min("_i") * step_ms).cast("long").alias("start_ms"), ((F.max("_i") + 1) * step_ms).cast("long").alias("end_ms"))
    return out.filter(F.col("end_ms") - F.col("start_ms") >= min_ms).drop("_run")


def _numbered(df: DataFrame, keys: list[str], starts: Column, order: list) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_new", starts.cast("int")).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def point_sessions(points: DataFrame, keys: list[str], gap_ms: int, order: list) -> DataFrame:
    """Points numbered by session: a new one begins more than ``gap_ms`` after the last point."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return _numbered(points, keys, F.coalesce(F.col("ts_ms") - F.lag("ts_ms").over(w) > gap_ms, F.lit(True)), order)


def span_sessions(spans: DataFrame, keys: list[str], gap_ms: int, order: list, strict: bool = False) -> DataFrame:
    """Spans numbered by session: a new one begins more than ``gap_ms`` (strict: that or more) after all ends so far."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    gap = F.col("start_ms") - F.max("end_ms").over(before)
    return _numbered(spans, keys, F.coalesce(gap >= gap_ms if strict else gap > gap_ms, F.lit(True)), order)


def tracks(observations: DataFrame, keys: list[str], gap_ms: int = 4_000) -> DataFrame:
    """Runs of one label: span, sightings and a confidence that grows with persistence and is capped for one sighting."""
    s = point_sessions(observations, [*keys, "label"], gap_ms, ["ts_ms", "ord"])
    peak, n = F.max("confidence"), F.count("*")
    sure = F.when(n == 1, F.least(peak, F.lit(0.80))).otherwise(F.least(F.lit(0.99), peak + F.least(F.lit(0.16), 0.04 * (n - 1))))
    return s.groupBy(*keys, "label", "session").agg(F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"), n.alias("frames"), sure.alias("confidence"))


def merge_spans(spans: DataFrame, keys: list[str], gap_ms: int, order: list, strict: bool = False) -> DataFrame:
    s = span_sessions(spans, keys, gap_ms, order, strict)
    return s.groupBy(*keys, "session").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n"))


def rising_edges(samples: DataFrame, keys: list[str], order: str, value: Column, delta: float, width: int) -> DataFrame:
    """The most rises of ``delta`` or more within ``width`` samples, and where such a stretch first begins.

    Of a series shorter than the width all rises count.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    rise = (value - F.lag(value).over(w) >= delta).cast("int")
    d = samples.withColumn("_rise", F.coalesce(rise, F.lit(0))).withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    ahead = w.rowsBetween(0, width - 1)
    d = d.withColumn("_sum", F.sum("_rise").over(ahead)).filter((F.col("_i") + width <= F.col("_n")) | (F.col("_i") == 0))
    return d.groupBy(*keys).agg(F.max("_sum").alias("peak"), F.max(F.struct("_sum", (-F.col("_i")).alias("at")))["at"].alias("_at")).withColumn("at", (-F.col("_at")).cast("long")).drop("_at")


def running_total(rows: DataFrame, keys: list[str], order: list, value: str) -> DataFrame:
    """The sum of ``value`` of the rows before each one."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("before", F.coalesce(F.sum(value).over(before), F.lit(0)))


def inverse_cdf(samples: DataFrame, keys: list[str], order: str, weight: Column, count: int) -> DataFrame:
    """``count`` sample numbers for each key where the running share of the weight first reaches (i + 0.5) / count."""
    w = Window.partitionBy(*keys).orderBy(order)
    d = samples.withColumn("_w", weight).withColumn("_i", F.row_number().over(w) - 1)
    d = d.withColumn("_upto", F.sum("_w").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_w").over(Window.partitionBy(*keys)))
    # A sample takes the targets that lie in its own share, so no join is needed: slot i's is (2i + 1) / (2 * count).
    twice = lambda x: F.floor((2 * count * x - F.col("_all")) / (2 * F.col("_all")))
    first, last = twice(F.col("_upto") - F.col("_w")) + 1, twice(F.col("_upto"))
    d = d.filter("_all > 0").withColumn("_lo", F.greatest(first, F.lit(0))).withColumn("_hi", F.least(last, F.lit(count - 1)))
    return d.filter("_lo <= _hi").select(*keys, F.explode(F.sequence("_lo", "_hi")).alias("slot"), F.col("_i").cast("long").alias("sample"))
