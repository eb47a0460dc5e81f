"""Joins on time: overlap, nearest, first match, sliding and hopping windows, and maps through cuts.

A join on overlap is an equi-join on time buckets with the exact condition after it. A span is put into every bucket it
touches; a pair is kept only in the bucket where the later of the two starts, so it is found once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _spread(df: DataFrame, start: Column, end: Column, width: int) -> DataFrame:
    lo, hi = F.floor(start / width), F.floor(end / width)
    return df.withColumn("_bucket", F.explode(F.sequence(lo, F.greatest(lo, hi))))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], closed: tuple[bool, bool] = (False, False), width: int = 10_000) -> DataFrame:
    """Pairs of ``left(keys, s, e, ...)`` and ``right(keys, rs, re, ...)`` that overlap.

    ``closed`` says whether touching counts where the right span ends at s, and where it starts at e.
    """
    a, b = _spread(left, F.col("s"), F.col("e"), width), _spread(right, F.col("rs"), F.col("re"), width)
    meets = (F.col("re") >= F.col("s") if closed[0] else F.col("re") > F.col("s")) & (F.col("rs") <= F.col("e") if closed[1] else F.col("rs") < F.col("e"))
    once = F.col("_bucket") == F.floor(F.greatest("s", "rs") / width)
    return a.join(b, [*keys, "_bucket"]).filter(meets & once).drop("_bucket")


def nearest(left: DataFrame, points: DataFrame, keys: list[str], limit_ms: int, order: str) -> DataFrame:
    """``left(keys, s, e, id)`` with the gap to and the ``order`` of its nearest point ``ts`` within a limit; ties to the least order."""
    wide = left.select(*keys, "id", (F.col("s") - limit_ms).alias("s"), (F.col("e") + limit_ms).alias("e"), F.col("s").alias("_s"), F.col("e").alias("_e"))
    right = points.select(*keys, F.col("ts").alias("rs"), F.col("ts").alias("re"), F.col("ts"), F.col(order).alias("_order"))
    gap = F.greatest(F.lit(0), F.col("_s") - F.col("ts"), F.col("ts") - F.col("_e"))
    best = overlap_join(wide, right, keys, (True, True)).groupBy("id").agg(F.min(F.struct(gap.alias("gap"), "_order")).alias("best"))
    return left.join(best, "id", "left").select("id", F.col("best.gap").alias("gap_ms"), F.col("best._order").alias("nearest"))


def first_overlap(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Each ``id`` of left with the right ``rid`` that overlaps it and starts first; null without any."""
    found = overlap_join(left, right, keys).groupBy("id").agg(F.min(F.struct("rs", "rid")).alias("first"))
    return left.join(found, "id", "left").select("id", F.col("first.rid").alias("rid"))


def window_bounds(durations: DataFrame, length: int, overlap: int) -> DataFrame:
    """Sliding windows of each duration; the last is cut off, and none begins after one that reaches the end."""
    step = length - overlap
    last = F.greatest(F.ceil((F.col("duration") - length) / step), F.lit(0))
    each = durations.filter("duration > 0").withColumn("idx", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return each.withColumn("s", F.col("idx") * step).withColumn("e", F.least(F.col("idx") * step + length, F.col("duration")))


def text_in(spans: DataFrame, words: DataFrame, keys: list[str]) -> DataFrame:
    """The words that overlap each span, in order, with white space between; empty without any."""
    w = words.withColumnRenamed("start_ms", "rs").withColumnRenamed("end_ms", "re")
    found = overlap_join(spans, w, keys).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "w"))).alias("ws"))
    text = F.array_join(F.transform("ws", lambda x: x["w"]), " ")
    return spans.join(found.select("id", text.alias("text")), "id", "left").select("id", F.coalesce("text", F.lit("")).alias("text"))


def snap_to_words(spans: DataFrame, words: DataFrame, keys: list[str]) -> DataFrame:
    """Spans widened to the bounds of the words that they overlap; others as they are."""
    w = words.withColumnRenamed("start_ms", "rs").withColumnRenamed("end_ms", "re")
    found = overlap_join(spans, w, keys).groupBy("id").agg(F.min("rs").alias("ws"), F.max("re").alias("we"))
    return spans.join(found, "id", "left").select("id", F.least("s", F.coalesce("ws", "s")).alias("s"), F.greatest("e", F.coalesce("we", "e")).alias("e"))


def hopping_rate(words: DataFrame, keys: list[str], window: int = 30_000, stride: int = 15_000) -> DataFrame:
    """Words a minute in windows that start each stride, from 0 to the last that the words fill."""
    last = words.groupBy(*keys).agg(F.max("end_ms").alias("end"))
    top = F.floor(F.greatest(F.col("end") - window, F.lit(0)) / stride)
    hops = F.sequence(F.greatest(F.floor((F.col("start_ms") - window) / stride) + 1, F.lit(0)), F.floor(F.col("start_ms") / stride))
    counts = words.withColumn("hop", F.explode(hops)).groupBy(*keys, "hop").agg(F.count("*").alias("n"))
    grid = last.withColumn("hop", F.explode(F.sequence(F.lit(0).cast("long"), top)))
    rate = F.coalesce("n", F.lit(0)) * 60000 / window
    return grid.join(counts, [*keys, "hop"], "left").select(*keys, (F.col("hop") * stride).alias("start_ms"), rate.alias("wpm"))


def map_instant(instants: DataFrame, cuts: DataFrame, keys: list[str]) -> DataFrame:
    """``id`` and where its ``ms`` is after the cuts (cs, ce) are taken out; null inside a cut."""
    # Cuts and instants in one order of time: what the cuts before took out is a running sum, and the cuts that are open
    # are those begun less those ended. A cut's end stands before an instant there, a cut's beginning too.
    row = lambda id_, ms, kind, begun, at: F.struct(id_.alias("id"), ms.cast("long").alias("ms"), F.lit(kind).alias("kind"), F.lit(begun).alias("begun"), at.cast("long").alias("at"))
    none = F.lit(None)
    id_type = instants.schema["id"].dataType
    ends = cuts.dropna(subset=keys).select(*keys, F.inline(F.array(row(none.cast(id_type), F.col("cs"), 0, 1, F.col("cs")), row(none.cast(id_type), F.col("ce"), 0, -1, F.col("ce")))))
    points = instants.select(*keys, F.inline(F.array(row(F.col("id"), F.col("ms"), 1, 0, F.lit(0)))))
    w = Window.partitionBy(*keys).orderBy("ms", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    open_ = F.sum("begun").over(w)
    # Of ended cuts their length, of open ones what has passed: begins are taken off, ends and the instant added.
    passed = -F.sum(F.col("begun") * F.col("at")).over(w)
    out = ends.union(points).select("id", "ms", "kind", open_.alias("open"), passed.alias("passed")).filter("kind = 1")
    return out.select("id", F.when(F.col("open") == 0, F.col("ms") - F.col("passed")).alias("ms"))


def map_span(spans: DataFrame, cuts: DataFrame, keys: list[str]) -> DataFrame:
    """``id``, s and e of spans after the cuts: the last instant is mapped and one added; null where either end is cut."""
    one = lambda c, d: map_instant(spans.select("id", *keys, (F.col(c) - d).alias("ms")), cuts, keys).withColumnRenamed("ms", c)
    both = one("s", 0).join(one("e", 1), "id")
    whole = F.col("s").isNotNull() & F.col("e").isNotNull()
    return both.select("id", F.when(whole, F.col("s")).alias("s"), F.when(whole, F.col("e") + 1).alias("e"))
