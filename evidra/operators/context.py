"""What stands around a span: cues, tracks, frames, phrases, quotations and the clauses to look at."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.operators.intervals import nearest, overlap_join
from evidra.operators.scans import scan_groups


def window_evidence(windows: DataFrame, frames: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """Each window's frames (start <= ts < end) and on-screen texts (touching its start counts), in order of time."""
    f = frames.select(*keys, F.col("ts").alias("rs"), F.col("ts").alias("re"), "frame")
    f = overlap_join(windows, f, keys, (True, False)).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rs", "frame"))).alias("f"))
    t = overlap_join(windows, items, keys, (True, False)).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rs", "text"))).alias("t"))
    plain = lambda c, n: F.coalesce(F.transform(c, lambda x: x[n]), F.array().cast("array<string>" if n == "text" else "array<bigint>"))
    return windows.join(f, "id", "left").join(t, "id", "left").select("id", plain("f", "frame").alias("frames"), plain("t", "text").alias("texts"))


def vision_context(spans: DataFrame, tracks: DataFrame, keys: list[str], graphic: tuple[str, ...] = ("weapon", "injury")) -> DataFrame:
    """Labels of the tracks that overlap each span, and whether one is graphic; null for all where nothing was tracked."""
    hit = overlap_join(spans, tracks, keys).groupBy("id").agg(F.array_sort(F.collect_set("label")).alias("labels"), F.bool_or(F.col("category").isin(*graphic)).alias("graphic"))
    any_track = tracks.select(*keys).distinct().withColumn("_any", F.lit(True))
    out = spans.join(hit, "id", "left").join(any_track, keys, "left")
    return out.select("id", F.when(F.col("_any"), F.coalesce("labels", F.array().cast("array<string>"))).alias("labels"), F.when(F.col("_any"), F.coalesce("graphic", F.lit(False))).alias("graphic"))


def cue_categories(spans: DataFrame, cues: DataFrame, keys: list[str], reach_ms: int = 8_000) -> DataFrame:
    """Categories of the cues within reach of each span, in the order in which they were first seen."""
    wide = spans.select(*keys, "id", (F.col("s") - reach_ms).alias("s"), (F.col("e") + reach_ms).alias("e"))
    points = cues.select(*keys, F.col("ts").alias("rs"), F.col("ts").alias("re"), "category")
    seen = overlap_join(wide, points, keys, (True, True)).groupBy("id", "category").agg(F.min("rs").alias("first"))
    order = F.transform(F.sort_array(F.collect_list(F.struct("first", "category"))), lambda x: x["category"])
    return spans.join(seen.groupBy("id").agg(order.alias("categories")), "id", "left").select("id", F.coalesce("categories", F.array().cast("array<string>")).alias("categories"))


def nearest_frame(spans: DataFrame, frames: DataFrame, keys: list[str], limit_ms: int) -> DataFrame:
    return nearest(spans, frames, keys, limit_ms, "frame")


def evidence_frames(spans: DataFrame, frames: DataFrame, keys: list[str], most: int = 3) -> DataFrame:
    """The first frames within each span."""
    f = frames.select(*keys, F.col("ts").alias("rs"), F.col("ts").alias("re"), "frame")
    hit = overlap_join(spans, f, keys, (True, True)).withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("rs", "frame"))).filter(F.col("n") <= most)
    return hit.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "frame"))), lambda x: x["frame"]).alias("frames"))


def locate(tokens: DataFrame, phrases: DataFrame, keys: list[str], floor: float = 0.6) -> DataFrame:
    """Where each phrase (phrase_id, words, near) stands best: most words in place, then nearest to the hint, then first."""
    parts = phrases.select("phrase_id", "near", F.size("words").alias("m"), F.posexplode("words").alias("i", "form"))
    hits = tokens.join(parts, "form").groupBy(*keys, "phrase_id", "m", "near", (F.col("pos") - F.col("i")).alias("start")).agg(F.count("*").alias("n"))
    good = hits.filter((F.col("n") >= F.col("m") * floor) & (F.col("start") >= 0))
    best = F.max(F.struct("n", (-F.abs(F.col("start") - F.col("near"))).alias("d"), (-F.col("start")).alias("s")))
    return good.groupBy(*keys, "phrase_id").agg(best.alias("b")).select(*keys, "phrase_id", (-F.col("b.s")).alias("start"), F.col("b.n").alias("matched"))


def pattern_words(tokens: DataFrame, keys: list[str], pattern: str) -> DataFrame:
    """Numbers of the first and last word that each match of a pattern in the joined words touches."""
    w = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = tokens.withColumn("rs", F.coalesce(F.sum(F.length("w") + 1).over(w), F.lit(0))).withColumn("re", F.col("rs") + F.length("w"))
    text = tokens.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "w"))), lambda x: x["w"]), " ").alias("text"))
    found = text.select(*keys, F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("hits"), F.split("text", pattern).alias("pieces"))
    each = found.select(*keys, F.posexplode(F.zip_with("hits", F.slice("pieces", 1, F.size("hits")), lambda h, p: F.struct(h.alias("hit"), F.length(p).alias("gap")))).alias("n", "x"))
    order = Window.partitionBy(*keys).orderBy("n")
    at = F.sum(F.col("x.gap") + F.length("x.hit")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    spans = each.select(*keys, F.struct(*keys, "n").alias("id"), "n", F.col("x.hit").alias("hit"), (at - F.length("x.hit")).alias("s"), at.alias("e"))
    return overlap_join(spans, placed.select(*keys, "pos", "rs", "re"), keys, width=256).groupBy(*keys, "n", "hit").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))


def classify(items: DataFrame, rules: list[tuple[str, str]], default: str) -> DataFrame:
    """With the role of the first rule (name, condition in SQL) that holds."""
    case = F.lit(default)
    for name, condition in reversed(rules):
        case = F.when(F.coalesce(F.expr(condition), F.lit(False)), name).otherwise(case)
    return items.withColumn("role", case)


def quotations(words: DataFrame, keys: list[str], cues: list[str], most_words: int = 60, most_ms: int = 20_000) -> DataFrame:
    """From each cue word to the end of its sentence, cut at so many words or ms; those that touch are one, cut again."""
    w = Window.partitionBy(*keys).orderBy("pos")
    ends = F.col("w").rlike("[.!?]$")
    ahead = w.rowsBetween(0, most_words)
    stop, last = F.min(F.when(ends, F.struct("pos", "end_ms"))).over(ahead), F.max(F.struct("pos", "end_ms")).over(ahead)
    spans = words.withColumn("_stop", F.coalesce(stop, last)).filter(F.col("form").isin(*cues)).select(*keys, "start_ms", F.least("_stop.end_ms", F.col("start_ms") + most_ms).alias("end_ms"))

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        for r in rows.sort_values(["start_ms", "end_ms"]).itertuples(index=False):
            if out and r.start_ms <= out[-1][1]:
                out[-1][1] = min(max(out[-1][1], r.end_ms), out[-1][0] + most_ms)
            else:
                out.append([r.start_ms, r.end_ms])
        frame = pd.DataFrame(out, columns=["start_ms", "end_ms"])
        for k in keys:
            frame[k] = rows[k].iloc[0]
        return frame[[*keys, "start_ms", "end_ms"]]

    kinds = ", ".join(f"{k} {words.schema[k].dataType.simpleString()}" for k in keys)
    return spans.groupBy(*keys).applyInPandas(merge, f"{kinds}, start_ms long, end_ms long")


def dedupe_events(events: DataFrame) -> DataFrame:
    """In order of start, longest first: of overlapping events of one kind the surer stays in the place of the other."""

    def scan(rows: list[tuple]) -> list[tuple]:
        kept: list[tuple] = []
        active: list[int] = []  # those of kept that end after the present start, in order
        for r in rows:
            active = [i for i in active if r.start_ms < kept[i].end_ms]
            at = next((i for i in active if kept[i].start_ms < r.end_ms), None)
            if at is None:
                active.append(len(kept))
                kept.append(r)
            elif r.confidence > kept[at].confidence:
                kept[at] = r
        return [r[:-1] for r in kept]

    rows = events.selectExpr("entity", "ord", "kind", "start_ms", "end_ms", "confidence", "start_ms - end_ms as _n")
    return scan_groups(rows, scan, "entity long, ord long, kind string, start_ms long, end_ms long, confidence double", ["entity", "kind"], ["start_ms", "_n", "ord"])


def clauses_in_order(hits: DataFrame, most: int = 5) -> DataFrame:
    """Clauses of a window from its sources in order: each where first met; a source adds its own while there are fewer than ``most``.

    ``hits(window, source, rank, clause)``; source 0 is the whole window.
    """
    first = hits.groupBy("window", "clause").agg(F.min(F.struct("source", "rank")).alias("at"))
    counts = first.groupBy("window", "at.source").agg(F.count("*").alias("n"))
    before = Window.partitionBy("window").orderBy("source").rowsBetween(Window.unboundedPreceding, -1)
    open_ = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).filter(F.col("before") < most).select("window", "source")
    return first.select("window", "clause", "at.source", "at.rank").join(open_, ["window", "source"])


def declared_context(charges: DataFrame, declared: DataFrame, key: str = "entity") -> DataFrame:
    """Charges with ``video_context``: what their file declares of itself (``declared(key, category, audience)``), null if nothing.

    It is about the whole file, so every charge of it gets the same line.
    """
    said = lambda name: F.when(F.trim(F.coalesce(name, F.lit(""))) != "", F.concat(F.lit(f'declared {name} "'), name, F.lit('"')))
    parts = F.concat_ws(", ", said("category"), said("audience"))
    lines = declared.select(key, F.when(parts != "", F.concat(F.lit("video metadata: "), parts)).alias("video_context"))
    return charges.join(lines.dropDuplicates([key]), key, "left")


def sane_charges(charges: DataFrame, allowed: DataFrame, windows: DataFrame, least_ms: int = 200) -> DataFrame:
    """Model rows (window, clause, evidence, s, e) whose clause the window was shown and whose evidence isn't blank, spans clamped."""
    ok = charges.filter("trim(evidence) <> ''").join(allowed.select("window", "clause").distinct(), ["window", "clause"])
    w = windows.select(F.col("id").alias("window"), F.col("s").alias("ws"), F.col("e").alias("we"))
    s = F.least(F.greatest("s", "ws"), F.col("we"))
    return ok.join(w, "window").withColumn("s", s).withColumn("e", F.greatest(F.least("e", "we"), F.col("s") + least_ms)).drop("ws", "we")


def evidence_pairs(changes: DataFrame, before: DataFrame, after: DataFrame, most: int = 12) -> DataFrame:
    """The gravest changes with the spans before and after, NEW ones first, then those that persist, then resolved ones."""
    rank = F.when(F.col("status") == "NEW", 0).when(F.col("status") == "PERSISTS", 1).otherwise(2)
    side = lambda df, n: df.select("entity", F.col("ord").alias(n), F.col("start_ms").alias(f"{n}_start"), F.col("end_ms").alias(f"{n}_end"))
    out = changes.join(side(before, "before"), ["entity", "before"], "left").join(side(after, "after"), ["entity", "after"], "left")
    place = F.row_number().over(Window.partitionBy("entity").orderBy(rank, F.col("before").asc_nulls_last(), "after"))
    return out.withColumn("place", place).filter(F.col("place") <= most)


def group_lines(words: DataFrame) -> DataFrame:
    """Words (frame, line, n, text, x, y, w, h, conf) as lines: text in order, the box around all, the least confidence."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), " ")
    right, bottom = F.max(F.col("x") + F.col("w")), F.max(F.col("y") + F.col("h"))
    return words.groupBy("frame", "line").agg(text.alias("text"), F.min("x").alias("x"), F.min("y").alias("y"), (right - F.min("x")).alias("w"), (bottom - F.min("y")).alias("h"), F.min("conf").alias("conf"))


def box_iou(a: Column, b: Column) -> Column:
    """Overlap over union of two boxes struct(x, y, w, h)."""
    side = lambda p, n: F.greatest(F.least(a[p] + a[n], b[p] + b[n]) - F.greatest(a[p], b[p]), F.lit(0.0))
    both = side("x", "w") * side("y", "h")
    return F.coalesce(F.try_divide(both, a["w"] * a["h"] + b["w"] * b["h"] - both), F.lit(0.0))


def select_frames(frames: DataFrame, flagged: DataFrame, keys: list[str], baseline: int, batch: int) -> DataFrame:
    """Frames within flagged spans and every so many others, with the number of their batch."""
    w = Window.partitionBy(*keys).orderBy("ts", "frame")
    n = F.count("*").over(Window.partitionBy(*keys))
    step = F.greatest(F.floor(n / baseline), F.lit(1))
    every = frames.withColumn("_base", F.pmod(F.row_number().over(w) - 1, step) == 0)
    points = every.select(*keys, "frame", F.col("ts").alias("rs"), F.col("ts").alias("re"))
    hit = overlap_join(flagged.withColumn("id", F.lit(0)), points, keys, (True, True)).select(*keys, "frame").distinct().withColumn("_flag", F.lit(True))
    chosen = every.join(hit, [*keys, "frame"], "left").filter(F.col("_base") | F.col("_flag"))
    return chosen.withColumn("batch", F.floor((F.row_number().over(w) - 1) / batch)).select(*keys, "frame", "ts", "batch")
