"""Scenes and poster frames from measures of frames: windows and aggregates, no picture is touched."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidra.operators.signal import motion

# Fixed value: scales of less spread than this are all zero.
SPREAD = 1e-6


def scenes(differences: DataFrame, clips: DataFrame) -> DataFrame:
    """clip, scene (from 0), start_ms and end_ms: the stretches between cuts, of ``differences(clip, n, diff)``.

    ``clips(clip, frames, duration_ms)``: a difference n is that of frames n and n + 1 and stands at n steps of the clip's
    duration over its frames. Stretches of no length are none; a clip without a cut is one scene.
    """
    step = F.col("duration_ms") / F.col("frames")
    cuts = motion(differences).join(clips, "clip").select("clip", F.floor(F.col("n") * step).cast("long").alias("at"))
    edges = cuts.union(clips.select("clip", F.lit(0).cast("long"))).union(clips.select("clip", F.col("duration_ms").cast("long"))).distinct()
    w = Window.partitionBy("clip").orderBy("at")
    spans = edges.select("clip", F.col("at").alias("start_ms"), F.lead("at").over(w).alias("end_ms")).filter("end_ms is not null")
    return spans.withColumn("scene", F.row_number().over(Window.partitionBy("clip").orderBy("start_ms")) - 1)


def scene_lengths(found: DataFrame) -> DataFrame:
    """clip, scenes, and the mean (whole milliseconds), longest and shortest of their lengths."""
    length = F.col("end_ms") - F.col("start_ms")
    mean = F.floor(F.sum(length) / F.count("*")).cast("long")
    return found.groupBy("clip").agg(F.count("*").alias("scenes"), mean.alias("mean_ms"), F.max(length).alias("longest_ms"), F.min(length).alias("shortest_ms"))


def _scaled(value: str, by: Window):
    low, high = F.min(value).over(by), F.max(value).over(by)
    return F.when(high - low > SPREAD, (F.col(value) - low) / (high - low)).otherwise(0.0)


def ranked_frames(frames: DataFrame, *keys: str) -> DataFrame:
    """``frames(…, n, sharpness, colourfulness)`` with ``score``: the product of both, each scaled to its range within ``keys``."""
    by = Window.partitionBy(*keys)
    return frames.withColumn("score", _scaled("sharpness", by) * _scaled("colourfulness", by))


def best_frames(frames: DataFrame, *keys: str) -> DataFrame:
    """``keys`` and the frame of most colour, of most sharpness and of the best score; the earliest of equal ones."""
    top = lambda c: F.max_by("n", F.struct(F.col(c), -F.col("n")))
    return ranked_frames(frames, *keys).groupBy(*keys).agg(top("colourfulness").alias("most_colourful"), top("sharpness").alias("sharpest"), top("score").alias("best"))


def scene_posters(frames: DataFrame, found: DataFrame) -> DataFrame:
    """The best frame of each scene: ``frames(clip, n, at_ms, sharpness, colourfulness)`` in the scenes that ``scenes`` found.

    Scenes meet frames by order of time, not by pairs: a frame is of the last scene that began before it.
    """
    both = frames.select("clip", F.col("at_ms").alias("at"), "n", "sharpness", "colourfulness", F.lit(None).cast("int").alias("scene")).unionByName(
        found.select("clip", F.col("start_ms").alias("at"), "scene"), allowMissingColumns=True
    )
    w = Window.partitionBy("clip").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("scene", F.max("scene").over(w)).filter("n is not null and scene is not null")
    return best_frames(placed, "clip", "scene")
