"""From findings to an edit list: seven passes over operations, each a data frame to a data frame, in an order that counts.

Words are snapped to and operations padded before neighbours are joined, as both widen them; what a cut covers goes before
the share of cuts is limited, as cuts that become mutes no longer cover anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.operators import greedy, remediation
from evidra.operators.sessions import span_sessions

# Fixed value: operations of one kind that are less apart than this are one.
JOIN_MS = 400
#: Where a region is blurred if nobody says where, in shares of the picture, and what replaced audio plays.
REGION, BED = (0.25, 0.25, 0.5, 0.5), "bed"


def lower(findings: DataFrame, strategy: str | None = None) -> DataFrame:
    """An operation (entity, id, op, s, e) for each finding that can be mended.

    Without a strategy it is the finding's own ``suggested_fix``, if that is an operation; with one it is the best that
    fits the file's budget, for findings whose fix isn't ``NONE``.
    """
    known = findings.filter(F.col("suggested_fix") != "NONE")
    if strategy is None:
        chosen = known.filter(F.col("suggested_fix").isin(*remediation.COST)).withColumn("op", F.col("suggested_fix"))
    else:
        chosen = known.join(greedy.choose_fixes(known, strategy), ["entity", "ord"]).filter("op is not null")
    return chosen.select("entity", F.col("ord").alias("id"), "op", F.col("start_ms").alias("s"), F.col("end_ms").alias("e"))


def join_neighbours(ops: DataFrame, gap_ms: int = JOIN_MS) -> DataFrame:
    """Operations of one kind less than ``gap_ms`` apart as one, with the findings of all; its id is the least of theirs."""
    spans = ops.withColumnsRenamed({"s": "start_ms", "e": "end_ms"})
    marked = span_sessions(spans, ["entity", "op"], gap_ms, ["start_ms", "id"], True)
    out = marked.groupBy("entity", "op", "session").agg(
        F.min("id").alias("id"), F.min("start_ms").alias("s"), F.max("end_ms").alias("e"), F.array_sort(F.collect_list("id")).alias("findings")
    )
    return out.drop("session")


def covered(ops: DataFrame, outer: str, inner: Column) -> DataFrame:
    """Without the operations that satisfy ``inner`` and lie wholly inside one of the kind ``outer``."""
    around = ops.filter(F.col("op") == outer).select(F.col("entity").alias("_entity"), F.col("s").alias("_s"), F.col("e").alias("_e"))
    # The operation that begins first before it and ends last covers it if any does: a running maximum, no join of pairs.
    both = ops.select("entity", "s", F.lit(None).cast("long").alias("_e"), "id").unionByName(around.select(F.col("_entity").alias("entity"), F.col("_s").alias("s"), "_e", F.lit(None).cast("long").alias("id")))
    before = Window.partitionBy("entity").orderBy("s").rangeBetween(Window.unboundedPreceding, 0)
    reach = both.withColumn("reach", F.max("_e").over(before)).filter("id is not null").select("id", "reach")
    return ops.join(reach, "id").filter(~(inner & (F.coalesce("reach", F.lit(-1)) >= F.col("e")))).drop("reach")


def optimise(ops: DataFrame, duration_ms: int, words: DataFrame | None = None) -> DataFrame:
    """The operations after all passes: entity, n (their order), id, op, s, e, findings, box, asset and reason.

    ``reason`` says why a renderer must refuse one and is null for all others. ``words(entity, start_ms, end_ms)``
    """
    if words is not None:
        ops = remediation.snapped(ops, words, ["entity"])
    ops = join_neighbours(remediation.pad(ops, duration_ms))
    ops = covered(ops, "CUT", F.col("op") != "CUT")
    ops = covered(ops, "REPLACE_AUDIO", F.col("op") == "MUTE")
    ops = remediation.cut_budget(ops, duration_ms)
    box = F.when(F.col("op") == "BLUR_REGION", F.array(*map(F.lit, REGION)))
    ops = ops.withColumn("box", box).withColumn("asset", F.when(F.col("op") == "REPLACE_AUDIO", BED))
    ops = ops.withColumn("n", F.row_number().over(Window.partitionBy("entity").orderBy("s", "e", "id")))
    refused = remediation.invalid(ops, duration_ms).select("id", "reason")
    return ops.join(refused, "id", "left").select("entity", "n", "id", "op", "s", "e", "findings", "box", "asset", "reason")


def compile_edits(findings: DataFrame, duration_ms: int, words: DataFrame | None = None, strategy: str | None = None) -> DataFrame:
    return optimise(lower(findings, strategy), duration_ms, words)
