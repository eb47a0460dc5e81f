"""Edit lists as passes over rows, and what edits would do to findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions import evidence as ev
from evidra.operators.intervals import overlap_join, snap_to_words

# Viewer impact, whether it re-encodes, and risk reduction of each operation.
COST = {"BLEEP": (0.15, False, 0.90), "MUTE": (0.25, False, 0.90), "REPLACE_AUDIO": (0.10, False, 0.95), "BLUR_REGION": (0.20, True, 0.85), "CUT": (0.80, True, 1.00)}
CEILING = {"conservative": 0.25, "balanced": 0.45, "aggressive": 0.80}
# The modalities that each edit destroys.
REMOVES = {
    "MUTE": ("speech", "audio", "music"), "BLEEP": ("speech",), "BLUR_REGION": ("vision", "ocr"), "REPLACE_AUDIO": ("music", "audio"),
    "CUT": ("speech", "audio", "music", "vision", "ocr", "access", "meta"), "INSERT_DISCLOSURE": ("meta",), "REPLACE_THUMBNAIL": ("meta",), "ADD_CAPTIONS": ("access",),
}
REMOVABLE = tuple(sorted({m for v in REMOVES.values() for m in v}))
AUDIO = ("MUTE", "BLEEP", "REPLACE_AUDIO")
TOLERANCE_MS, HEAD_MS, TAIL_MS, MIN_MS, CUT_SHARE = 250, 60, 80, 120, 0.08
#: Width of the buckets in which findings meet edits: most are shorter, so most stand in one bucket or two.
BUCKET_MS = 30_000


def lower(findings: DataFrame) -> DataFrame:
    """An operation for each finding, by category: what the least intrusive fix is."""
    kind = ev.lookup({"Language": "BLEEP", "Violence": "CUT", "Metadata": "MUTE", "Substances": "BLUR_REGION", "Sensitive": "REPLACE_AUDIO"}, F.col("category"))
    return findings.select("entity", F.col("ord").alias("id"), kind.alias("op"), F.col("start_ms").alias("s"), F.col("end_ms").alias("e"))


def pad(ops: DataFrame, duration_ms: int) -> DataFrame:
    """Audio operations a little wider, within the file."""
    audio = F.col("op").isin(*AUDIO)
    return ops.withColumn("s", F.when(audio, F.greatest(F.col("s") - HEAD_MS, F.lit(0))).otherwise(F.col("s"))).withColumn("e", F.when(audio, F.least(F.col("e") + TAIL_MS, F.lit(duration_ms))).otherwise(F.col("e")))


def dominance(ops: DataFrame) -> DataFrame:
    """Operations that lie wholly inside a cut go, and mutes wholly inside replaced audio."""
    r = ops.select("entity", F.col("id").alias("rid"), F.col("op").alias("rop"), F.col("s").alias("rs"), F.col("e").alias("re"))
    inside = (F.col("rs") <= F.col("s")) & (F.col("re") >= F.col("e")) & (((F.col("rop") == "CUT") & (F.col("op") != "CUT")) | ((F.col("rop") == "REPLACE_AUDIO") & (F.col("op") == "MUTE")))
    covered = overlap_join(ops, r.filter(F.col("rop").isin("CUT", "REPLACE_AUDIO")), ["entity"], (True, True)).filter(inside).select("id").distinct()
    return ops.join(covered, "id", "left_anti")


def cut_budget(ops: DataFrame, duration_ms: int, share: float = CUT_SHARE) -> DataFrame:
    """Where an entity's cuts exceed their share of the file, the longest become mutes until they don't."""
    length = F.col("e") - F.col("s")
    cut = F.col("op") == "CUT"
    order = Window.partitionBy("entity", "op").orderBy(length.desc(), "s", "id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(length).over(order), F.lit(0))
    total = F.sum(length).over(Window.partitionBy("entity", "op"))
    over = cut & (total - before > duration_ms * share)
    return ops.withColumn("op", F.when(over, "MUTE").otherwise(F.col("op")))


def invalid(ops: DataFrame, duration_ms: int) -> DataFrame:
    """Operations that a renderer must refuse, with the first reason.

    Blurs need a ``box`` and replaced audio an ``asset`` where ``ops`` has such columns; where it has ``n``, an entity's
    operations in order of it must not begin before the one before them.
    """
    s, e = F.col("s"), F.col("e")
    reason = F.when(e <= s, "not positive").when(e - s < MIN_MS, "too short").when((s < 0) | (e > duration_ms), "outside the file")
    if "box" in ops.columns:
        reason = reason.when((F.col("op") == "BLUR_REGION") & F.col("box").isNull(), "no box")
    if "asset" in ops.columns:
        reason = reason.when((F.col("op") == "REPLACE_AUDIO") & (F.coalesce("asset", F.lit("")) == ""), "no asset")
    if "n" in ops.columns:
        reason = reason.when(s < F.lag("s").over(Window.partitionBy("entity").orderBy("n")), "out of order")
    return ops.withColumn("reason", reason).filter("reason is not null")


def snapped(ops: DataFrame, words: DataFrame, keys: list[str]) -> DataFrame:
    """Audio operations at the bounds of the words that they touch."""
    new = snap_to_words(ops.filter(F.col("op").isin(*AUDIO)), words, keys)
    moved = ops.join(new.select("id", F.col("s").alias("_s"), F.col("e").alias("_e")), "id", "left")
    return moved.withColumn("s", F.coalesce("_s", "s")).withColumn("e", F.coalesce("_e", "e")).drop("_s", "_e")


def removed_by(op: Column) -> Column:
    """Bits, in the order of ``REMOVABLE``, of the modalities that an edit destroys."""
    return ev.lookup({k: sum(1 << REMOVABLE.index(m) for m in v) for k, v in REMOVES.items()}, op, 0)


def use(scenario: Column, op: Column) -> Column:
    return F.struct(scenario.alias("scenario"), op.alias("op"))


def weakened(findings: DataFrame, edits: DataFrame, uses: Column | None = None) -> DataFrame:
    """``findings`` with each scenario that takes something from them, ``lost`` (bits), survives, rule, fused and new_severity.

    ``edits(scenario, entity, op, rs, re)``; an edit reaches a finding that it touches or comes near, and one whose
    ``whole_file`` is set, where there is such a column, every finding of its entity. ``uses``, an array over other columns
    of ``edits``, says which scenarios make an edit, and as which op, where several make one of the same span.
    """
    uses = F.array(use(F.col("scenario"), F.col("op"))) if uses is None else uses
    whole = F.coalesce(F.col("whole_file"), F.lit(False)) if "whole_file" in edits.columns else F.lit(False)
    rest = [c for c in edits.columns if c not in ("entity", "rs", "re", "whole_file")]
    wide = edits.filter(~whole).select("entity", *rest, (F.col("rs") - TOLERANCE_MS).alias("rs"), (F.col("re") + TOLERANCE_MS).alias("re"))
    spans = findings.select("entity", F.col("ord").alias("_ord"), F.col("start_ms").alias("s"), F.col("end_ms").alias("e"))
    hit = overlap_join(spans, wide, ["entity"], (True, True), BUCKET_MS).select("entity", F.col("_ord").alias("ord"), *rest)
    if "whole_file" in edits.columns:
        hit = hit.unionByName(spans.join(edits.filter(whole).select("entity", *rest).distinct(), "entity").select("entity", F.col("_ord").alias("ord"), *rest))
    # All edits that reach a finding meet in one shuffle by finding; what a scenario's take is united there, and the join too.
    made = hit.repartition("entity", "ord").select("entity", "ord", F.inline(uses)).withColumn("lost", removed_by(F.col("op"))).filter("lost > 0")
    lost = made.groupBy("entity", "ord", "scenario").agg(F.bit_or("lost").alias("lost"))
    # Modalities are weighed once a finding, before it is repeated for each scenario.
    bit = lambda k: ev.lookup({m: 1 << i for i, m in enumerate(REMOVABLE)}, k, 0)
    weighed = findings.withColumn("_parts", ev.parts(F.col("modalities"), bit=bit))
    out = lost.join(weighed, ["entity", "ord"]).withColumn("seen", ev.seen(F.col("_parts"), F.col("lost")))
    survives = F.col("seen.n") > 0
    out = out.withColumn("survives", survives).withColumn("after", F.when(survives, ev.corroborated(F.col("seen"), F.col("severity"))))
    return out.select("scenario", *findings.columns, "lost", "survives", "after.rule", "after.fused", F.col("after.severity").alias("new_severity"))


def apply_edits(findings: DataFrame, edits: DataFrame) -> DataFrame:
    """Findings of each scenario after its edits: what they lose, whether anything is left, and how sure and grave that is.

    ``edits`` as for ``weakened``. What is left is corroborated anew, so ``fused``, ``severity`` and ``rule`` are those of a
    finding that had no more evidence to begin with; null if nothing is.
    """
    names = F.array_compact(F.array(*(F.when(F.col("lost").bitwiseAND(1 << i) != 0, m) for i, m in enumerate(REMOVABLE))))
    return weakened(findings, edits).select("scenario", "entity", "ord", names.alias("lost"), "survives", "fused", F.col("new_severity").alias("severity"), "rule")


def viewer_impact(edits: DataFrame) -> DataFrame:
    cost = ev.lookup({k: v[0] for k, v in COST.items()}, F.col("op"), 0.05)
    return edits.groupBy("scenario").agg(F.sum(cost).alias("impact"))
