"""Expressions over one finding: fusion of modalities, severity rules, risk, readiness and bands.

A finding's modalities are a map from modality to confidence. Rounding is half-even nowhere: values stay as computed.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the evidence model.
MODALITY_WEIGHT = {"speech": 1.00, "music": 0.95, "access": 0.95, "meta": 0.90, "vision": 0.85, "ocr": 0.80, "metadata": 0.70, "audio": 0.60}
DEFAULT_WEIGHT = 0.5
SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
SEVERITY_RISK = {"CRITICAL": 1.00, "HIGH": 0.55, "MEDIUM": 0.28, "LOW": 0.10}
SEVERITY_SCORE = {"CRITICAL": 1.00, "HIGH": 0.76, "MEDIUM": 0.52, "LOW": 0.28}
DIMENSION_WEIGHT = {"policy": 0.40, "copyright": 0.30, "metadata": 0.12, "accessibility": 0.10, "audio": 0.08}
CLAUSE_DIMENSION = {"AF": "policy", "COPY": "copyright", "CID": "copyright", "META": "metadata", "ACC": "accessibility", "AUD": "audio", "VID": "accessibility", "DISC": "metadata"}
CONTRADICTION_GAP, CONTRADICTION_SCALE, PROMOTE_FUSED, DEMOTE_VISION = 0.5, 0.75, 0.90, 0.70
EARLY_MS, EARLY_FACTOR, RISK_CAP, HEADROOM = 30_000, 1.35, 0.99, 15.0


def lookup(values: dict, key: Column, default=None) -> Column:
    """``values[key]`` as a CASE, so no map is built per row."""
    case = reduce(lambda c, kv: c.when(key == kv[0], F.lit(kv[1])), list(values.items())[1:], F.when(key == next(iter(values)), F.lit(next(iter(values.values())))))
    return case if default is None else case.otherwise(F.lit(default))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def rank_of(severity: Column) -> Column:
    """0 for LOW to 3 for CRITICAL; null for anything else."""
    return lookup({s: i for i, s in enumerate(SEVERITIES)}, severity)


def parts(modalities: Column, coverage: Column | None = None, bit: Callable[[Column], Column] = lambda _: F.lit(0)) -> Column:
    """array(bit, miss, value, more) of the modalities of positive confidence: ``miss`` is 1 - weight * coverage * confidence.

    ``bit`` gives a modality a number to leave it out by in ``seen``; ``more`` says if it is another than vision.
    """
    share = lambda k: F.lit(1.0) if coverage is None else clamp(F.coalesce(F.try_element_at(coverage, k), F.lit(1.0)))
    miss = lambda e: 1 - lookup(MODALITY_WEIGHT, e["key"], DEFAULT_WEIGHT) * share(e["key"]) * clamp(e["value"])
    one = lambda e: F.struct(bit(e["key"]).alias("bit"), miss(e).alias("miss"), e["value"].alias("value"), (e["key"] != "vision").alias("more"))
    return F.transform(F.filter(F.map_entries(modalities), lambda e: e["value"] > 0), one)


def noisy_or(modalities: Column, coverage: Column | None = None) -> Column:
    """1 - product of (1 - weight * coverage * confidence) over modalities of positive confidence."""
    return 1 - F.aggregate(parts(modalities, coverage), F.lit(1.0), lambda acc, p: acc * p["miss"])


def active(modalities: Column) -> Column:
    """Names of the modalities of positive confidence."""
    return F.map_keys(F.map_filter(modalities, lambda _, v: v > 0))


def seen(parts: Column, lost: Column | None = None) -> Column:
    """struct(miss, n, low, high, more) of ``parts`` without those that have a bit of ``lost``, in one pass."""
    lost, none = F.lit(0) if lost is None else lost, F.lit(None).cast("double")
    step = lambda acc, p: F.when(p["bit"].bitwiseAND(lost) != 0, acc).otherwise(F.struct(
        (acc["miss"] * p["miss"]).alias("miss"), (acc["n"] + 1).alias("n"), F.least(acc["low"], p["value"]).alias("low"),
        F.greatest(acc["high"], p["value"]).alias("high"), (acc["more"] | p["more"]).alias("more"),
    ))
    return F.aggregate(parts, F.struct(F.lit(1.0).alias("miss"), F.lit(0).alias("n"), none.alias("low"), none.alias("high"), F.lit(False).alias("more")), step)


def corroborated(seen: Column, severity: Column) -> Column:
    """struct(rule, fused, severity, review) of what was ``seen``: contradiction before demotion before promotion."""
    fused = 1 - seen["miss"]
    contradiction = (seen["n"] >= 2) & (seen["high"] - seen["low"] >= CONTRADICTION_GAP)
    demote = ~seen["more"] & (fused < DEMOTE_VISION)
    promote = (seen["n"] >= 2) & (fused >= PROMOTE_FUSED) & severity.isin("MEDIUM", "HIGH")
    rule = F.when(contradiction, "CONTRADICTION").when(demote, "DEMOTE").when(promote, "PROMOTE")
    raised = F.when(severity == "MEDIUM", "HIGH").otherwise("CRITICAL")
    return F.struct(
        rule.alias("rule"),
        F.when(contradiction, fused * CONTRADICTION_SCALE).otherwise(fused).alias("fused"),
        F.when(rule == "DEMOTE", "LOW").when(rule == "PROMOTE", raised).otherwise(severity).alias("severity"),
        contradiction.alias("review"),
    )


def corroborate(modalities: Column, severity: Column, coverage: Column | None = None) -> Column:
    """struct(rule, fused, severity, review); a finding without an active modality is demoted like one seen by vision alone."""
    # By way of an array of one, so that the pass over the modalities is made once and not wherever its result is used.
    return F.transform(F.array(seen(parts(modalities, coverage))), lambda x: corroborated(x, severity))[0]


def finding_risk(severity: Column, confidence: Column, start_ms: Column, end_ms: Column, fused: Column | None = None) -> Column:
    """Severity by confidence by length by place, below one. A fused confidence of 0 counts as none."""
    sure = clamp(confidence if fused is None else F.when(F.coalesce(fused, F.lit(0.0)) == 0, confidence).otherwise(fused))
    span = F.greatest(end_ms - start_ms, F.lit(0))
    length = F.when((severity == "CRITICAL") | (span == 0), 1.0).otherwise(0.35 + 0.65 * F.least(F.lit(1.0), span / 10000))
    return F.least(F.lit(RISK_CAP), lookup(SEVERITY_RISK, severity, 0.28) * sure * length * F.when(start_ms < EARLY_MS, EARLY_FACTOR).otherwise(1.0))


def dimension_of(clause: Column) -> Column:
    return lookup(CLAUSE_DIMENSION, F.upper(F.substring_index(clause, "-", 1)), "policy")


def readiness(scores: dict[str, Column]) -> Column:
    """struct(overall, verdict, weakest, capped) of the five dimension scores."""
    weighted = reduce(lambda a, b: a + b, (scores[d] * w for d, w in DIMENSION_WEIGHT.items()))
    worst = F.least(*scores.values())
    overall = F.floor(F.least(weighted, worst + HEADROOM) + 0.5)
    weakest = F.coalesce(*(F.when(scores[d] == worst, d) for d in DIMENSION_WEIGHT))
    verdict = F.when((overall >= 85) & (worst >= 70), "SAFE").when((overall >= 70) & (worst >= 50), "REVIEW").when(overall >= 50, "HIGH_RISK").otherwise("DO_NOT_PUBLISH")
    return F.struct(overall.alias("overall"), verdict.alias("verdict"), weakest.alias("weakest"), (weighted > worst + HEADROOM).alias("capped"))


def temporal_iou(a0: Column, a1: Column, b0: Column, b1: Column, hull: bool = False) -> Column:
    """Intersection over union of spans; over the hull of both where ``hull`` is set."""
    both = F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0))
    union = F.greatest(a1, b1) - F.least(a0, b0) if hull else (a1 - a0) + (b1 - b0) - both
    return F.coalesce(F.try_divide(both.cast("double"), F.when(union > 0, union)), F.lit(0.0))


def is_file_scoped(start_ms: Column, end_ms: Column, duration_ms: Column, share: float = 0.9) -> Column:
    return (duration_ms > 0) & (end_ms - start_ms >= duration_ms * share)


def confidence_band(confidence: Column, cuts: tuple[float, float, float] = (0.98, 0.90, 0.80)) -> Column:
    """VERY_HIGH, HIGH, MEDIUM or LOW; sighted tracks use (0.95, 0.90, 0.75), the first of them exclusively."""
    return F.when(confidence >= cuts[0], "VERY_HIGH").when(confidence >= cuts[1], "HIGH").when(confidence >= cuts[2], "MEDIUM").otherwise("LOW")


def track_band(confidence: Column) -> Column:
    return F.when(confidence > 0.95, "VERY_HIGH").when(confidence >= 0.90, "HIGH").when(confidence >= 0.75, "MEDIUM").otherwise("LOW")


def duration_tier(duration_ms: Column) -> Column:
    minutes = duration_ms / 60000
    return F.when(minutes < 2, "short").when(minutes < 10, "standard").when(minutes < 30, "long").when(minutes < 60, "feature").otherwise("archive")


def quantised(x: Column, scale: int = 1_000_000) -> Column:
    """A double as a whole number of 1/scale, for results that engines must agree on."""
    return F.floor(x * scale + 0.5).cast("long")
