"""Scores and roll-ups of findings: grouped aggregates, tumbling buckets, prefix sums and coverage grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions import evidence as ev


def sub_scores(findings: DataFrame, *entity: str) -> DataFrame:
    """A score from 0 to 100 for each dimension; a dimension without findings has 100."""
    dim = ev.dimension_of(F.col("clause"))
    scores = [(100 - 100 * (1 - F.coalesce(F.product(F.when(dim == d, 1 - F.col("risk"))), F.lit(1.0)))).alias(d) for d in ev.DIMENSION_WEIGHT]
    return findings.groupBy(*entity).agg(*scores)


def breakdown(findings: DataFrame, *entity: str) -> DataFrame:
    """Findings and worst severity of each category, in order of severity, then number."""
    rank = ev.rank_of(F.col("severity"))
    out = findings.groupBy(*entity, "category").agg(F.count("*").alias("n"), F.max_by("severity", rank).alias("worst"))
    order = Window.partitionBy(*entity).orderBy(ev.rank_of(F.col("worst")).desc(), F.desc("n"), "category")
    return out.withColumn("place", F.row_number().over(order).cast("long"))


def _buckets(start, end, width):
    """Numbers of the buckets that a half-open span touches; an instant touches one."""
    return F.explode(F.sequence(F.floor(start / width), F.floor((F.greatest(end, start + 1) - 1) / width)))


def rollup(findings: DataFrame, entity: str, duration_ms: int, segment_ms: int) -> DataFrame:
    """Each segment's findings (in every segment they touch), share of risk, commonest clause and severity of the riskiest."""
    n = -(-duration_ms // segment_ms)
    hit = findings.withColumn("idx", _buckets(F.col("start_ms"), F.col("end_ms"), segment_ms)).filter(F.col("idx").between(0, n - 1) & (F.col("start_ms") < duration_ms))
    clauses = hit.groupBy(entity, "idx", "clause").agg(F.count("*").alias("c"), F.min("ord").alias("o"), F.sum("risk").alias("risk"), F.max(F.struct("risk", -F.col("ord"), "severity")).alias("top"))
    sums = clauses.groupBy(entity, "idx").agg(
        F.sum("c").alias("n"), F.sum("risk").alias("risk"), F.max_by("clause", F.struct("c", -F.col("o"))).alias("clause"), F.max("top")["severity"].alias("worst")
    )
    grid = findings.select(entity).distinct().withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>")))
    every = Window.partitionBy(entity)
    share = F.coalesce(F.try_divide(F.col("risk"), F.sum("risk").over(every)), F.lit(0.0))
    return grid.join(sums, [entity, "idx"], "left").select(entity, "idx", F.coalesce("n", F.lit(0)).alias("n"), share.alias("share"), "clause", "worst")


def concentration(shares: DataFrame, entity: str, threshold: float) -> DataFrame:
    """The fewest rows whose risk reaches ``threshold`` of their entity's."""
    before = Window.partitionBy(entity).orderBy(F.desc("risk"), "idx").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("risk").over(Window.partitionBy(entity))
    kept = shares.withColumn("before", F.coalesce(F.sum("risk").over(before), F.lit(0))).withColumn("total", total)
    return kept.filter((F.col("risk") > 0) & (F.col("before") < threshold * F.col("total"))).drop("before", "total")


def risk_bands(findings: DataFrame, entity: str, duration_ms: int, bands: int = 96, bleed: float = 0.45) -> DataFrame:
    """The largest severity by confidence in each of equal bands; a share of it bleeds into the bands beside."""
    risk = ev.lookup(ev.SEVERITY_SCORE, F.col("severity"), 0.28) * F.col("confidence")
    grid = findings.select(entity).distinct().select(entity, F.explode(F.sequence(F.lit(0), F.lit(bands - 1)).cast("array<bigint>")).alias("band"))
    edge = lambda k: F.floor(k * duration_ms / bands)
    # A span's first and last band by arithmetic, one to either side for rounding, then the exact bounds.
    near = F.sequence(F.greatest(F.floor(F.col("start_ms") * bands / duration_ms) - 1, F.lit(0)), F.least(F.floor(F.col("end_ms") * bands / duration_ms) + 1, F.lit(bands - 1)))
    hit = findings.filter(F.col("start_ms") < duration_ms).select(entity, "start_ms", "end_ms", risk.alias("risk"), F.explode(near).alias("band"))
    hit = hit.filter((F.col("end_ms") > edge(F.col("band"))) & (F.col("start_ms") < edge(F.col("band") + 1)))
    out = grid.join(hit.groupBy(entity, "band").agg(F.max("risk").alias("risk")), [entity, "band"], "left")
    out = out.withColumn("risk", F.coalesce("risk", F.lit(0.0)))
    w = Window.partitionBy(entity).orderBy("band")
    side = lambda f: F.coalesce(f("risk").over(w), F.lit(0.0)) * bleed
    return out.withColumn("risk", F.greatest("risk", side(F.lag), side(F.lead)))


def surface_coverage(runs: DataFrame, entity: str, agent: str, weights: dict[str, float]) -> DataFrame:
    """Weighted mean of the agents' coverage; an agent that did not run weighs in with none."""
    terms = [F.coalesce(F.max(F.when(F.col(agent) == a, F.col("coverage"))), F.lit(0.0)) * w for a, w in weights.items()]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return runs.groupBy(entity).agg((total / sum(weights.values())).alias("coverage"))


def coverage_bands(samples: DataFrame, duration_ms: int, band_ms: int) -> DataFrame:
    """entity, label, band, hits and state (UNEXAMINED, THIN, EXAMINED) of every band of every label that was sampled."""
    n = -(-duration_ms // band_ms)
    counts = samples.groupBy("entity", "label", F.floor(F.col("ts_ms") / band_ms).alias("band")).agg(F.count("*").alias("hits"))
    totals = counts.groupBy("entity", "label").agg(F.sum("hits").alias("total"))
    grid = totals.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>")))
    hits = F.coalesce("hits", F.lit(0))
    thin = hits < F.greatest(F.lit(1.0), 0.5 * F.col("total") / n)
    state = F.when(hits == 0, "UNEXAMINED").when(thin, "THIN").otherwise("EXAMINED")
    return grid.join(counts, ["entity", "label", "band"], "left").select("entity", "label", "band", hits.alias("hits"), state.alias("state"))


def classify_absence(spans: DataFrame, bands: DataFrame, band_ms: int) -> DataFrame:
    """What finding nothing in a span says, by the weakest band that it touches; NOT_RUN where no band is known."""
    touched = spans.withColumn("band", F.explode(F.sequence(F.floor(F.col("start_ms") / band_ms), F.floor(F.col("end_ms") / band_ms))))
    seen = touched.join(bands.select("entity", "band", "state"), ["entity", "band"], "left").groupBy("ord").agg(
        F.bool_or(F.col("state").isNotNull()).alias("ran"), F.bool_or(F.col("state") == "UNEXAMINED").alias("blind"), F.bool_or(F.col("state") == "THIN").alias("thin")
    )
    absence = F.when(~F.col("ran"), "NOT_RUN").when(F.col("blind"), "NO_COVERAGE").when(F.col("thin"), "INSUFFICIENT_COVERAGE").otherwise("NEGATIVE_EVIDENCE")
    return seen.select("ord", absence.alias("absence"))


def caption_coverage(items: DataFrame, duration_ms: int) -> DataFrame:
    """entity, the share of the file that burned-in captions are shown (1 at most), their number, and if there are any."""
    caption = F.col("role") == "burned_in_caption"
    shown = F.sum(F.when(caption, F.col("end_ms") - F.col("start_ms")).otherwise(0))
    ratio = F.least(F.lit(1.0), shown / duration_ms) if duration_ms > 0 else F.lit(0.0)
    return items.groupBy("entity").agg(ratio.alias("ratio"), F.count_if(caption).alias("captions"), (F.count_if(caption) > 0).alias("burned_in"))


def pair_summary(pairs: DataFrame, *keys: str) -> DataFrame:
    """Counts of evidence pairs (before, after, removed): frames on either side, removed, and after frames that are lacking."""
    removed, has = F.coalesce("removed", F.lit(False)), lambda c: F.col(c).isNotNull()
    return pairs.groupBy(*keys).agg(
        F.count("*").alias("pairs"), F.count_if(has("before")).alias("before_frames"), F.count_if(has("after")).alias("after_frames"),
        F.count_if(removed).alias("removed"), F.count_if(~has("after") & ~removed).alias("after_unavailable"),
    )
