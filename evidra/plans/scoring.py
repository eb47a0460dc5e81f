"""Queries: fusion, risk, readiness and roll-ups of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.functions import evidence as ev
from evidra.operators import scoring as op
from evidra.plans.registry import registry
from evidra.sources.logical import DURATION_MS, FINDINGS_SQL, findings, observations

_WEIGHTED = "(1 - 1.0 * m_speech) * (1 - 0.85 * m_vision) * (1 - 0.8 * m_ocr) * (1 - 0.5 * m_other)"
_RISK = """least(0.99, CASE severity WHEN 'CRITICAL' THEN 1.0 WHEN 'HIGH' THEN 0.55 WHEN 'MEDIUM' THEN 0.28 ELSE 0.10 END * confidence
  * CASE WHEN severity = 'CRITICAL' OR end_ms = start_ms THEN 1.0 ELSE 0.35 + 0.65 * least(1.0, (end_ms - start_ms) / 10000) END
  * CASE WHEN start_ms < 30000 THEN 1.35 ELSE 1.0 END)"""
_DIM = "CASE split_part(clause, '-', 1) WHEN 'AF' THEN 'policy' WHEN 'COPY' THEN 'copyright' WHEN 'META' THEN 'metadata' WHEN 'ACC' THEN 'accessibility' WHEN 'AUD' THEN 'audio' END"
_RANK = "CASE severity WHEN 'LOW' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'HIGH' THEN 2 ELSE 3 END"
_q = lambda x, n=1_000_000: f"floor({x} * {n} + 0.5)::BIGINT"

query = registry()


@query(f"WITH {FINDINGS_SQL} SELECT ord, {_q(f'(1 - {_WEIGHTED})')} AS fused FROM f")
def noisy_or_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).select("ord", ev.quantised(ev.noisy_or(F.col("modalities"))).alias("fused"))


@query(f"""WITH {FINDINGS_SQL},
m AS (SELECT *, 1 - {_WEIGHTED} AS fused, (m_speech > 0)::INT + (m_vision > 0)::INT + (m_ocr > 0)::INT + (m_other > 0)::INT AS n,
  greatest(m_speech, m_vision, m_ocr, m_other) - least(CASE WHEN m_speech > 0 THEN m_speech ELSE 9 END, CASE WHEN m_vision > 0 THEN m_vision ELSE 9 END,
    CASE WHEN m_ocr > 0 THEN m_ocr ELSE 9 END, CASE WHEN m_other > 0 THEN m_other ELSE 9 END) AS gap FROM f),
r AS (SELECT *, CASE WHEN n >= 2 AND gap >= 0.5 THEN 'CONTRADICTION' WHEN m_speech = 0 AND m_ocr = 0 AND m_other = 0 AND fused < 0.70 THEN 'DEMOTE'
  WHEN n >= 2 AND fused >= 0.90 AND severity IN ('MEDIUM', 'HIGH') THEN 'PROMOTE' END AS rule FROM m)
SELECT ord, rule, {_q("(CASE WHEN rule = 'CONTRADICTION' THEN fused * 0.75 ELSE fused END)")} AS fused,
  CASE WHEN rule = 'DEMOTE' THEN 'LOW' WHEN rule = 'PROMOTE' THEN CASE severity WHEN 'MEDIUM' THEN 'HIGH' ELSE 'CRITICAL' END ELSE severity END AS severity,
  coalesce(rule = 'CONTRADICTION', false) AS review FROM r""")
def corroborate_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings(spark, sf_dir).select("ord", ev.corroborate(F.col("modalities"), F.col("severity")).alias("c"))
    return f.select("ord", "c.rule", ev.quantised(F.col("c.fused")).alias("fused"), "c.severity", F.coalesce("c.review", F.lit(False)).alias("review"))


def _risky(spark: SparkSession, sf_dir: str) -> DataFrame:
    risk = ev.finding_risk(F.col("severity"), F.col("confidence"), F.col("start_ms"), F.col("end_ms"))
    return findings(spark, sf_dir).withColumn("risk", risk)


@query(f"WITH {FINDINGS_SQL} SELECT ord, {_q(_RISK)} AS risk FROM f")
def finding_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _risky(spark, sf_dir).select("ord", ev.quantised(F.col("risk")).alias("risk"))


_SCORES = f"""{FINDINGS_SQL}, r AS (SELECT entity, {_DIM} AS dim, {_RISK} AS risk FROM f),
s AS (SELECT entity, """ + ", ".join(f"100 - 100 * (1 - coalesce(product(1 - risk) FILTER (dim = '{d}'), 1)) AS {d}" for d in ev.DIMENSION_WEIGHT) + " FROM r GROUP BY entity)"


@query(f"WITH {_SCORES} SELECT entity, " + ", ".join(f"{_q(d, 1000)} AS {d}" for d in ev.DIMENSION_WEIGHT) + " FROM s")
def sub_scores_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = op.sub_scores(_risky(spark, sf_dir), "entity")
    return scores.select("entity", *(ev.quantised(F.col(d), 1000).alias(d) for d in ev.DIMENSION_WEIGHT))


_LEAST = f"least({', '.join(ev.DIMENSION_WEIGHT)})"
_MEAN = " + ".join(f"{w} * {d}" for d, w in ev.DIMENSION_WEIGHT.items())


@query(f"""WITH {_SCORES}, x AS (SELECT *, {_LEAST} AS worst, floor(least({_MEAN}, {_LEAST} + 15) + 0.5)::BIGINT AS overall, {_MEAN} > {_LEAST} + 15 AS capped FROM s)
SELECT entity, overall, CASE WHEN overall >= 85 AND worst >= 70 THEN 'SAFE' WHEN overall >= 70 AND worst >= 50 THEN 'REVIEW' WHEN overall >= 50 THEN 'HIGH_RISK'
  ELSE 'DO_NOT_PUBLISH' END AS verdict, CASE """ + " ".join(f"WHEN {d} = worst THEN '{d}'" for d in ev.DIMENSION_WEIGHT) + " END AS weakest, capped FROM x")
def readiness_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = op.sub_scores(_risky(spark, sf_dir), "entity")
    r = ev.readiness({d: F.col(d) for d in ev.DIMENSION_WEIGHT})
    return scores.select("entity", r.alias("r")).select("entity", "r.overall", "r.verdict", "r.weakest", "r.capped")


@query(f"""WITH {FINDINGS_SQL} SELECT entity, category, count(*) AS n, arg_max(severity, {_RANK}) AS worst,
  row_number() OVER (PARTITION BY entity ORDER BY max({_RANK}) DESC, count(*) DESC, category) AS place FROM f GROUP BY entity, category""")
def category_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.breakdown(findings(spark, sf_dir), "entity")


_SEGMENT = 600_000


@query(f"""WITH {FINDINGS_SQL}, g AS (SELECT range AS idx FROM range(0, {-(-DURATION_MS // _SEGMENT)})),
j AS (SELECT idx, f.*, {_RISK} AS risk FROM g JOIN f ON start_ms < least((idx + 1) * {_SEGMENT}, {DURATION_MS}) AND greatest(end_ms, start_ms + 1) > idx * {_SEGMENT}),
e AS (SELECT DISTINCT entity FROM f), a AS (SELECT entity, idx, count(*) AS n, sum(risk) AS risk, arg_max(severity, row(risk, -ord)) AS worst FROM j GROUP BY entity, idx),
m AS (SELECT entity, idx, clause FROM (SELECT entity, idx, clause, row_number() OVER (PARTITION BY entity, idx ORDER BY count(*) DESC, min(ord)) AS r FROM j GROUP BY entity, idx, clause) WHERE r = 1)
SELECT e.entity, g.idx::BIGINT AS idx, coalesce(n, 0) AS n, {_q("coalesce(risk / sum(risk) OVER (PARTITION BY e.entity), 0)", 10000)} AS share, clause, worst
FROM e CROSS JOIN g LEFT JOIN a ON a.entity = e.entity AND a.idx = g.idx LEFT JOIN m ON m.entity = e.entity AND m.idx = g.idx""")
def segment_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op.rollup(_risky(spark, sf_dir), "entity", DURATION_MS, _SEGMENT)
    return out.select("entity", "idx", "n", ev.quantised(F.col("share"), 10000).alias("share"), "clause", "worst")


@query(f"""WITH {FINDINGS_SQL}, s AS (SELECT entity, start_ms // 60000 AS idx, sum((1000000 * {_RISK})::BIGINT) AS risk FROM f GROUP BY ALL),
r AS (SELECT *, sum(risk) OVER (PARTITION BY entity ORDER BY risk DESC, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, sum(risk) OVER (PARTITION BY entity) AS total FROM s)
SELECT entity, idx FROM r WHERE risk > 0 AND coalesce(before, 0) < 0.8 * total""")
def risk_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _risky(spark, sf_dir).withColumn("idx", F.floor(F.col("start_ms") / 60000))
    shares = f.groupBy("entity", "idx").agg(F.sum(F.round(F.col("risk") * 1000000).cast("long")).alias("risk"))
    return op.concentration(shares, "entity", 0.8).select("entity", "idx")


@query(f"""WITH {FINDINGS_SQL}, b AS (SELECT range AS band, range * {DURATION_MS} // 96 AS lo, (range + 1) * {DURATION_MS} // 96 AS hi FROM range(0, 96)),
e AS (SELECT DISTINCT entity FROM f),
r AS (SELECT e.entity, band, coalesce(max(CASE severity WHEN 'CRITICAL' THEN 1.0 WHEN 'HIGH' THEN 0.76 WHEN 'MEDIUM' THEN 0.52 ELSE 0.28 END * confidence), 0) AS risk
  FROM e CROSS JOIN b LEFT JOIN f ON f.entity = e.entity AND end_ms > lo AND start_ms < hi GROUP BY e.entity, band)
SELECT entity, band::BIGINT AS band, {_q("greatest(risk, 0.45 * coalesce(lag(risk) OVER o, 0), 0.45 * coalesce(lead(risk) OVER o, 0))", 1000)} AS risk FROM r WINDOW o AS (PARTITION BY entity ORDER BY band)""")
def risk_bands_bleed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op.risk_bands(findings(spark, sf_dir), "entity", DURATION_MS)
    return out.select("entity", "band", ev.quantised(F.col("risk"), 1000).alias("risk"))


@query(f"""WITH {FINDINGS_SQL.split(",\nf AS")[0]}, t AS (SELECT count(DISTINCT entity) AS e FROM o), w(label, weight) AS (VALUES ('view', 0.4), ('click', 0.3), ('error', 0.2), ('purchase', 0.1), ('absent', 0.5))
, c AS (SELECT entity, label, least(1.0, count(*) / 20) AS c FROM o GROUP BY ALL), e AS (SELECT DISTINCT entity FROM o)
SELECT e.entity, {_q("(sum(weight * coalesce(c, 0)) / sum(weight))")} AS coverage FROM e CROSS JOIN w LEFT JOIN c ON c.entity = e.entity AND c.label = w.label GROUP BY e.entity""")
def surface_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = observations(spark, sf_dir)
    runs = o.groupBy("entity", "label").agg(F.least(F.lit(1.0), F.count("*") / 20).alias("coverage"))
    weights = {"view": 0.4, "click": 0.3, "error": 0.2, "purchase": 0.1, "absent": 0.5}
    return op.surface_coverage(runs, "entity", "label", weights).select("entity", ev.quantised(F.col("coverage")).alias("coverage"))


@query(f"""WITH {FINDINGS_SQL.split(",\nf AS")[0]}, l AS (SELECT DISTINCT label FROM o), e AS (SELECT DISTINCT entity FROM o), b AS (SELECT range AS band FROM range(0, {-(-DURATION_MS // 60000)})),
c AS (SELECT entity, label, ts_ms // 60000 AS band, count(*) AS hits FROM o WHERE ts_ms < {DURATION_MS} GROUP BY ALL),
t AS (SELECT entity, label, count(*) AS total FROM o GROUP BY ALL)
SELECT t.entity, t.label, band::BIGINT AS band, coalesce(hits, 0) AS hits, CASE WHEN coalesce(hits, 0) = 0 THEN 'UNEXAMINED'
  WHEN hits < greatest(1, 0.5 * total / {-(-DURATION_MS // 60000)}) THEN 'THIN' ELSE 'EXAMINED' END AS state
FROM t CROSS JOIN b LEFT JOIN c USING (entity, label, band)""")
def temporal_coverage_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.coverage_bands(observations(spark, sf_dir), DURATION_MS, 60_000)


@query(f"""WITH {FINDINGS_SQL}, c AS (SELECT entity, label, ts_ms // 60000 AS band FROM o WHERE label = 'view' AND ts_ms < {DURATION_MS} GROUP BY ALL),
a AS (SELECT entity, count(*) > 0 AS ran FROM o WHERE label = 'view' GROUP BY entity),
j AS (SELECT f.ord, any_value(a.ran) AS ran, count(c.band) AS seen, least({DURATION_MS} - 1, any_value(f.end_ms)) // 60000 - any_value(f.start_ms) // 60000 + 1 AS bands
  FROM f LEFT JOIN a USING (entity) LEFT JOIN c ON c.entity = f.entity AND c.band BETWEEN f.start_ms // 60000 AND least({DURATION_MS} - 1, f.end_ms) // 60000 GROUP BY f.ord)
SELECT ord, CASE WHEN ran IS NULL THEN 'NOT_RUN' WHEN seen = bands THEN 'NEGATIVE_EVIDENCE' ELSE 'NO_COVERAGE' END AS absence FROM j""")
def absence_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = op.coverage_bands(observations(spark, sf_dir).filter("label = 'view'"), DURATION_MS, 60_000)
    spans = findings(spark, sf_dir).select("entity", "ord", "start_ms", F.least("end_ms", F.lit(DURATION_MS - 1)).alias("end_ms"))
    return op.classify_absence(spans, bands, 60_000)
