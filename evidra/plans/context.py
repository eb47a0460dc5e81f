"""Queries: contexts of spans, detectors and simulated scenarios."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.functions import evidence as ev
from evidra.operators import context as cx
from evidra.operators import detectors as de
from evidra.operators import greedy
from evidra.operators import remediation as rm
from evidra.plans.registry import registry
from evidra.sources.logical import FINDINGS_SQL, WORDS_SQL, findings, observations, table, words

query = registry()


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).select("entity", F.col("ord").alias("id"), F.col("start_ms").alias("s"), F.col("end_ms").alias("e"))


@query(f"""WITH {FINDINGS_SQL}, c AS (SELECT f.ord AS id, o.label, min(o.ts_ms) AS first FROM f JOIN o ON o.entity = f.entity AND o.ts_ms >= f.start_ms - 8000 AND o.ts_ms <= f.end_ms + 8000 GROUP BY ALL)
SELECT id, string_agg(label, ',' ORDER BY first, label) AS categories FROM c GROUP BY id""")
def cue_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = observations(spark, sf_dir).select("entity", F.col("ts_ms").alias("ts"), F.col("label").alias("category"))
    return cx.cue_categories(_spans(spark, sf_dir), cues, ["entity"]).select("id", F.array_join("categories", ",").alias("categories"))


@query(f"""WITH {FINDINGS_SQL}, h AS (SELECT a.ord AS id, string_agg(DISTINCT b.category, ',' ORDER BY b.category) AS labels, bool_or(b.category IN ('Violence')) AS graphic FROM f a JOIN f b ON a.entity = b.entity AND b.end_ms > a.start_ms AND b.start_ms < a.end_ms WHERE b.m_vision > 0 GROUP BY a.ord),
t AS (SELECT DISTINCT entity FROM f WHERE m_vision > 0)
SELECT f.ord AS id, CASE WHEN t.entity IS NOT NULL THEN coalesce(labels, '') END AS labels, CASE WHEN t.entity IS NOT NULL THEN coalesce(graphic, false) END AS graphic FROM f LEFT JOIN h ON h.id = f.ord LEFT JOIN t ON t.entity = f.entity""")
def vision_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks = findings(spark, sf_dir).filter("modalities['vision'] > 0").select("entity", F.col("start_ms").alias("rs"), F.col("end_ms").alias("re"), F.col("category").alias("label"), "category")
    out = cx.vision_context(_spans(spark, sf_dir), tracks, ["entity"], ("Violence",))
    return out.select("id", F.array_join("labels", ",").alias("labels"), "graphic")


@query(f"""WITH {FINDINGS_SQL}, r AS (SELECT f.ord AS id, o.ord AS frame, row_number() OVER (PARTITION BY f.ord ORDER BY o.ts_ms, o.ord) AS n FROM f JOIN o ON o.entity = f.entity AND o.ts_ms BETWEEN f.start_ms AND f.end_ms)
SELECT id, string_agg(frame::VARCHAR, ',' ORDER BY n) AS frames FROM r WHERE n <= 3 GROUP BY id""")
def evidence_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = observations(spark, sf_dir).select("entity", F.col("ts_ms").alias("ts"), F.col("ord").alias("frame"))
    return cx.evidence_frames(_spans(spark, sf_dir), frames, ["entity"]).select("id", F.array_join(F.transform("frames", lambda x: x.cast("string")), ",").alias("frames"))


_FORMS = WORDS_SQL + ", n AS (SELECT *, lower(regexp_replace(w, '[.,!?]', '', 'g')) AS form FROM w)"
_SOUGHT = [(1, ["of", "the", "in", "the"], 10), (2, ["de", "la", "que"], 0), (3, ["the", "and"], 5)]


@query(f"""WITH {_FORMS}, p(phrase_id, near, m, i, form) AS (VALUES {", ".join(f"({p}, {near}, {len(ws)}, {i}, '{w}')" for p, ws, near in _SOUGHT for i, w in enumerate(ws))}),
h AS (SELECT entity, turn, phrase_id, m, near, pos - i AS start, count(*) AS n FROM n JOIN p USING (form) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY entity, turn, phrase_id ORDER BY n DESC, abs(start - near), start) AS r FROM h WHERE n >= m * 0.6 AND start >= 0)
SELECT entity, turn, phrase_id, start, n AS matched FROM r WHERE r = 1""")
def phrase_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = words(spark, sf_dir).withColumn("form", F.lower(F.regexp_replace("w", "[.,!?]", "")))
    return cx.locate(tokens, spark.createDataFrame(_SOUGHT, "phrase_id int, words array<string>, near int"), ["entity", "turn"])


@query()
def pattern_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cx.pattern_words(words(spark, sf_dir), ["entity", "turn"], r"\bthe \w+ of\b")


@query()
def quotation_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = words(spark, sf_dir).withColumn("form", F.lower(F.regexp_replace("w", "[.,!?]", "")))
    return cx.quotations(tokens, ["entity", "turn"], ["that", "que", "not", "dass"])


@query()
def event_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cx.dedupe_events(findings(spark, sf_dir).withColumn("kind", F.col("category")))


@query(f"""WITH {FINDINGS_SQL} SELECT ord, CASE WHEN end_ms - start_ms >= 15000 THEN 'watermark' WHEN m_ocr > 0 AND confidence < 0.3 THEN 'caption' WHEN m_speech > 0 THEN 'spoken' ELSE 'other' END AS role FROM f""")
def role_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("watermark", "end_ms - start_ms >= 15000"), ("caption", "modalities['ocr'] > 0 and confidence < 0.3"), ("spoken", "modalities['speech'] > 0")]
    return cx.classify(findings(spark, sf_dir), rules, "other").select("ord", "role")


@query()
def evidence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings(spark, sf_dir).select("entity", "ord", "start_ms", "end_ms", "clause")
    moved = f.withColumn("start_ms", F.col("start_ms") + F.pmod("ord", F.lit(5)) * 400)
    return cx.evidence_pairs(greedy.match_runs(f, moved), f, moved)


@query(f"""WITH p AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, trim(regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<[^>]*>', ' ', 'g')) AS description, len(regexp_extract_all(html, '<li>')) AS n_tags FROM pages),
q AS (SELECT *, string_split_regex(lower(description), '[\\s/"''<>()]+') AS w FROM p),
l AS (SELECT *, len(list_filter(w, lambda x, i: list_bool_or([x = h OR ends_with(x, '.' || h) FOR h IN {list(de.AFFILIATE_HOSTS)}]) OR (regexp_matches(x, '(^|\\.)amazon\\.[a-z.]+$') AND coalesce(w[i + 1] = 'dp', false)))) > 0 AS paid, length(regexp_replace(title, '[^\\p{{L}}]', '', 'g')) AS letters, length(regexp_replace(title, '[^\\p{{Lu}}]', '', 'g')) AS capitals FROM q)
SELECT page_id, clause, severity FROM (SELECT page_id, 'META-01' AS clause, 'LOW' AS severity, letters >= 12 AND capitals > 0.7 * letters AS hit FROM l UNION ALL SELECT page_id, 'META-02', 'LOW', length(title) > 70 FROM l
UNION ALL SELECT page_id, 'META-03', 'LOW', length(description) < 200 FROM l UNION ALL SELECT page_id, 'META-04', 'LOW', n_tags > 5 FROM l
UNION ALL SELECT page_id, 'META-05', 'HIGH', (paid OR regexp_matches(description, '(?i)\\b(sponsor(ed|ship)?|paid partnership|affiliate|promo code|use (my|the) code)\\b'))
  AND NOT regexp_matches(description, '(?i)(#ad\\b|#sponsored\\b|\\bpaid promotion\\b|\\bincludes paid\\b|\\bdisclosure\\b)') FROM l) WHERE hit""")
def metadata_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article is the description, the entries of lists are the tags."""
    article = F.trim(F.regexp_replace(F.regexp_extract("html", "(?s)<article>(.*?)</article>", 1), "<[^>]*>", " "))
    p = table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), article.alias("description"), F.regexp_extract_all("html", F.lit("<li>"), F.lit(0)).alias("tags"), F.lit("").alias("spoken")
    )
    return de.metadata_findings(p, most_tags=5)


@query("""WITH m AS (SELECT user_id AS clip, avg(value) / 10 - 19 AS lufs, max(value) / 1000000 AS clipped, max(value) / 30 AS spread_db, min(value) - 0.05 AS phase FROM events GROUP BY user_id)
SELECT clip, 'AUD-01' AS clause, CASE WHEN abs(lufs + 14) >= 6 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM m WHERE abs(lufs + 14) > 2 UNION ALL SELECT clip, 'AUD-02', 'MEDIUM' FROM m WHERE clipped > 0.0001
UNION ALL SELECT clip, 'AUD-04', 'MEDIUM' FROM m WHERE spread_db >= 12 UNION ALL SELECT clip, 'AUD-05', CASE WHEN phase < -0.10 THEN 'HIGH' ELSE 'MEDIUM' END FROM m WHERE phase < 0.20""")
def sound_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("clip")).agg(
        (F.avg("value") / 10 - 19).alias("lufs"), (F.max("value") / 1000000).alias("clipped"), (F.max("value") / 30).alias("spread_db"), (F.min("value") - 0.05).alias("phase")
    )
    return de.sound_findings(m)


@query()
def scenario_simulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = de.explore(findings(spark, sf_dir))
    return out.select("scenario", "entity", "overall", "delta", ev.quantised(F.col("impact")).alias("impact"), ev.quantised(F.col("value")).alias("value"))


@query()
def best_scenario(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings(spark, sf_dir)
    edits = rm.lower(f).select(F.col("op").alias("scenario"), "entity", "op", F.col("s").alias("rs"), F.col("e").alias("re"))
    return de.best_within(de.simulate(f, edits), 4.0).select("entity", "scenario", "overall", "delta")
