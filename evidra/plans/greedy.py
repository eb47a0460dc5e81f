"""Queries: order-dependent scans and numeric kernels; SQL has none of them, so tests hold models of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.operators import emit, greedy, signal
from evidra.plans.registry import registry
from evidra.sources.logical import DURATION_MS, OBSERVATIONS_SQL, findings, observations, table, words

query = registry()


@query()
def incident_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings(spark, sf_dir)
    return greedy.incident_summary(f.join(greedy.incidents(f, DURATION_MS), ["entity", "ord"]))


@query()
def iou_dedupe_growing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return greedy.dedupe_by_iou(findings(spark, sf_dir))


@query()
def greedy_run_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings(spark, sf_dir).select("entity", "ord", "start_ms", "end_ms", "clause")
    # The later run has what an edit that shortens loud findings leaves: spans move by up to two seconds.
    moved = f.withColumn("start_ms", F.col("start_ms") + F.pmod("ord", F.lit(5)) * 400).withColumn("end_ms", F.col("end_ms") + F.pmod("ord", F.lit(3)) * 900)
    return greedy.match_runs(f, moved)


@query()
def budgeted_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return greedy.choose_fixes(findings(spark, sf_dir))


@query()
def caption_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return greedy.caption_cues(words(spark, sf_dir))


@query()
def caption_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit.captions(greedy.caption_cues(words(spark, sf_dir)), ["entity", "turn"])


@query()
def ocr_style_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = observations(spark, sf_dir), F.col("k")
    box = [((k % 3) / 10).alias("x"), ((k % 2) / 2).alias("y"), F.lit(0.5).alias("w"), F.lit(0.25).alias("h")]
    return greedy.cluster_sightings(o.select("*", F.concat(F.initcap("label"), F.lit("  "), (k % 4).cast("string")).alias("text"), *box), gap_ms=120_000)


@query(f"""WITH RECURSIVE {OBSERVATIONS_SQL}, n AS (SELECT entity, ord, ts_ms, row_number() OVER (PARTITION BY entity ORDER BY ts_ms, ord) AS i FROM o),
r(entity, ord, ts_ms, i, last, ok) AS (SELECT entity, ord, ts_ms, i, ts_ms, true FROM n WHERE i = 1 UNION ALL
  SELECT n.entity, n.ord, n.ts_ms, n.i, CASE WHEN n.ts_ms - r.last >= 60000 THEN n.ts_ms ELSE r.last END, n.ts_ms - r.last >= 60000 FROM r JOIN n ON n.entity = r.entity AND n.i = r.i + 1)
SELECT entity, ord, ts_ms FROM r WHERE ok""")
def refractory_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return greedy.accepted_after_gap(observations(spark, sf_dir), 60_000)


@query()
def nearest_unique_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = observations(spark, sf_dir)
    return greedy.nearest_unique(o.filter("label = 'error'"), o.filter("label = 'view'"))


@query()
def gap_fill_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return greedy.spaced_samples(observations(spark, sf_dir).withColumn("priority", -F.col("confidence")), 20_000, 40, DURATION_MS)


def _clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clip for each user: the values of its events in order as samples."""
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("clip")).agg(F.sort_array(F.collect_list(F.struct("event_id", "value"))).alias("v"))
    return e.select("clip", F.lit(1000).alias("rate"), F.transform("v", lambda x: F.least(x["value"] / 100, F.lit(1.0))).alias("samples"))


@query()
def stft_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.stft_features(_clips(spark, sf_dir))


@query()
def clip_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.clip_features(_clips(spark, sf_dir))


@query()
def image_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), F.lit(8).alias("width"), F.transform("embedding", lambda x: (x + 1) * 127).alias("pixels"))
    return signal.image_statistics(v)
