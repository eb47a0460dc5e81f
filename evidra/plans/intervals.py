"""Queries: joins on time, windows, sessions and islands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.functions import evidence as ev
from evidra.operators import intervals as iv
from evidra.operators import sessions as se
from evidra.plans.registry import registry
from evidra.sources.logical import FINDINGS_SQL, OBSERVATIONS_SQL, WORDS_SQL, findings, observations, table, words

query = registry()


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).select("entity", F.col("ord").alias("id"), F.col("start_ms").alias("s"), F.col("end_ms").alias("e"), "clause", "category")


def _right(df: DataFrame) -> DataFrame:
    return df.select("entity", F.col("id").alias("rid"), F.col("s").alias("rs"), F.col("e").alias("re"))


@query(f"WITH {FINDINGS_SQL} SELECT a.ord AS id, b.ord AS rid FROM f a JOIN f b ON a.entity = b.entity AND b.end_ms > a.start_ms AND b.start_ms < a.end_ms AND a.ord < b.ord")
def interval_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _spans(spark, sf_dir)
    return iv.overlap_join(f.select("entity", "id", "s", "e"), _right(f), ["entity"]).filter("id < rid").select("id", "rid")


@query(f"""WITH {FINDINGS_SQL} SELECT ord AS id, gap_ms, nearest FROM (SELECT f.ord, CASE WHEN o.ord IS NOT NULL THEN greatest(0, f.start_ms - o.ts_ms, o.ts_ms - f.end_ms) END AS gap_ms, o.ord AS nearest,
  row_number() OVER (PARTITION BY f.ord ORDER BY greatest(0, f.start_ms - o.ts_ms, o.ts_ms - f.end_ms), o.ord) AS r
  FROM f LEFT JOIN o ON o.entity = f.entity AND o.label = 'error' AND greatest(0, f.start_ms - o.ts_ms, o.ts_ms - f.end_ms) <= 15000) WHERE r = 1""")
def nearest_cue_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = observations(spark, sf_dir).filter("label = 'error'").select("entity", F.col("ts_ms").alias("ts"), "ord")
    return iv.nearest(_spans(spark, sf_dir).select("entity", "id", "s", "e"), cues, ["entity"], 15_000, "ord")


@query(f"""WITH {FINDINGS_SQL} SELECT a.ord AS id, arg_min(b.ord, row(b.start_ms, b.ord)) AS rid FROM f a LEFT JOIN (SELECT * FROM f WHERE category = 'Metadata') b
  ON a.entity = b.entity AND b.end_ms > a.start_ms AND b.start_ms < a.end_ms GROUP BY a.ord""")
def first_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _spans(spark, sf_dir)
    return iv.first_overlap(f.select("entity", "id", "s", "e"), _right(f.filter("category = 'Metadata'")), ["entity"])


_DURATIONS = f"{WORDS_SQL}, d AS (SELECT entity, turn, max(end_ms) AS duration FROM w GROUP BY ALL)"


@query(f"""WITH {_DURATIONS} SELECT entity, turn, i AS idx, i * 25000 AS s, least(i * 25000 + 30000, duration) AS e
  FROM (SELECT *, unnest(generate_series(0, greatest(ceil((duration - 30000) / 25000), 0)::BIGINT)) AS i FROM d)""")
def sliding_windows_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = words(spark, sf_dir).groupBy("entity", "turn").agg(F.max("end_ms").alias("duration"))
    return iv.window_bounds(d, 30_000, 5_000).select("entity", "turn", "idx", "s", "e")


@query(f"""WITH {_DURATIONS}, v AS (SELECT entity, turn, i, i * 25000 AS s, least(i * 25000 + 30000, duration) AS e
  FROM (SELECT *, unnest(generate_series(0, greatest(ceil((duration - 30000) / 25000), 0)::BIGINT)) AS i FROM d))
SELECT v.entity, v.turn, v.i AS idx, coalesce(string_agg(w.w, ' ' ORDER BY pos), '') AS text FROM v LEFT JOIN w ON w.entity = v.entity AND w.turn = v.turn AND w.end_ms > v.s AND w.start_ms < v.e GROUP BY ALL""")
def window_text_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = words(spark, sf_dir)
    d = w.groupBy("entity", "turn").agg(F.max("end_ms").alias("duration"))
    v = iv.window_bounds(d, 30_000, 5_000).withColumn("id", F.struct("entity", "turn", "idx"))
    return iv.text_in(v, w, ["entity", "turn"]).select("id.entity", "id.turn", "id.idx", "text")


@query(f"""WITH {WORDS_SQL}, l AS (SELECT entity, turn, greatest(max(end_ms) - 30000, 0) // 15000 AS n FROM w GROUP BY ALL),
g AS (SELECT entity, turn, unnest(generate_series(0, n)) * 15000 AS start_ms FROM l)
SELECT g.entity, g.turn, g.start_ms, count(w.pos) * 60000 / 30000 AS wpm FROM g LEFT JOIN w ON w.entity = g.entity AND w.turn = g.turn AND w.start_ms >= g.start_ms AND w.start_ms < g.start_ms + 30000 GROUP BY ALL""")
def hopping_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.hopping_rate(words(spark, sf_dir), ["entity", "turn"])


_ODD = "SELECT entity, turn, pos AS id, start_ms + 100 AS s, start_ms + 100 + (pos % 5) * 333 AS e FROM w"


@query(f"""WITH {WORDS_SQL}, s AS ({_ODD}) SELECT s.entity, s.turn, s.id, least(s.s, coalesce(min(w.start_ms), s.s)) AS s, greatest(s.e, coalesce(max(w.end_ms), s.e)) AS e
  FROM s LEFT JOIN w ON w.entity = s.entity AND w.turn = s.turn AND w.end_ms > s.s AND w.start_ms < s.e GROUP BY s.entity, s.turn, s.id, s.s, s.e""")
def snap_to_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = words(spark, sf_dir)
    odd = w.select("entity", "turn", F.struct("entity", "turn", "pos").alias("id"), (F.col("start_ms") + 100).alias("s"), (F.col("start_ms") + 100 + F.col("pos") % 5 * 333).alias("e"))
    return iv.snap_to_words(odd, w, ["entity", "turn"]).select("id.entity", "id.turn", F.col("id.pos").alias("id"), "s", "e")


_CUTS = "c AS (SELECT entity, start_ms AS cs, end_ms AS ce FROM f WHERE severity = 'CRITICAL' AND end_ms > start_ms AND category = 'Violence')"


@query(f"""WITH {FINDINGS_SQL}, {_CUTS}, m AS (SELECT f.ord AS id, start_ms AS ms, coalesce(sum(CASE WHEN cs < start_ms THEN least(ce, start_ms) - cs ELSE 0 END), 0) AS gone,
  coalesce(bool_or(start_ms >= cs AND start_ms < ce), false) AS inside FROM f LEFT JOIN c USING (entity) GROUP BY f.ord, start_ms)
SELECT id, CASE WHEN NOT inside THEN (ms - gone)::BIGINT END AS ms FROM m""")
def timemap_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings(spark, sf_dir)
    cuts = f.filter("severity = 'CRITICAL' and end_ms > start_ms and category = 'Violence'").select("entity", F.col("start_ms").alias("cs"), F.col("end_ms").alias("ce"))
    return iv.map_instant(f.select(F.col("ord").alias("id"), "entity", F.col("start_ms").alias("ms")), cuts, ["entity"])


@query(f"""WITH {OBSERVATIONS_SQL}, r AS (SELECT *, confidence < 0.5 AS flag, row_number() OVER (PARTITION BY entity ORDER BY ord) - 1 AS i,
  row_number() OVER (PARTITION BY entity ORDER BY ord) - row_number() OVER (PARTITION BY entity, confidence < 0.5 ORDER BY ord) AS run FROM o)
SELECT entity, min(i) * 500 AS start_ms, (max(i) + 1) * 500 AS end_ms FROM r WHERE flag GROUP BY entity, run HAVING (max(i) + 1 - min(i)) * 500 >= 1500""")
def threshold_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.islands(observations(spark, sf_dir), ["entity"], "ord", F.col("confidence") < 0.5, 500, 1500)


@query(f"""WITH {OBSERVATIONS_SQL}, g AS (SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER p <= 60000 THEN 0 ELSE 1 END AS new FROM o WINDOW p AS (PARTITION BY entity, label ORDER BY ts_ms, ord)),
s AS (SELECT *, sum(new) OVER (PARTITION BY entity, label ORDER BY ts_ms, ord ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT entity, label, session::BIGINT AS session, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms, count(*) AS frames,
  floor(CASE WHEN count(*) = 1 THEN least(max(confidence), 0.80) ELSE least(0.99, max(confidence) + least(0.16, 0.04 * (count(*) - 1))) END * 1000000 + 0.5)::BIGINT AS confidence
FROM s GROUP BY entity, label, session""")
def label_tracks_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.tracks(observations(spark, sf_dir), ["entity"], 60_000).withColumn("confidence", ev.quantised(F.col("confidence")))


def _merged_sql(gap: int, op: str, keys: str) -> str:
    return f"""WITH {FINDINGS_SQL}, g AS (SELECT *, CASE WHEN start_ms - max(end_ms) OVER (PARTITION BY {keys} ORDER BY start_ms, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) {op} {gap} THEN 0 ELSE 1 END AS new FROM f),
s AS (SELECT *, sum(new) OVER (PARTITION BY {keys} ORDER BY start_ms, ord ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT {keys}, session::BIGINT AS session, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n FROM s GROUP BY {keys}, session"""


@query(_merged_sql(20000, "<=", "entity, category"))
def span_session_running_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.merge_spans(findings(spark, sf_dir), ["entity", "category"], 20_000, ["start_ms", "ord"])


@query(_merged_sql(4000, "<", "entity, severity"))
def coalesce_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.merge_spans(findings(spark, sf_dir), ["entity", "severity"], 4_000, ["start_ms", "ord"], strict=True)


@query(f"""WITH {OBSERVATIONS_SQL}, r AS (SELECT *, coalesce((confidence - lag(confidence) OVER p >= 0.1)::INT, 0) AS rise, row_number() OVER p - 1 AS i, count(*) OVER (PARTITION BY entity) AS n FROM o WINDOW p AS (PARTITION BY entity ORDER BY ord)),
s AS (SELECT *, sum(rise) OVER (PARTITION BY entity ORDER BY ord ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS sum FROM r)
SELECT entity, max(sum)::BIGINT AS peak, arg_max(i, row(sum, -i)) AS at FROM s WHERE i + 10 <= n OR i = 0 GROUP BY entity""")
def rising_edge_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.rising_edges(observations(spark, sf_dir), ["entity"], "ord", F.col("confidence"), 0.1, 10)


@query(f"""WITH {OBSERVATIONS_SQL}, r AS (SELECT *, row_number() OVER p - 1 AS i, sum(k) OVER p AS upto, sum(k) OVER (PARTITION BY entity) AS total FROM o WINDOW p AS (PARTITION BY entity ORDER BY ord)),
t AS (SELECT DISTINCT entity, total, slot FROM r, range(0, 8) AS g(slot) WHERE total > 0)
SELECT t.entity, slot, min(i) AS sample FROM t JOIN r ON r.entity = t.entity AND r.upto * 16 >= t.total * (2 * slot + 1) GROUP BY t.entity, slot""")
def inverse_cdf_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.inverse_cdf(observations(spark, sf_dir), ["entity"], "ord", F.col("k").cast("double"), 8)


@query(f"WITH {OBSERVATIONS_SQL} SELECT ord, coalesce(sum(k) OVER (PARTITION BY entity ORDER BY ts_ms, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM o")
def running_elapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.running_total(observations(spark, sf_dir), ["entity"], ["ts_ms", "ord"], "k").select("ord", "before")


@query(f"WITH {OBSERVATIONS_SQL} SELECT entity, floor(quantile_cont(confidence, 0.1) * 1000000 + 0.5)::BIGINT AS floor, floor(median(confidence) * 1000000 + 0.5)::BIGINT AS middle FROM o GROUP BY entity")
def noise_floor_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = lambda x: ev.quantised(F.percentile("confidence", x))
    return observations(spark, sf_dir).groupBy("entity").agg(p(0.1).alias("floor"), p(0.5).alias("middle"))


@query(f"WITH {OBSERVATIONS_SQL}, l AS (SELECT label, list(k ORDER BY k) AS ks FROM o GROUP BY label) SELECT label, ks[least(len(ks), floor(0.95 * len(ks))::BIGINT + 1)] AS p95 FROM l")
def p95_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Counts of equal values come first, so what is ordered is as small as the value's range.
    from pyspark.sql import Window

    counts = observations(spark, sf_dir).groupBy("label", "k").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("label").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    n = F.sum("c").over(Window.partitionBy("label"))
    ranked = counts.select("label", "k", upto.alias("upto"), F.least(n, F.floor(n * 0.95) + 1).alias("at"))
    return ranked.filter("upto >= at").groupBy("label").agg(F.min("k").alias("p95"))


@query("""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, length(regexp_extract(html, '<title>([^<]*)</title>', 1)) > 70 AS too_long,
  length(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '[^A-Z]', '', 'g')) AS capitals, len(regexp_extract_all(html, '<a ')) AS links FROM pages""")
def page_title_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return table(spark, sf_dir, "pages").select(
        "page_id", title.alias("title"), (F.length(title) > 70).alias("too_long"), F.length(F.regexp_replace(title, "[^A-Z]", "")).cast("long").alias("capitals"),
        F.regexp_count("html", F.lit("<a ")).cast("long").alias("links"),
    )


@query(f"""WITH {_DURATIONS}, v AS (SELECT entity, turn, i AS idx, i * 25000 AS s, least(i * 25000 + 30000, duration) AS e
  FROM (SELECT *, unnest(generate_series(0, greatest(ceil((duration - 30000) / 25000), 0)::BIGINT)) AS i FROM d))
SELECT v.entity, v.turn, idx, s, e, count(*) AS n FROM v JOIN w ON w.entity = v.entity AND w.turn = v.turn AND w.start_ms < v.e AND w.end_ms > v.s GROUP BY ALL""")
def sliding_windows_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table function's windows, with the number of words in each."""
    from evidra.functions.windows import alike_words, register

    register(spark)
    alike_words(words(spark, sf_dir), ["entity", "turn"], 30_000, 5_000).createOrReplaceTempView("timed_words")
    return spark.sql("SELECT * FROM sliding_windows(TABLE(timed_words) PARTITION BY (entity, turn) ORDER BY (start_ms), 30000, 5000)")
