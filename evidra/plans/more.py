"""Queries: comparison of runs, claims, plans and the batch twins of the streaming windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.operators import adjudication as ad
from evidra.operators import certificate as ce
from evidra.operators import comparison as co
from evidra.operators import compiler as cm
from evidra.operators import detectors as de
from evidra.operators import emit, greedy
from evidra.operators import pictures as pi
from evidra.operators import remediation as rm
from evidra.plans.registry import registry
from evidra.sources.logical import DURATION_MS, FINDINGS_SQL, OBSERVATIONS_SQL, findings, observations, table
from evidra.streaming import windows as st

query = registry()


@query(f"""WITH {FINDINGS_SQL}, c AS (SELECT entity, severity, CASE WHEN k % 4 = 0 THEN 'RESOLVED' WHEN k % 4 = 3 THEN 'NEW' ELSE 'PERSISTS' END AS status FROM f),
a AS (SELECT entity, count_if(status = 'RESOLVED')::BIGINT AS resolved, count_if(status = 'PERSISTS')::BIGINT AS persisting, count_if(status = 'NEW')::BIGINT AS new, count_if(status = 'NEW' AND severity IN ('HIGH', 'CRITICAL')) AS grave FROM c GROUP BY entity),
s AS (SELECT entity, avg(confidence) AS seen FROM o GROUP BY entity)
SELECT entity, resolved, persisting, new, CASE WHEN grave > 0 THEN 'NEW_RISK_DETECTED' WHEN seen < 0.5 THEN 'INCONCLUSIVE' WHEN persisting = 0 AND new = 0 THEN 'VERIFIED_SAFE' WHEN resolved > 0 THEN 'PARTIALLY_REMEDIATED'
  WHEN new > 0 THEN 'NEW_RISK_DETECTED' ELSE 'NO_CHANGE' END AS verdict FROM a JOIN s USING (entity)""")
def comparison_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k") % 4
    changes = findings(spark, sf_dir).select("entity", "severity", F.when(k == 0, "RESOLVED").when(k == 3, "NEW").otherwise("PERSISTS").alias("status"))
    seen = observations(spark, sf_dir).groupBy("entity").agg(F.avg("confidence").alias("seen"))
    return co.verdicts(changes, seen)


@query(f"""WITH {FINDINGS_SQL}, c AS (SELECT entity, ord, 1 AS n, 'OBSERVATION' AS step, category || ' between ' || start_ms || ' and ' || end_ms AS text FROM f
UNION ALL SELECT entity, ord, 2, 'EVIDENCE', concat_ws(', ', CASE WHEN m_ocr > 0 THEN 'ocr' END, CASE WHEN m_other > 0 THEN 'other' END, CASE WHEN m_speech > 0 THEN 'speech' END, CASE WHEN m_vision > 0 THEN 'vision' END) FROM f
UNION ALL SELECT entity, ord, 3, 'POLICY', clause FROM f UNION ALL SELECT entity, ord, 4, 'SEVERITY', severity FROM f) SELECT * FROM c WHERE text <> ''""")
def reasoning_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.claims(findings(spark, sf_dir))


@query(f"""WITH {OBSERVATIONS_SQL}, k AS (SELECT entity, label AS kind, count(*) AS n FROM o GROUP BY ALL)
SELECT entity, sum(n)::BIGINT AS n, string_agg(kind || ' ' || n, ', ' ORDER BY kind) AS summary FROM k GROUP BY entity""")
def event_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return de.event_summary(observations(spark, sf_dir).withColumn("kind", F.upper("label")), "entity")


@query(f"""WITH {OBSERVATIONS_SQL}, h AS (SELECT entity, label AS kind, 'k' || k % 3 AS redacted, ts_ms AS start_ms, ts_ms + k * 1000 AS end_ms FROM o),
s AS (SELECT *, coalesce(start_ms - max(end_ms) OVER w > 60000, true) AS fresh FROM h WINDOW w AS (PARTITION BY entity, kind, redacted ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
n AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY entity, kind, redacted ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS session FROM s)
SELECT entity, kind, redacted, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n FROM n GROUP BY entity, kind, redacted, session""")
def merged_disclosures(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    hits = observations(spark, sf_dir).select("entity", F.col("label").alias("kind"), F.concat(F.lit("k"), (k % 3).cast("string")).alias("redacted"), F.col("ts_ms").alias("start_ms"), (F.col("ts_ms") + k * 1000).alias("end_ms"))
    return de.merged_disclosures(hits, ["entity"], 60_000).drop("session")


@query(f"""WITH {FINDINGS_SQL}, m AS (SELECT entity, start_ms // 60000 AS incident, ord, coalesce(k % 3 = 0, false) AS gone FROM f),
w AS (SELECT *, bool_or(NOT gone) OVER (PARTITION BY entity, incident) AS stands FROM m) SELECT entity, incident, ord FROM w WHERE NOT gone OR NOT stands""")
def upheld_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = F.when(F.col("k") % 3 == 0, "DISMISSED").when(F.col("k") % 3 == 1, "UPHELD")
    members = findings(spark, sf_dir).select("entity", F.floor(F.col("start_ms") / 60_000).alias("incident"), "ord", verdict.alias("verdict"))
    return co.upheld(members).drop("verdict")


@query(f"""WITH {FINDINGS_SQL}, g AS (SELECT entity, label AS agent, least(1.0, count(*) / 20) AS coverage FROM (SELECT entity, CASE label WHEN 'view' THEN 'vision' WHEN 'click' THEN 'ocr' WHEN 'error' THEN 'speech' ELSE label END AS label FROM o) GROUP BY ALL),
n AS (SELECT entity, bool_or(m_speech > 0) AS s, bool_or(m_vision > 0) AS v, bool_or(m_ocr > 0) AS c FROM f GROUP BY entity)
SELECT entity, agent, CASE WHEN coverage < 0.5 THEN 'TOO_LITTLE' ELSE 'SILENT' END AS state FROM g JOIN n USING (entity) WHERE NOT (CASE agent WHEN 'speech' THEN s WHEN 'vision' THEN v WHEN 'ocr' THEN c ELSE false END)""")
def silent_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("label") == "view", "vision").when(F.col("label") == "click", "ocr").when(F.col("label") == "error", "speech").otherwise(F.col("label"))
    agents = observations(spark, sf_dir).groupBy("entity", name.alias("agent")).agg(F.least(F.lit(1.0), F.count("*") / 20).alias("coverage"))
    return co.silent_agents(findings(spark, sf_dir), agents)


@query("""SELECT o_orderkey AS entity, CASE WHEN d < 120000 THEN 'short' WHEN d < 600000 THEN 'standard' WHEN d < 1800000 THEN 'long' WHEN d < 3600000 THEN 'feature' ELSE 'archive' END AS tier,
  CASE WHEN d <= 0 THEN 0 ELSE greatest(ceil((d - 30000) / 25000), 0)::BIGINT + 1 END AS windows, ceil(CASE WHEN d <= 0 THEN 0 ELSE greatest(ceil((d - 30000) / 25000), 0) + 1 END / 8)::BIGINT AS calls
FROM (SELECT o_orderkey, (o_totalprice * 20)::BIGINT AS d FROM orders)""")
def work_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entity"), F.round(F.col("o_totalprice") * 20).cast("long").alias("duration_ms"))
    return co.work_plan(files)


@query()
def incident_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings(spark, sf_dir)
    moved = f.withColumn("start_ms", F.col("start_ms") + F.pmod("ord", F.lit(5)) * 400)
    number = lambda x: greedy.incidents(x, DURATION_MS)
    return co.incident_changes(number(f), number(moved), greedy.match_runs(f.select("entity", "ord", "start_ms", "end_ms", "clause"), moved.select("entity", "ord", "start_ms", "end_ms", "clause")))


@query()
def render_program(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit.render_program(rm.dominance(rm.lower(findings(spark, sf_dir))), "entity")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.tumbling_counts(_events(spark, sf_dir), "1 hour", "1 hour").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query(f"""WITH {OBSERVATIONS_SQL}, e AS (SELECT user_id, event_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 2 hour, true)::INT AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM e)
SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, session""")
def session_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return st.sessions(_events(spark, sf_dir), "2 hours", "1 hour").select("user_id", ntz("first"), ntz("last"), "n")


@query(f"""WITH {FINDINGS_SQL}, c AS (SELECT entity, '"' || clause || '"' AS clause, CASE WHEN ord % 3 = 0 THEN 'RESOLVED' WHEN ord % 7 = 0 THEN 'NEW' ELSE 'PERSISTS' END AS status FROM f),
m AS (SELECT entity, coalesce(string_agg(clause, ',' ORDER BY clause) FILTER (status = 'NEW'), '') AS new, coalesce(string_agg(clause, ',' ORDER BY clause) FILTER (status = 'PERSISTS'), '') AS persists,
  coalesce(string_agg(clause, ',' ORDER BY clause) FILTER (status = 'RESOLVED'), '') AS resolved FROM c GROUP BY entity),
p AS (SELECT entity, string_agg('{{"end_ms":' || end_ms || ',"op":"MUTE","start_ms":' || start_ms || '}}', ',' ORDER BY start_ms, end_ms) AS ops FROM f WHERE ord % 10 = 0 GROUP BY entity),
r AS (SELECT entity, count(*) AS original, count(*) FILTER (k < 40) AS predicted, count(*) FILTER (k >= 40) AS actual, entity % 4 <> 0 AS ok, entity % 5 <> 0 AS structural FROM f GROUP BY entity),
b AS (SELECT entity, '{{"coverage":{{"byAgent":[{{"agent":"speech","coverage":' || ((entity % 4 + 1) / 8.0)::DOUBLE || '}}],"gated":["speech"]}},"findings":{{"new":[' || new || '],"persists":[' || persists || '],"resolved":[' || resolved
  || ']}},"issuedAt":"2024-01-01","limitations":[' || CASE WHEN ok THEN '' ELSE '"The remediated file was not analysed again: no score or removal was measured.",' END
  || CASE WHEN structural THEN '' ELSE '"The remediated file''s structure was not verified.",' END || '"Too little was seen to tell absence: speech."],"lineage":{{"run":"run ' || entity || '"}},"operations":[' || coalesce(ops, '')
  || '],"policyVersion":"2026-08","scores":{{"actual":' || CASE WHEN ok THEN actual::VARCHAR ELSE '"NOT MEASURED"' END || ',"delta":' || CASE WHEN ok THEN (actual - original)::VARCHAR ELSE '"NOT MEASURED"' END
  || ',"original":' || original || ',"predicted":' || predicted || '}},"verification":{{"reanalysis":' || ok || ',"structural":' || structural || '}},"version":"1.0"}}' AS body FROM r JOIN m USING (entity) LEFT JOIN p USING (entity))
SELECT entity, 'sha256:' || sha256(body) AS digest, true AS intact FROM b""")
def certificate_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Certificates of a second run that lost each third finding and brought each seventh, with their digests."""
    f, e = findings(spark, sf_dir), F.col("entity")
    status = F.when(F.col("ord") % 3 == 0, "RESOLVED").when(F.col("ord") % 7 == 0, "NEW").otherwise("PERSISTS")
    scores = [F.count("*").alias("original"), F.count_if(F.col("k") < 40).alias("predicted"), F.count_if(F.col("k") >= 40).alias("actual")]
    known = [F.lit("2024-01-01").alias("issued_at"), F.lit("2026-08").alias("policy_version"), F.struct(F.concat(F.lit("run "), e.cast("string")).alias("run")).alias("lineage")]
    runs = f.groupBy("entity").agg(*scores).select("*", *known, (e % 4 != 0).alias("reanalysis_ok"), (e % 5 != 0).alias("structural_ok"))
    seen = runs.select("entity", F.lit("speech").alias("agent"), ((e % 4 + 1) / 8).alias("coverage"))
    ops = f.filter(F.col("ord") % 10 == 0).select("entity", F.lit("MUTE").alias("op"), "start_ms", "end_ms")
    sealed = ce.sealed(ce.bodies(runs, f.select("entity", "clause", status.alias("status")), seen, ops), F.concat(F.lit("CERT-"), e.cast("string")))
    return sealed.select("entity", F.get_json_object("body", "$.certificateHash").alias("digest"), ce.intact(F.col("body")).alias("intact"))


@query(f"""WITH {FINDINGS_SQL}, p AS (SELECT entity, ord AS id, CASE k % 6 WHEN 0 THEN 'BLEEP' WHEN 1 THEN 'CUT' WHEN 2 THEN 'MUTE' WHEN 3 THEN 'BLUR_REGION' WHEN 4 THEN 'REPLACE_AUDIO' END AS op, start_ms AS s, end_ms AS e FROM f WHERE k % 6 < 5),
a AS (SELECT entity, id, op, CASE WHEN op IN ('MUTE', 'BLEEP', 'REPLACE_AUDIO') THEN greatest(s - 60, 0) ELSE s END AS s, CASE WHEN op IN ('MUTE', 'BLEEP', 'REPLACE_AUDIO') THEN least(e + 80, {DURATION_MS}) ELSE e END AS e FROM p),
c AS (SELECT *, coalesce(s - max(e) OVER (PARTITION BY entity, op ORDER BY s, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 400, true) AS fresh FROM a),
g AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY entity, op ORDER BY s, id ROWS UNBOUNDED PRECEDING) AS session FROM c),
j AS (SELECT entity, op, min(id) AS id, min(s) AS s, max(e) AS e, count(*) AS findings FROM g GROUP BY entity, op, session),
d AS (SELECT * FROM j WHERE op = 'CUT' OR NOT EXISTS (SELECT 1 FROM j x WHERE x.entity = j.entity AND x.op = 'CUT' AND x.s <= j.s AND x.e >= j.e)),
m AS (SELECT * FROM d WHERE op <> 'MUTE' OR NOT EXISTS (SELECT 1 FROM d x WHERE x.entity = d.entity AND x.op = 'REPLACE_AUDIO' AND x.s <= d.s AND x.e >= d.e)),
t AS (SELECT *, sum(e - s) OVER (PARTITION BY entity, op) AS total, coalesce(sum(e - s) OVER (PARTITION BY entity, op ORDER BY e - s DESC, s, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM m),
b AS (SELECT entity, id, CASE WHEN op = 'CUT' AND total - before > {DURATION_MS} * 0.08 THEN 'MUTE' ELSE op END AS op, s, e, findings FROM t)
SELECT entity, row_number() OVER (PARTITION BY entity ORDER BY s, e, id)::INTEGER AS n, id, op, s, e, findings,
  CASE WHEN e <= s THEN 'not positive' WHEN e - s < 120 THEN 'too short' WHEN s < 0 OR e > {DURATION_MS} THEN 'outside the file' END AS reason FROM b""")
def compiled_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edit list of findings by the fix that each suggests, after all passes."""
    k = F.col("k") % 6
    fix = F.when(k == 0, "BLEEP").when(k == 1, "CUT").when(k == 2, "MUTE").when(k == 3, "BLUR_REGION").when(k == 4, "REPLACE_AUDIO").otherwise("NONE")
    out = cm.compile_edits(findings(spark, sf_dir).withColumn("suggested_fix", fix), DURATION_MS)
    return out.select("entity", "n", "id", "op", "s", "e", F.size("findings").cast("long").alias("findings"), "reason")


_PICTURES = """v AS (SELECT label AS clip, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS n, embedding AS e FROM embeddings),
c AS (SELECT clip, count(*) AS frames, count(*) * 400 AS duration_ms FROM v GROUP BY clip),
i AS (SELECT clip, n, round(list_sum(list_transform(list_zip(e[2:], e[:63]), lambda x: abs(x[1]::DOUBLE - x[2]::DOUBLE))) * 1000) AS sharpness, round(list_max(e)::DOUBLE * 1000 - list_min(e)::DOUBLE * 1000) AS colourfulness FROM v),
d AS (SELECT a.clip, a.n, CASE WHEN a.n % 17 IN (3, 11, 12) THEN 100.0 ELSE 5.0 + a.n % 3 END AS diff FROM v a JOIN c USING (clip) WHERE a.n < c.frames - 1)"""


def _pictures(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frames, clips and differences of frames: a label's vectors in order as the frames of a clip."""
    from pyspark.sql import Window

    place = (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("long")
    v = table(spark, sf_dir, "embeddings").select(F.col("label").alias("clip"), place.alias("n"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    steps = F.zip_with(F.slice("e", 2, 63), F.slice("e", 1, 63), lambda a, b: F.abs(a - b))
    sharp, colour = F.aggregate(steps, F.lit(0.0), lambda s, x: s + x), F.array_max("e") * 1000 - F.array_min("e") * 1000
    frames = v.select("clip", "n", (F.col("n") * 400).alias("at_ms"), F.round(sharp * 1000).alias("sharpness"), F.round(colour).alias("colourfulness"))
    clips = v.groupBy("clip").agg(F.count("*").alias("frames"), (F.count("*") * 400).alias("duration_ms"))
    diff = F.when((F.col("n") % 17).isin(3, 11, 12), 100.0).otherwise(5.0 + F.col("n") % 3)
    return frames, clips, v.join(clips, "clip").filter(F.col("n") < F.col("frames") - 1).select("clip", "n", diff.alias("diff"))


@query(f"""WITH {_PICTURES}, s AS (SELECT clip, t AS start_ms, lead(t) OVER (PARTITION BY clip ORDER BY t) AS end_ms
  FROM (SELECT clip, n * 400 AS t FROM d WHERE diff = 100 UNION SELECT clip, 0 FROM c UNION SELECT clip, duration_ms FROM c))
SELECT clip, count(*) AS scenes, floor(sum(end_ms - start_ms) / count(*))::BIGINT AS mean_ms, max(end_ms - start_ms)::BIGINT AS longest_ms, min(end_ms - start_ms)::BIGINT AS shortest_ms FROM s WHERE end_ms IS NOT NULL GROUP BY clip""")
def scene_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, clips, differences = _pictures(spark, sf_dir)
    return pi.scene_lengths(pi.scenes(differences, clips))


@query(f"""WITH {_PICTURES}, w AS (SELECT *, min(sharpness) OVER o AS s0, max(sharpness) OVER o AS s1, min(colourfulness) OVER o AS c0, max(colourfulness) OVER o AS c1 FROM i WINDOW o AS (PARTITION BY clip)),
z AS (SELECT clip, n, sharpness, colourfulness, CASE WHEN s1 - s0 > 1e-6 THEN (sharpness - s0) / (s1 - s0) ELSE 0 END * CASE WHEN c1 - c0 > 1e-6 THEN (colourfulness - c0) / (c1 - c0) ELSE 0 END AS score FROM w)
SELECT clip, arg_max(n, row(colourfulness, -n)) AS most_colourful, arg_max(n, row(sharpness, -n)) AS sharpest, arg_max(n, row(score, -n)) AS best FROM z GROUP BY clip""")
def best_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames, _, _ = _pictures(spark, sf_dir)
    return pi.best_frames(frames, "clip")


@query(f"""WITH {_PICTURES}, t AS (SELECT clip, n * 400 AS t FROM d WHERE diff = 100 UNION SELECT clip, 0 FROM c), s AS (SELECT clip, t, row_number() OVER (PARTITION BY clip ORDER BY t) - 1 AS scene FROM t),
p AS (SELECT i.*, s.scene FROM i ASOF JOIN s ON i.clip = s.clip AND i.n * 400 >= s.t),
w AS (SELECT *, min(sharpness) OVER q AS s0, max(sharpness) OVER q AS s1, min(colourfulness) OVER q AS c0, max(colourfulness) OVER q AS c1 FROM p WINDOW q AS (PARTITION BY clip, scene)),
z AS (SELECT clip, scene, n, sharpness, colourfulness, CASE WHEN s1 - s0 > 1e-6 THEN (sharpness - s0) / (s1 - s0) ELSE 0 END * CASE WHEN c1 - c0 > 1e-6 THEN (colourfulness - c0) / (c1 - c0) ELSE 0 END AS score FROM w)
SELECT clip, scene, arg_max(n, row(colourfulness, -n)) AS most_colourful, arg_max(n, row(sharpness, -n)) AS sharpest, arg_max(n, row(score, -n)) AS best FROM z GROUP BY clip, scene""")
def scene_posters(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames, clips, differences = _pictures(spark, sf_dir)
    return pi.scene_posters(frames, pi.scenes(differences, clips))


@query(f"""WITH {FINDINGS_SQL}, w AS (SELECT DISTINCT start_ms // 600000 AS win FROM f WHERE start_ms // 600000 % 5 <> 4),
c AS (SELECT ord AS charge, start_ms // 600000 AS win, clause, CASE WHEN k % 11 = 0 THEN ' ' ELSE 'said' END AS evidence, start_ms AS s, start_ms + k * 9000 AS e, k FROM f),
j AS (SELECT c.charge, c.k, c.clause, c.win, greatest(c.s, c.win * 600000) AS s, greatest(least(c.e, c.win * 600000 + 600000), greatest(c.s, c.win * 600000) + 200) AS e,
  CASE WHEN w.win IS NULL THEN 'no such window' WHEN clause LIKE '%-03' THEN 'clause not shown' WHEN trim(evidence) = '' THEN 'no evidence' END AS reason FROM c LEFT JOIN w USING (win)),
r AS (SELECT *, CASE WHEN k % 3 = 0 THEN 'not ruled' WHEN k % 9 = 1 THEN 'dismissed' END AS fate FROM j WHERE reason IS NULL),
u AS (SELECT 'finding' AS stage, charge AS id, NULL::BIGINT AS n, 'upheld' AS reason, clause, s, e, CASE WHEN k % 4 = 2 THEN 'context' END AS defence, CASE WHEN k % 4 = 2 THEN least(k / 50.0, 1.0) ELSE 0.0 END::DOUBLE AS strength FROM r WHERE fate IS NULL),
x AS (SELECT 'charge' AS stage, charge AS id, NULL::BIGINT AS n, reason FROM j WHERE reason IS NOT NULL UNION ALL SELECT 'charge', charge, NULL, fate FROM r WHERE fate IS NOT NULL
  UNION ALL SELECT 'defence', charge, 1, 'no such charge' FROM j WHERE k % 2 = 0 AND reason IS NOT NULL
  UNION ALL SELECT 'ruling', charge, i, CASE WHEN reason IS NOT NULL THEN 'no such charge' ELSE 'answered again' END FROM j, (VALUES (1), (2)) t(i) WHERE k % 3 <> 0 AND (i = 2 OR k % 5 = 0) AND (reason IS NOT NULL OR i = 1))
SELECT stage, id, n, reason, clause, s, e, defence, floor(strength * 1000 + 0.5)::BIGINT AS strength FROM u UNION ALL SELECT stage, id, n, reason, NULL, NULL, NULL, NULL, NULL FROM x""")
def adjudicated_charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charges that were upheld after their defence, and all rows of the answers that were not used, with why."""
    f, k = findings(spark, sf_dir), F.col("k")
    win = F.floor(F.col("start_ms") / 600_000)
    charges = f.select(F.col("ord").alias("charge"), win.alias("window"), "clause", F.when(k % 11 == 0, " ").otherwise("said").alias("evidence"), F.col("start_ms").alias("s"), (F.col("start_ms") + k * 9_000).alias("e"))
    windows = f.select(win.alias("window")).distinct().filter(F.col("window") % 5 != 4).select("window", (F.col("window") * 600_000).alias("ws"), (F.col("window") * 600_000 + 600_000).alias("we"))
    allowed = charges.filter(~F.col("clause").endswith("-03")).select("window", "clause").distinct()
    defences = f.filter(k % 2 == 0).select(F.col("ord").alias("charge"), F.lit(1).alias("n"), F.when(k % 4 == 0, " NULL ").otherwise("context").alias("defence"), (k / 50).alias("strength"))
    verdict = F.when(k % 9 == 1, "dismiss").otherwise("upheld")
    rulings = f.filter(k % 3 != 0).select(F.col("ord").alias("charge"), F.explode(F.when(k % 5 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(2)))).alias("n"), verdict.alias("verdict"), "severity", "confidence")
    out, upheld = ad.answers(charges, allowed, windows, defences, rulings).filter("reason is not null"), F.col("reason") == "upheld"
    of_finding = lambda c: F.when(upheld, c)
    strength = F.floor(F.col("strength") * 1000 + 0.5).cast("long")
    return out.select(F.when(upheld, "finding").otherwise(F.col("stage")).alias("stage"), "id", "n", "reason", *(of_finding(F.col(c)).alias(c) for c in ("clause", "s", "e", "defence")), of_finding(strength).alias("strength"))
