"""Queries: stores, diffs, evaluation, edit lists and emitters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.functions import evidence as ev
from evidra.operators import emit
from evidra.operators import evaluation as el
from evidra.operators import remediation as rm
from evidra.operators import scoring as sc
from evidra.operators import stores as st
from evidra.plans.registry import registry
from evidra.sources.logical import DURATION_MS, FINDINGS_SQL, findings, table

query = registry()


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderpriority, o_orderkey) AS o_orderpriority, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey")
def latest_report_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.latest(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus"), "o_custkey", "o_orderkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7))")
def affected_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    changed = table(spark, sf_dir, "part").filter("p_size = 7").select(F.col("p_partkey").alias("l_partkey"))
    return st.affected(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), links, changed, "o_orderkey", "l_partkey")


@query("SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_suppkey = a.l_suppkey AND b.l_returnflag = 'R')")
def near_miss_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return st.near_misses(lines, lines.filter("l_returnflag = 'R'"), ["l_orderkey", "l_suppkey"])


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place, o_totalprice FROM orders")
def score_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", place.alias("place"), "o_totalprice")


_EMAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+"


@query(f"""WITH a AS (SELECT 'd' || doc_id AS id, md5(text) AS h FROM documents),
b AS (SELECT 'd' || min(doc_id) AS id, md5(regexp_replace(text, '{_EMAIL}', '[email]', 'g')) AS h FROM documents GROUP BY text UNION ALL SELECT 'b' || item_id, md5(text) FROM benchmark)
SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.h IS NULL THEN 'ADDED' WHEN b.h IS NULL THEN 'REMOVED' ELSE 'MODIFIED' END AS kind FROM a FULL JOIN b ON a.id = b.id WHERE a.h IS DISTINCT FROM b.h""")
def corpus_diff_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Before: the documents. After: one of each text, addresses taken out, and the benchmark's items.
    d, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    name = lambda kind, c: F.concat(F.lit(kind), c.cast("string")).alias("id")
    redacted = F.md5(F.regexp_replace("text", _EMAIL, "[email]")).alias("h")
    after = d.groupBy("text").agg(F.min("doc_id").alias("doc_id")).select(name("d", F.col("doc_id")), redacted)
    after = after.union(items.select(name("b", F.col("item_id")), F.md5("text")))
    return st.snapshot_diff(d.select(name("d", F.col("doc_id")), F.md5("text").alias("h")), after, "id", "h")


@query("""WITH RECURSIVE t(node, root, level) AS (SELECT event_id, event_id, 0 FROM events WHERE event_id < 7 UNION ALL SELECT e.event_id, root, level + 1 FROM t JOIN events e ON e.event_id > 6 AND e.event_id // 7 = t.node)
SELECT node, root, level FROM t""")
def recursive_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("node"))
    edges = e.filter("node > 6").select("node", F.floor(F.col("node") / 7).alias("parent"))
    return st.tree(edges, e.filter("node < 7"))


_STATES = [*st.TRANSITIONS, *st.FINAL]


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    states = F.array(*map(F.lit, _STATES))
    state = F.element_at(states, (F.get_json_object("props", "$.k").cast("int") % len(_STATES)) + 1)
    h = table(spark, sf_dir, "events").select("user_id", "event_id", state.alias("to_state"))
    return h.withColumn("from_state", F.lag("to_state").over(Window.partitionBy("user_id").orderBy("event_id"))).filter("from_state is not null")


_HISTORY = f"""h AS (SELECT user_id, event_id, [{", ".join(repr(s) for s in _STATES)}][json_extract_string(props, '$.k')::INTEGER % {len(_STATES)} + 1] AS to_state FROM events),
t AS (SELECT *, lag(to_state) OVER (PARTITION BY user_id ORDER BY event_id) AS from_state FROM h)"""
_EDGES = " OR ".join(f"(from_state = '{a}' AND to_state IN ({', '.join(repr(b) for b in ('FAILED', *bs))}))" for a, bs in st.TRANSITIONS.items())


@query(f"WITH {_HISTORY} SELECT user_id, event_id, to_state, from_state FROM t WHERE from_state IS NOT NULL AND NOT ({_EDGES})")
def illegal_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.illegal_transitions(_history(spark, sf_dir))


@query(f"WITH {_HISTORY}, l AS (SELECT user_id, max(event_id) AS event_id, arg_max(to_state, event_id) AS to_state FROM t WHERE from_state IS NOT NULL GROUP BY user_id) SELECT * FROM l WHERE to_state NOT IN ({', '.join(repr(s) for s in st.FINAL)})")
def interrupted_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.interrupted(_history(spark, sf_dir).drop("from_state"), "user_id", "event_id")


_PRED = "length(text) - length(replace(replace(replace(text, '#', ''), '%', ''), '!', '')) <= 0.02 * length(text)"


@query(f"""WITH c AS (SELECT lang, count_if(quality = 1 AND p) AS tp, count_if(quality <> 1 AND p) AS fp, count_if(quality = 1 AND NOT p) AS fn, count_if(quality <> 1 AND NOT p) AS tn
  FROM (SELECT lang, quality, {_PRED} AS p FROM labels JOIN documents USING (doc_id)) GROUP BY lang), m AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS a, coalesce(tp / nullif(tp + fn, 0), 0) AS b FROM c)
SELECT lang, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, floor(a * 1000000 + 0.5)::BIGINT AS precision, floor(b * 1000000 + 0.5)::BIGINT AS recall, floor(coalesce(2 * a * b / nullif(a + b, 0), 0) * 1000000 + 0.5)::BIGINT AS f1 FROM m""")
def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "doc_id")
    clean = F.length("text") - F.length(F.regexp_replace("text", "[#%!]", "")) <= 0.02 * F.length("text")
    out = el.confusion(rows, F.col("quality") == 1, clean, "lang")
    return out.select("lang", "tp", "fp", "fn", "tn", *(ev.quantised(F.col(c)).alias(c) for c in ("precision", "recall", "f1")))


@query(f"""WITH x AS (SELECT doc_id, (quality = 1) = ({_PRED}) AS ok FROM labels JOIN documents USING (doc_id))
SELECT count(*) AS pairs, count_if(a.ok AND b.ok)::BIGINT AS both_right FROM x a JOIN x b ON b.doc_id = a.doc_id + 1""")
def pair_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    clean = F.length("text") - F.length(F.regexp_replace("text", "[#%!]", "")) <= 0.02 * F.length("text")
    x = rows.select("doc_id", ((F.col("quality") == 1) == clean).alias("correct"))
    return el.pair_accuracy(x.withColumn("twin", F.col("doc_id") + 1), x.withColumn("twin", F.col("doc_id")), "twin")


@query(f"""WITH {FINDINGS_SQL}, a AS (SELECT entity, ord AS id, start_ms AS s, end_ms AS e FROM f WHERE severity = 'CRITICAL'), b AS (SELECT entity, start_ms AS rs, end_ms AS re FROM f WHERE severity = 'HIGH')
SELECT id, coalesce(max(CASE WHEN greatest(e, re) > least(s, rs) THEN greatest(least(e, re) - greatest(s, rs), 0) / (greatest(e, re) - least(s, rs)) ELSE 0 END), 0) >= 0.30 AS located FROM a LEFT JOIN b USING (entity) GROUP BY id""")
def span_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings(spark, sf_dir)
    labels = f.filter("severity = 'CRITICAL'").select("entity", F.col("ord").alias("id"), F.col("start_ms").alias("s"), F.col("end_ms").alias("e"))
    return el.located(labels, f.filter("severity = 'HIGH'").select("entity", F.col("start_ms").alias("rs"), F.col("end_ms").alias("re")), "entity")


_OPS = """p AS (SELECT entity, ord AS id, CASE category WHEN 'Language' THEN 'BLEEP' WHEN 'Violence' THEN 'CUT' WHEN 'Metadata' THEN 'MUTE' WHEN 'Substances' THEN 'BLUR_REGION' ELSE 'REPLACE_AUDIO' END AS op, start_ms AS s, end_ms AS e FROM f)"""


@query(f"""WITH {FINDINGS_SQL}, {_OPS} SELECT id, op, CASE WHEN op IN ('MUTE', 'BLEEP', 'REPLACE_AUDIO') THEN greatest(s - 60, 0) ELSE s END AS s,
  CASE WHEN op IN ('MUTE', 'BLEEP', 'REPLACE_AUDIO') THEN least(e + 80, {DURATION_MS}) ELSE e END AS e FROM p""")
def edit_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rm.pad(rm.lower(findings(spark, sf_dir)), DURATION_MS).select("id", "op", "s", "e")


@query(f"""WITH {FINDINGS_SQL}, {_OPS} SELECT id, op FROM p WHERE NOT EXISTS (SELECT 1 FROM p r WHERE r.entity = p.entity AND r.s <= p.s AND r.e >= p.e AND ((r.op = 'CUT' AND p.op <> 'CUT') OR (r.op = 'REPLACE_AUDIO' AND p.op = 'MUTE')))""")
def dominance_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rm.dominance(rm.lower(findings(spark, sf_dir))).select("id", "op")


@query(f"""WITH {FINDINGS_SQL}, {_OPS}, t AS (SELECT *, sum(e - s) OVER (PARTITION BY entity, op) - coalesce(sum(e - s) OVER (PARTITION BY entity, op ORDER BY e - s DESC, s, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining FROM p)
SELECT id, CASE WHEN op = 'CUT' AND remaining > {DURATION_MS} * 0.04 THEN 'MUTE' ELSE op END AS op FROM t""")
def cut_budget_demotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rm.cut_budget(rm.lower(findings(spark, sf_dir)), DURATION_MS, 0.04).select("id", "op")


@query(f"""WITH {FINDINGS_SQL}, {_OPS}, q AS (SELECT *, lag(s) OVER (PARTITION BY entity ORDER BY id ^ 1) AS before FROM (SELECT id, entity, op, s, e FROM p)),
r AS (SELECT id, CASE WHEN e <= s THEN 'not positive' WHEN e - s < 120 THEN 'too short' WHEN s < 0 OR e > {DURATION_MS} THEN 'outside the file' WHEN op = 'BLUR_REGION' AND id % 3 = 0 THEN 'no box'
  WHEN op = 'REPLACE_AUDIO' AND id % 4 = 0 THEN 'no asset' WHEN s < before THEN 'out of order' END AS reason FROM q) SELECT * FROM r WHERE reason IS NOT NULL""".replace("id ^ 1", "xor(id, 1)"))
def edit_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some boxes and assets are taken away, and neighbours in the list swapped."""
    ops = rm.lower(findings(spark, sf_dir))
    ops = ops.withColumn("box", F.when(F.col("id") % 3 != 0, F.array(F.lit(0.1), F.lit(0.1), F.lit(0.5), F.lit(0.5)))).withColumn("asset", F.when(F.col("id") % 4 != 0, "bed.wav"))
    return rm.invalid(ops.withColumn("n", F.col("id").bitwiseXOR(F.lit(1))), DURATION_MS).select("id", "reason")


@query(f"""WITH {FINDINGS_SQL} SELECT entity, least(1.0, sum(CASE WHEN m_ocr > 0 THEN end_ms - start_ms ELSE 0 END) / 60000)::DOUBLE AS ratio, count_if(m_ocr > 0)::BIGINT AS captions,
  count_if(m_ocr > 0) > 0 AS burned_in FROM f GROUP BY entity""")
def caption_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = findings(spark, sf_dir).select("entity", "start_ms", "end_ms", F.when(F.col("modalities")["ocr"] > 0, "burned_in_caption").otherwise("text").alias("role"))
    return sc.caption_coverage(items, 60_000)


@query(f"""WITH {FINDINGS_SQL} SELECT entity, count(*) AS pairs, count_if(k % 5 <> 0)::BIGINT AS before_frames, count_if(k % 3 = 0)::BIGINT AS after_frames, count_if(k % 4 = 0)::BIGINT AS removed,
  count_if(k % 3 <> 0 AND k % 4 <> 0)::BIGINT AS after_unavailable FROM f GROUP BY entity""")
def pair_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = lambda cond: F.when(cond, F.col("ord"))
    k = F.col("k")
    pairs = findings(spark, sf_dir).select("entity", frame(k % 5 != 0).alias("before"), frame(k % 3 == 0).alias("after"), (k % 4 == 0).alias("removed"))
    return sc.pair_summary(pairs, "entity")


@query("""WITH o AS (SELECT item_id, text, [length(text), length(text) - length(replace(text, ' ', '')), item_id % 7 + 1]::DOUBLE[] AS v FROM benchmark WHERE item_id % 5 <> 0),
n AS (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN upper(text) ELSE text END AS text, [length(text), item_id % 4, item_id % 7 + 1]::DOUBLE[] AS v FROM benchmark WHERE item_id % 6 <> 0),
j AS (SELECT item_id, CASE WHEN o.text IS NULL THEN 'ADDED' WHEN n.text IS NULL THEN 'REMOVED' ELSE 'MODIFIED' END AS kind,
  CASE WHEN o.text IS NULL OR n.text IS NULL THEN 1.0 ELSE greatest(0, 1 - list_dot_product(o.v, n.v) / (sqrt(list_dot_product(o.v, o.v)) * sqrt(list_dot_product(n.v, n.v)))) END AS delta
  FROM o FULL JOIN n USING (item_id) WHERE o.text IS DISTINCT FROM n.text)
SELECT item_id, kind, floor(delta * 1000000 + 0.5)::BIGINT AS delta, row_number() OVER (ORDER BY CASE kind WHEN 'ADDED' THEN 0 WHEN 'MODIFIED' THEN 1 ELSE 2 END, delta DESC, item_id)::BIGINT AS n FROM j""")
def clause_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses of two snapshots by kind of change and how far their meaning moved."""
    b, i = table(spark, sf_dir, "benchmark"), F.col("item_id")
    vector = lambda *x: F.array(*(c.cast("double") for c in x)).alias("vector")
    old = b.filter(i % 5 != 0).select("item_id", "text", vector(F.length("text"), F.length("text") - F.length(F.replace("text", F.lit(" "))), i % 7 + 1))
    new = b.filter(i % 6 != 0).select("item_id", F.when(i % 3 == 0, F.upper("text")).otherwise(F.col("text")).alias("text"), vector(F.length("text"), i % 4, i % 7 + 1))
    return st.clause_drift(old, new, "item_id").select("item_id", "kind", ev.quantised(F.col("delta")).alias("delta"), F.col("n").cast("long").alias("n"))


@query(f"""WITH {FINDINGS_SQL}, {_OPS}, x AS (SELECT p.op AS scenario, f.*, bool_or(true) AS hit FROM f JOIN p ON p.entity = f.entity AND p.s - 250 <= f.end_ms AND p.e + 250 >= f.start_ms GROUP BY ALL),
y AS (SELECT *, CASE WHEN scenario IN ('MUTE', 'BLEEP', 'CUT') THEN 0 ELSE m_speech END AS ns, CASE WHEN scenario IN ('BLUR_REGION', 'CUT') THEN 0 ELSE m_vision END AS nv, CASE WHEN scenario IN ('BLUR_REGION', 'CUT') THEN 0 ELSE m_ocr END AS no FROM x),
z AS (SELECT *, ns > 0 OR nv > 0 OR no > 0 OR m_other > 0 AS survives, 1 - (1 - ns) * (1 - 0.85 * nv) * (1 - 0.8 * no) * (1 - 0.5 * m_other) AS whole,
  (ns > 0)::INT + (nv > 0)::INT + (no > 0)::INT + (m_other > 0)::INT AS n, greatest(ns, nv, no, m_other)
  - least(CASE WHEN ns > 0 THEN ns ELSE 9 END, CASE WHEN nv > 0 THEN nv ELSE 9 END, CASE WHEN no > 0 THEN no ELSE 9 END, CASE WHEN m_other > 0 THEN m_other ELSE 9 END) AS gap FROM y),
r AS (SELECT *, CASE WHEN NOT survives THEN NULL WHEN n >= 2 AND gap >= 0.5 THEN 'CONTRADICTION' WHEN ns = 0 AND no = 0 AND m_other = 0 AND whole < 0.70 THEN 'DEMOTE'
  WHEN n >= 2 AND whole >= 0.90 AND severity IN ('MEDIUM', 'HIGH') THEN 'PROMOTE' END AS rule FROM z)
SELECT scenario, ord, survives, rule, CASE WHEN survives THEN floor((CASE WHEN rule = 'CONTRADICTION' THEN whole * 0.75 ELSE whole END) * 1000000 + 0.5)::BIGINT END AS fused,
  CASE WHEN survives THEN CASE WHEN rule = 'DEMOTE' THEN 'LOW' WHEN rule = 'PROMOTE' THEN CASE severity WHEN 'MEDIUM' THEN 'HIGH' ELSE 'CRITICAL' END ELSE severity END END AS severity
FROM r""")
def whatif_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings(spark, sf_dir)
    edits = rm.lower(f).select(F.col("op").alias("scenario"), "entity", "op", F.col("s").alias("rs"), F.col("e").alias("re"))
    return rm.apply_edits(f, edits).select("scenario", "ord", "survives", "rule", ev.quantised(F.col("fused")).alias("fused"), "severity")


@query(f"WITH {FINDINGS_SQL}, {_OPS} SELECT op AS scenario, floor(sum(CASE op WHEN 'BLEEP' THEN 0.15 WHEN 'MUTE' THEN 0.25 WHEN 'REPLACE_AUDIO' THEN 0.10 WHEN 'BLUR_REGION' THEN 0.20 ELSE 0.80 END) * 1000 + 0.5)::BIGINT AS impact FROM p GROUP BY op")
def viewer_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rm.viewer_impact(rm.lower(findings(spark, sf_dir)).withColumn("scenario", F.col("op")))
    return out.select("scenario", ev.quantised(F.col("impact"), 1000).alias("impact"))


@query(f"WITH {FINDINGS_SQL} SELECT entity, clause, arg_min(category, ord) AS name, min(ord) AS first FROM f GROUP BY entity, clause")
def sarif_rules_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit.sarif_rules(findings(spark, sf_dir), "entity").select("entity", "clause", "name", "first")


@query()
def sarif_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit.sarif(findings(spark, sf_dir), "entity")


@query()
def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit.seal(emit.report(findings(spark, sf_dir), "entity", DURATION_MS))
