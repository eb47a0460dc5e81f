"""The timed-evidence tables that the queries run on, from the event, document and conversation tables.

A second of event time stands for a millisecond of an entity's timeline. Each Spark table has its twin in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_MS = 1_704_067_200_000  # 2024-01-01 UTC
DURATION_MS = 2_592_000
CLAUSES = {"view": "AF", "click": "COPY", "error": "META", "purchase": "ACC", "signup": "AUD"}
CATEGORIES = {"view": "Language", "click": "Violence", "error": "Metadata", "purchase": "Substances", "signup": "Sensitive"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, ord, ts_ms, label, confidence"""
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000)
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("entity"), F.col("event_id").alias("ord"), F.floor((ms - BASE_MS) / 1000).cast("long").alias("ts_ms"),
        F.col("event_type").alias("label"), (F.least(F.col("value"), F.lit(100.0)) / 100).alias("confidence"), F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def _case(values: dict, column: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


OBSERVATIONS_SQL = f"""o AS (SELECT user_id AS entity, event_id AS ord, (epoch_us(ts) // 1000 - {BASE_MS}) // 1000 AS ts_ms, event_type AS label,
  least(value, 100.0) / 100 AS confidence, json_extract_string(props, '$.k')::INTEGER AS k FROM events)"""

FINDINGS_SQL = OBSERVATIONS_SQL + f""",
f AS (SELECT entity, ord, ts_ms AS start_ms, ts_ms + (k % 20) * 1000 AS end_ms, {_case(CLAUSES, "label")} || '-0' || (k % 3 + 1) AS clause,
  {_case(CATEGORIES, "label")} AS category, CASE WHEN k < 40 THEN 'LOW' WHEN k < 70 THEN 'MEDIUM' WHEN k < 90 THEN 'HIGH' ELSE 'CRITICAL' END AS severity,
  confidence, CASE WHEN k % 2 = 0 THEN confidence ELSE 0.0 END AS m_speech, CASE WHEN k % 3 = 0 THEN 1 - confidence / 2 ELSE 0.0 END AS m_vision,
  CASE WHEN k % 5 = 0 THEN confidence * 0.8 ELSE 0.0 END AS m_ocr, CASE WHEN k % 7 = 0 THEN 0.5 ELSE 0.0 END AS m_other, k FROM o)"""


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, ord, start_ms, end_ms, clause, category, severity, confidence, modalities, k"""
    o, k, c = observations(spark, sf_dir), F.col("k"), F.col("confidence")
    from evidra.functions.evidence import lookup

    part = lambda n, v: F.when(F.pmod(k, F.lit(n)) == 0, v).otherwise(0.0)
    return o.select(
        "entity", "ord", F.col("ts_ms").alias("start_ms"), (F.col("ts_ms") + F.pmod(k, F.lit(20)) * 1000).alias("end_ms"),
        F.concat(lookup(CLAUSES, F.col("label")), F.lit("-0"), (F.pmod(k, F.lit(3)) + 1).cast("string")).alias("clause"),
        lookup(CATEGORIES, F.col("label")).alias("category"),
        F.when(k < 40, "LOW").when(k < 70, "MEDIUM").when(k < 90, "HIGH").otherwise("CRITICAL").alias("severity"), "confidence",
        F.create_map(F.lit("speech"), part(2, c), F.lit("vision"), part(3, 1 - c / 2), F.lit("ocr"), part(5, c * 0.8), F.lit("other"), part(7, F.lit(0.5))).alias("modalities"), "k",
    )


WORDS_SQL = """w AS (SELECT conv_id AS entity, turn, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos,
  1000 + 400 * (generate_subscripts(ws, 1) - 1) AS start_ms, 1300 + 400 * (generate_subscripts(ws, 1) - 1) AS end_ms
  FROM (SELECT conv_id, turn, regexp_extract_all(text, '[^ \\n]+') AS ws FROM conversations))"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, turn, pos, w, start_ms, end_ms: a word each 400 ms, 300 ms long, the first at 1,000 ms."""
    t = table(spark, sf_dir, "conversations")
    found = F.regexp_extract_all("text", F.lit(r"[^ \n]+"), F.lit(0))
    return t.select(F.col("conv_id").alias("entity"), "turn", F.posexplode(found).alias("pos", "w")).select(
        "*", (1000 + 400 * F.col("pos")).cast("long").alias("start_ms"), (1300 + 400 * F.col("pos")).cast("long").alias("end_ms")
    )
