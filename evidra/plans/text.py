"""Queries: normal forms, dictionary joins and sensitive strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidra.functions import text as tx
from evidra.operators import vocabulary as vo
from evidra.plans.registry import registry
from evidra.sources.logical import WORDS_SQL, table, words

query = registry()

_FORMS_SQL = WORDS_SQL + ", n AS (SELECT *, lower(regexp_replace(w, '[.,!?]', '', 'g')) AS form FROM w)"


def _forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).withColumn("form", F.lower(F.regexp_replace("w", "[.,!?]", "")))


@query(f"""WITH {WORDS_SQL}, p AS (SELECT entity, turn, pos, string_split(translate(translate(lower(w), '{tx.SEPARATORS.replace("'", "''")}', ''), '{tx.LOOKALIKES[0]}', '{tx.LOOKALIKES[1]}'), '') AS c FROM w)
SELECT entity, turn, pos, array_to_string(list_filter(c, lambda x, i: NOT coalesce(i > 2 AND c[i - 1] = x AND c[i - 2] = x, false)), '') AS form FROM p""")
def token_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).select("entity", "turn", "pos", tx.normal_token(F.col("w")).alias("form"))


@query("""SELECT item_id, len(list_filter(regexp_extract_all(lower(text), '[a-z0-9'']+'), lambda t: length(t) > 1 AND t NOT IN ('a', 'an', 'and', 'are', 'as', 'at', 'be', 'by', 'for', 'from',
  'in', 'is', 'it', 'of', 'on', 'or', 'that', 'the', 'there', 'these', 'this', 'to', 'was', 'were', 'will', 'with'))) AS n_tokens FROM benchmark""")
def tokenize_stopwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(tx.tokens(F.col("text"))).cast("long").alias("n_tokens"))


_LEXICON = [("the", "article", "LOW"), ("the", "frequent", "LOW"), ("of", "link", "MEDIUM"), ("der", "article", "LOW"), ("la", "article", "LOW"), ("que", "link", "HIGH")]


@query(f"""WITH {_FORMS_SQL}, l(form, event, severity) AS (VALUES {", ".join(map(str, _LEXICON))})
SELECT entity, turn, event, severity, count(*) AS n FROM n JOIN l USING (form) GROUP BY ALL""")
def lexicon_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = spark.createDataFrame(_LEXICON, "form string, event string, severity string")
    return vo.lexicon_hits(_forms(spark, sf_dir), lexicon).groupBy("entity", "turn", "event", "severity").agg(F.count("*").alias("n"))


_PHRASES = ["of the", "in the", "de la", "to the of", "the the"]


@query(f"""WITH {_FORMS_SQL}, g AS (SELECT entity, turn, pos, form || ' ' || lead(form, 1) OVER o AS two, form || ' ' || lead(form, 1) OVER o || ' ' || lead(form, 2) OVER o AS three FROM n WINDOW o AS (PARTITION BY entity, turn ORDER BY pos)),
u AS (SELECT entity, turn, pos, 2 AS n, two AS phrase FROM g UNION ALL SELECT entity, turn, pos, 3, three FROM g)
SELECT * FROM u WHERE phrase IN ({", ".join(repr(p) for p in _PHRASES)})""")
def phrase_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrases = spark.createDataFrame([(p,) for p in _PHRASES], "phrase string")
    return vo.phrase_hits(_forms(spark, sf_dir), phrases, ["entity", "turn"], [2, 3])


@query(f"""WITH {_FORMS_SQL} SELECT entity, turn, pos, form, coalesce(max((form IN ('that', 'not', 'que'))::INT) OVER b = 1, false) AS cue_before, coalesce(max((form IN ('that', 'not', 'que'))::INT) OVER a = 1, false) AS cue_after,
  max(CASE WHEN form IN ('that', 'not', 'que') THEN pos END) OVER b AS last_cue FROM n
  WINDOW b AS (PARTITION BY entity, turn ORDER BY pos ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY entity, turn ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 14 FOLLOWING)""")
def context_window_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vo.in_context(_forms(spark, sf_dir), ["entity", "turn"], ["that", "not", "que"], 14, 14)


_VERBS, _NEGATIONS, _CUES = ["that", "que", "dass"], ["not", "no", "in"], ["la", "the"]
_MARKERS, _CONDEMNATIONS = ["de la", "in", "to be"], ["it of", "der die", "was the"]


def _first(phrases: list[str], *texts: str) -> str:
    """In SQL the first phrase that stands in one of the texts."""
    return "coalesce(" + ", ".join(f"CASE WHEN contains(' ' || {t} || ' ', ' {p} ') THEN '{p}' END" for t in texts for p in phrases) + ")"


def _around(name: str, low: int, high: int) -> str:
    rows = lambda n: f"{abs(n)} {'PRECEDING' if n < 0 else 'FOLLOWING'}"
    return f"coalesce(array_to_string(list(form) OVER (PARTITION BY entity, turn ORDER BY pos ROWS BETWEEN {rows(low)} AND {rows(high)}), ' '), '') AS {name}"


@query(f"""WITH {_FORMS_SQL}, c AS (SELECT *, max(CASE WHEN form IN {tuple(_VERBS)} THEN pos END) OVER b AS verb, coalesce(max((form IN {tuple(_NEGATIONS)})::INT) OVER l = 1, false) AS negated,
  coalesce(max((form IN {tuple(_CUES)})::INT) OVER b = 1, false) OR coalesce(max((form IN {tuple(_CUES)})::INT) OVER a = 1, false) AS warned,
  {_around("b8", -8, -1)}, {_around("a8", 1, 8)}, {_around("b14", -14, -1)}, {_around("a14", 1, 14)} FROM n
  WINDOW b AS (PARTITION BY entity, turn ORDER BY pos ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY entity, turn ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 14 FOLLOWING),
  l AS (PARTITION BY entity, turn ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)),
d AS (SELECT *, verb IS NOT NULL AND start_ms - (1000 + 400 * verb) <= 2000 AS said, {_first(_MARKERS, "b8", "a8")} AS marker, {_first(_CONDEMNATIONS, "(b14 || ' ' || a14)")} AS condemned_by FROM c)
SELECT entity, turn, pos, form, said OR marker IS NOT NULL AS quoted, negated, warned, condemned_by IS NOT NULL AS condemned, condemned_by,
  CASE WHEN negated OR said OR marker IS NOT NULL THEN 0.65 WHEN form = 'of' THEN 0.93 ELSE 0.95 END::DOUBLE AS confidence FROM d WHERE form IN ('of', 'der')""")
def speech_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of two terms; quotations reach two seconds here, so that some verbs are too far off."""
    c = vo.event_context(_forms(spark, sf_dir), ["entity", "turn"], _VERBS, _NEGATIONS, _CUES, span_ms=2_000, markers=_MARKERS, condemnations=_CONDEMNATIONS).filter(F.col("form").isin("of", "der"))
    source = F.when(F.col("form") == "of", "phrase").otherwise("lexicon")
    return c.select("entity", "turn", "pos", "form", "quoted", "negated", "warned", "condemned", "condemned_by", tx.confidence(source, F.col("quoted"), F.col("negated")).alias("confidence"))


@query(f"""WITH {WORDS_SQL}, s AS (SELECT *, coalesce(max(CASE WHEN regexp_matches(w, '[.?!]$') THEN pos END) OVER (o ROWS BETWEEN 9 PRECEDING AND 1 PRECEDING) + 1, min(pos) OVER (o ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) AS a,
  coalesce(min(CASE WHEN regexp_matches(w, '[.?!]$') THEN pos END) OVER (o ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING), max(pos) OVER (o ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)) AS b FROM w WINDOW o AS (PARTITION BY entity, turn ORDER BY pos))
SELECT s.entity, s.turn, s.pos, string_agg(x.w, ' ' ORDER BY x.pos) AS sentence FROM s JOIN w x ON x.entity = s.entity AND x.turn = s.turn AND x.pos BETWEEN s.a AND s.b WHERE s.pos % 5 = 0 GROUP BY ALL""")
def sentence_around(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence around each fifth word, of at most nine words on either side."""
    return vo.sentence_around(words(spark, sf_dir), ["entity", "turn"], 8).filter(F.col("pos") % 5 == 0).select("entity", "turn", "pos", "sentence")


@query(f"""WITH RECURSIVE w AS (SELECT doc_id, unnest(v) AS w, generate_subscripts(v, 1) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+|[^a-z0-9_\\s]') AS v FROM documents)),
n AS (SELECT *, lead(w, 1) OVER o AS a, lead(w, 2) OVER o AS b, lead(w, 3) OVER o AS c FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT *, CASE WHEN a = 'people' AND b = 'were' THEN c WHEN a = 'people' OR a = 'were' THEN b ELSE a END AS fate FROM n),
h AS (SELECT doc_id, count(*) AS casualties FROM f WHERE (regexp_full_match(w, '[0-9]+') AND fate IN {tx.FATES}) OR (w = 'death' AND a = 'toll') OR w IN {tx.HARM_WORDS} GROUP BY doc_id),
k AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\b[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}\\b')) AS iban FROM documents),
r(doc_id, iban, moved, i, rest) AS (SELECT doc_id, iban, substr(iban, 5) || substr(iban, 1, 4), 1, 0 FROM (SELECT DISTINCT * FROM k) UNION ALL
  SELECT doc_id, iban, moved, i + 1, (CASE WHEN substr(moved, i, 1) BETWEEN '0' AND '9' THEN rest * 10 + substr(moved, i, 1)::INTEGER ELSE rest * 100 + ascii(substr(moved, i, 1)) - 55 END) % 97 FROM r WHERE i <= length(moved)),
v AS (SELECT doc_id, iban, rest = 1 AS valid FROM r WHERE i > length(moved)),
b AS (SELECT doc_id, count(*) AS ibans, count(*) FILTER (WHERE valid) AS valid_ibans FROM k JOIN v USING (doc_id, iban) GROUP BY doc_id)
SELECT doc_id, coalesce(ibans, 0)::BIGINT AS ibans, coalesce(valid_ibans, 0)::BIGINT AS valid_ibans, coalesce(casualties, 0)::BIGINT AS casualties
FROM documents LEFT JOIN b USING (doc_id) LEFT JOIN h USING (doc_id)""")
def iban_casualty_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account numbers, those whose check digits fit, and reports of harm in each document."""
    accounts = F.coalesce(F.regexp_extract_all("text", F.lit(tx.IBAN), F.lit(0)), F.array().cast("array<string>"))
    reports = F.coalesce(F.size(tx.casualty_reports(F.coalesce("text", F.lit("")))), F.lit(0))
    counts = F.size(accounts), F.size(F.filter(accounts, tx.iban_valid)), reports
    return table(spark, sf_dir, "documents").select("doc_id", *(n.cast("long").alias(c) for n, c in zip(counts, ("ibans", "valid_ibans", "casualties"), strict=True)))


@query("SELECT p_partkey, CASE WHEN p_size * 20000 - 100000 <= 0 THEN 90 ELSE greatest(90, least(400, floor((p_size * 20000 - 100000) / 1000 / 2.5))) END::INTEGER AS frames FROM part")
def frame_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", tx.frame_budget(F.col("p_size") * 20_000 - 100_000).alias("frames"))


@query(f"""WITH {WORDS_SQL}, s AS (SELECT *, coalesce(sum(regexp_matches(w, '[.!?]$')::INT) OVER (PARTITION BY entity, turn ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS sentence FROM w)
SELECT entity, turn, sentence, count(*) AS n_words, string_agg(w, ' ' ORDER BY pos) AS text FROM s GROUP BY entity, turn, sentence""")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = vo.sentences(words(spark, sf_dir), ["entity", "turn"])
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "w"))), lambda x: x["w"]), " ")
    return s.groupBy("entity", "turn", "sentence").agg(F.count("*").alias("n_words"), text.alias("text"))


@query("""SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) AS emails, len(regexp_extract_all(text, 'https?://[^\\s<>"'']{4,}')) AS urls FROM documents""")
def email_url_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", count(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}").alias("emails"), count(r"https?://[^\s<>\"']{4,}").alias("urls"))


@query()
def sensitive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "documents").select("doc_id", F.inline(tx.scan(F.col("text"))))
    return hits.groupBy("doc_id", "kind", "label", "redacted").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9][0-9 -]{11,30}[0-9]')) AS v FROM documents), d AS (SELECT doc_id, v, regexp_replace(v, '[^0-9]', '', 'g') AS d FROM c),
x AS (SELECT doc_id, v, d, length(d) - i AS p, substr(d, i::INTEGER, 1)::INTEGER AS n FROM (SELECT *, unnest(generate_series(1, length(d))) AS i FROM d WHERE length(d) BETWEEN 13 AND 19))
SELECT doc_id, d AS digits, sum(CASE WHEN p % 2 = 0 THEN n WHEN n * 2 > 9 THEN n * 2 - 9 ELSE n * 2 END) % 10 = 0 AS valid FROM x GROUP BY doc_id, v, d""")
def luhn_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[0-9][0-9 -]{11,30}[0-9]"), F.lit(0))))
    runs = table(spark, sf_dir, "documents").select("doc_id", found.alias("v")).select("doc_id", tx.digits(F.col("v")).alias("digits"))
    return runs.filter(F.length("digits").between(13, 19)).select("doc_id", "digits", F.call_function("luhn_check", F.col("digits")).alias("valid"))


@query(f"""WITH {WORDS_SQL} SELECT DISTINCT w, CASE WHEN length(w) <= 4 THEN repeat('*', length(w)) ELSE substr(w, 1, 4) || repeat('*', least(length(w) - 4, 12)) END AS redacted FROM w""")
def redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).select("w").distinct().select("w", tx.redact(F.col("w")).alias("redacted"))


@query("""WITH p AS (SELECT p_partkey, p_name, p_brand FROM part) SELECT a.p_partkey AS left_key, b.p_partkey AS right_key, levenshtein(a.p_name, b.p_name) AS edits FROM p a JOIN p b
  ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey WHERE levenshtein(a.p_name, b.p_name) <= 2 OR 1 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name)) >= 0.85""")
def near_duplicate_edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    # Names are compared once each; the rows of alike names are listed as pairs only at the end.
    alike = vo.similar_names(p.withColumnRenamed("p_name", "name"), ["p_brand"]).withColumn("edits", F.levenshtein("a", "b"))
    return vo.listed_pairs(p.select("p_brand", F.col("p_name").alias("name"), F.col("p_partkey").alias("key")), alike, ["p_brand"]).select("left_key", "right_key", "edits")


_VOCABULARY, _SYNONYMS = [("click", 1), ("view", 2), ("sign", 3), ("error", 4)], [("purchase", "buy")]


@query("""SELECT DISTINCT event_type AS raw, CASE event_type WHEN 'purchase' THEN 'buy' WHEN 'signup' THEN 'sign' WHEN 'error' THEN NULL ELSE event_type END AS label FROM events""")
def label_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "events").select(F.col("event_type").alias("raw"))
    return vo.normalise_label(raw, spark.createDataFrame(_VOCABULARY, "label string, salience int"), spark.createDataFrame(_SYNONYMS, "form string, label string"), ["err"])


@query("""SELECT event_id, printf('%02d:%02d:%02d.%03d', event_id * 137 // 3600000, (event_id * 137 // 60000) % 60, (event_id * 137 // 1000) % 60, (event_id * 137) % 1000) AS stamp,
  printf('%02d:%02d.%d', event_id * 137 // 60000, (event_id * 137 // 1000) % 60, (event_id * 137 % 1000) // 100) AS timecode FROM events""")
def time_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.col("event_id") * 137
    return table(spark, sf_dir, "events").select("event_id", tx.stamp(ms).alias("stamp"), tx.timecode(ms).alias("timecode"))


@query("SELECT s_suppkey, sha256('{\"s_name\":\"' || s_name || '\",\"s_suppkey\":' || s_suppkey || '}') AS hash FROM supplier")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", tx.content_hash(F.col("s_name"), F.col("s_suppkey")).alias("hash"))


@query("""WITH t AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS ws FROM conversations), p AS (SELECT *, lag(ws) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM t)
SELECT conv_id, turn, len(list_intersect(ws, prev)) AS shared, len(ws) > 0 AND len(list_intersect(ws, prev)) >= 0.6 * len(ws) AS tracks FROM p WHERE prev IS NOT NULL""")
def tracks_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", ws.alias("ws"))
    t = t.withColumn("prev", F.lag("ws").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("prev is not null")
    shared = F.size(F.array_intersect("ws", "prev"))
    return t.select("conv_id", "turn", shared.cast("long").alias("shared"), ((F.size("ws") > 0) & (shared >= 0.6 * F.size("ws"))).alias("tracks"))
