"""Operator 5: quality rules, one Spark projection compiled from a threshold table.

Every count is a built-in expression over one row; there is no shuffle, no user function and no Python on the
executors. Ratios are compared as integers (``100 * numerator`` against ``limit * denominator``), so the verdict is
the same on every engine.

Defined results
---------------
* null or empty text: all counts 0, ``base_failed`` true, ``kept`` false;
* null doc_id or any other null column: the row is judged by its text like any other;
* repeated rows and ties: each row is judged by itself and stays in the result;
* very long texts: whole; window repeats cost O(n log n) in the words of the text;
* empty table: empty result with the same columns;
* extra columns, whatever their names: ``quality_counts`` leaves them out, ``keep_good`` returns them unchanged.

Windows of five words are compared by 64-bit hashes within one text: for a text of a million words the chance of one
false repeat is below one in ten million.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.llm.rows import packed
from evidra.llm.text import has_word, words

WINDOW = 5

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "not", "of", "on", "or",
    "that", "the", "this", "to", "was", "which", "with",
    "auf", "aus", "das", "dem", "den", "der", "des", "die", "ein", "eine", "für", "ist", "mit", "nicht", "sich",
    "und", "von", "zu",
    "au", "avec", "ce", "dans", "de", "du", "elle", "en", "est", "et", "il", "la", "le", "les", "ou", "par", "pas",
    "pour", "que", "qui", "sur", "un", "une",
    "como", "con", "del", "el", "los", "más", "no", "para", "por", "se", "su", "y", "al",
)

#: (name, numerator, denominator, free, at least or at most, percent): a document fails where
#: 100 * numerator breaks percent * (denominator - free).
RULES = (
    ("mean_word_short", "word_chars", "n_words", 0, ">=", 200),
    ("mean_word_long", "word_chars", "n_words", 0, "<=", 1500),
    ("symbols_per_word", "n_symbols", "n_words", 0, "<=", 10),
    ("stop_words", "n_stop", "n_words", 20, ">=", 3),
    ("duplicate_lines", "n_dup_lines", "n_lines", 0, "<=", 50),
)
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20


def _rule(numerator: str, denominator: str, free: int, op: str, percent: int) -> Column:
    left, right = F.col(numerator) * 100, (F.col(denominator) - free) * percent
    return left >= right if op == ">=" else left <= right


def _counted(df: DataFrame) -> DataFrame:
    """Adds the verdict to ``df(row, text)``; each step is a projection that names what the next one uses twice."""
    df = df.select(
        "row",
        F.coalesce("text", F.lit("")).alias("text"),
        words(F.col("text")).alias("words"),
        F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), has_word).alias("lines"),
    )
    grams = F.transform(
        F.sequence(F.lit(0), F.size("words") - WINDOW),
        lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)]),
    )
    df = df.select(
        "row",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop"),
        F.when(F.size("words") >= WINDOW, grams).alias("grams"),
    )
    counts = [c for c in df.columns if c != "grams"]
    # Sorting by hash brings equal windows together; only texts that have any are sorted.
    repeats = F.size("grams") != F.size(F.array_distinct("grams"))
    df = df.select(
        *counts,
        F.when(repeats, F.sort_array(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("sorted"),
    )
    same = lambda p, j: F.coalesce(F.get("sorted", j)["h"] == p["h"], F.lit(False))
    twin = lambda p, i: same(p, i - 1) | same(p, i + 1)
    starts = F.filter("sorted", twin)
    df = df.select(*counts, F.sort_array(F.transform(starts, lambda p: p["i"])).alias("starts"))
    # Each repeated window covers its words up to the next repeated window's start.
    cover = F.transform("starts", lambda s, i: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", i + 1) - s, F.lit(WINDOW))))
    df = df.select(*counts, F.coalesce(F.aggregate(cover, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    rules = [_rule(*rest).alias(name) for name, *rest in RULES]
    df = df.select("*", failed.alias("base_failed"), F.struct(*rules).alias("rules"))
    good = ~F.col("base_failed")
    for name, *_ in RULES:
        good &= F.col("rules")[name]
    # A generator after the counts keeps Catalyst from repeating them in each filter on its columns.
    return df.select("row", F.inline(F.array(F.struct(*counts[1:], "n_repeat_words", "base_failed", "rules", good.alias("kept")))))


def quality_counts(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, each rule's outcome in ``rules`` and the verdict ``kept`` of every row of ``docs``."""
    out = _counted(docs.select(F.col("doc_id").alias("row"), "text"))
    return out.withColumnRenamed("row", "doc_id")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they were."""
    out = _counted(docs.select(packed(docs).alias("row"), "text"))
    return out.filter("kept").select("row.*")


def counts_sql(table: str = "documents") -> str:
    """The same counts and verdict in DuckDB's SQL, from the same tables of words and limits."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    good = " AND ".join(f"100 * {a} {op} {limit} * ({b} - {free})" for _, a, b, free, op, limit in RULES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM {table}),
w AS (SELECT k, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
      FROM (SELECT k, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d)),
g AS (SELECT k, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o
             || ' ' || lead(w, 4) OVER o AS g FROM w WINDOW o AS (PARTITION BY k ORDER BY i)),
r AS (SELECT k, i FROM (SELECT *, count(*) OVER (PARTITION BY k, g) AS c FROM g WHERE g IS NOT NULL) WHERE c > 1),
c AS (SELECT k, count(DISTINCT i + s) AS n_repeat_words FROM r, range(0, {WINDOW}) AS t(s) GROUP BY k),
n AS (SELECT k, count(*) AS n_words, sum(length(w)) AS word_chars, count(*) FILTER (lower(w) IN ({stop})) AS n_stop
      FROM w GROUP BY k),
l AS (SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
      FROM (SELECT k, unnest(string_split(text, chr(10))) AS l FROM d)
      WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY k),
a AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_stop, 0) AS n_stop
      FROM d LEFT JOIN n USING (k) LEFT JOIN l USING (k) LEFT JOIN c USING (k)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {good} AS kept FROM b"""
