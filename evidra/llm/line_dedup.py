"""Operator 9: lines that repeat an earlier line of the corpus, or all but one word of it, are removed.

A line is its words; white space within and around it doesn't count. Lines are ordered by (doc_id, nulls last; row
hash; number of the line). A line of ``MIN_WORDS`` words or more is removed if an earlier one has the same words, and
one of ``NEAR_WORDS`` or more also if an earlier one of as many is one word edit away (a word replaced, left out or put
in). Both are judged on the input, not on what is left. By default every line that has a word is judged; the bounds are
arguments.

Only DataFrame functions run. Lines are first reduced to distinct ones, of which the earliest counts. The deletion
neighbourhood then works on hashes: a line emits, for each place in it, the key of what is left without the word there
and the key of itself with a gap there; lines that share a key are at most one edit apart, so the earliest line of each
key removes the others once the edit is verified on their words. Before that, lines that share neither half with
another line are set aside: one edit leaves a half as it was, so they have no neighbour.

Keys are 64 bits; lines are the same where 96 bits of hashes are.

Defined results
---------------
* null text stays null, empty text empty; a text whose lines all go becomes empty, its row stays;
* null doc_id: after all others;
* rows equal in every column are one row here: neither removes the other's lines, and both come out alike;
* ties: of equal lines in one document the first stays;
* very long texts and lines: whole; the work for a line is linear in its words;
* empty table: empty result;
* extra columns, whatever their names, are returned unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.llm.rows import packed, row_hash
from evidra.llm.text import words
from evidra.session import materialise

#: From how many words on lines are judged as repeats, and as near repeats: of five words one edit leaves four fifths.
MIN_WORDS, NEAR_WORDS = 1, 5


def _lines(rows: DataFrame, min_words: int) -> DataFrame:
    """absent, doc_id, h, pos and w (words) of the lines of ``rows`` that are judged."""
    numbered = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda line, i: F.struct(i.alias("pos"), words(line).alias("w")))
    long_enough = F.filter(numbered, lambda x: F.size(x["w"]) >= min_words)
    return rows.select(F.col("doc_id").isNull().alias("absent"), "doc_id", "h", F.inline(long_enough))


def _at(df: DataFrame) -> Column:
    return F.struct(*(df[c] for c in ("absent", "doc_id", "h", "pos")))


def _shared(df: DataFrame, keys: str, *line: str) -> DataFrame:
    """The columns ``line`` of the rows of ``df`` that have a key in common with another row."""
    each = df.select(*line, F.explode(keys).alias("shared"))
    common = each.groupBy("shared").agg(F.count("*").alias("n")).filter("n > 1").select("shared")
    return each.join(common, "shared", "left_semi").select(*line).distinct()


def _halves(w: Column) -> Column:
    """Keys of the first and the last half of the words, for neighbours of as many words, one more or one fewer."""
    n = F.size(w)
    sizes = (F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int"))
    sides = (lambda h: F.slice(w, 1, h), lambda h: F.slice(w, n - h + 1, h))
    return F.array_distinct(F.array(*(F.xxhash64(F.lit(k), h, side(h)) for k, side in enumerate(sides) for h in sizes)))


def _candidates(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    """line (a number for it), at and w of the distinct lines that share a half with another line."""
    halves = _shared(firsts.filter(F.size("halves") > 0), "halves", "a", "b")
    wanted = firsts.join(halves, ["a", "b"], "left_semi").groupBy("at.doc_id", "at.h").agg(F.collect_list("at.pos").alias("wanted"))
    wanted = wanted.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), "wanted")
    found = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")))
    split = found.select(F.col("doc_id").isNull().alias("absent"), "doc_id", "h", "wanted", F.split("text", "\n").alias("lines"))
    some = F.transform("wanted", lambda p: F.struct(p.alias("pos"), words(F.get("lines", p)).alias("w")))
    lines = split.select("absent", "doc_id", "h", F.inline(some))
    # Rows equal in every column give the same line; one of them stands for all.
    return lines.select(F.xxhash64("absent", "doc_id", "h", "pos").alias("line"), _at(lines).alias("at"), "w").dropDuplicates(["line"])


def _near(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    """absent, doc_id, h and pos of the distinct lines of ``firsts`` that an earlier one is one word edit away from."""
    lines = materialise(_candidates(rows, firsts), "lines")
    each = lines.select("line", F.size("w").alias("n"), F.posexplode("w").alias("j", "word"))
    line = Window.partitionBy("line").orderBy("j")
    up_to = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left, right = F.xxhash64("word", "j"), F.xxhash64("word", F.col("n") - F.col("j"))
    # Hashes of the words before and after each place: exclusive ors of the words' hashes with their places.
    each = each.select(
        "line", "n", "j", left.alias("x"), right.alias("y"),
        F.bit_xor(left).over(up_to).alias("through"), F.bit_xor(right).over(up_to).alias("gone"), F.bit_xor(right).over(whole).alias("all"),
    )
    before, after, here = F.col("through").bitwiseXOR(F.col("x")), F.col("all").bitwiseXOR(F.col("gone")), F.col("y")
    key = lambda p, s, j: F.struct(F.xxhash64(p, s, j).alias("key"), j.alias("j"))
    keys = F.array(key(before, after, F.col("j")), key(before, after.bitwiseXOR(here), F.col("j")))
    keys = F.when(F.col("j") == F.col("n") - 1, F.concat(keys, F.array(key(F.col("through"), after, F.col("j") + 1)))).otherwise(keys)
    variants = materialise(each.select("line", F.inline(keys)), "variants")
    common = variants.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    variants = variants.join(common, "key", "left_semi").join(lines.select("line", "at"), "line")
    earliest = variants.groupBy("key").agg(F.min(F.struct("at", "line")).alias("first"))
    pairs = variants.join(earliest, "key").filter(F.col("first.at") < F.col("at")).select("line", "j", F.col("first.line").alias("other"))
    # The edit at place j, verified on the words themselves.
    pairs = pairs.join(lines.select("line", "at", "w"), "line").join(lines.select(F.col("line").alias("other"), F.col("w").alias("v")), "other")
    rest = lambda c, k: F.slice(c, F.col("j") + 1 + k, F.greatest(F.size(c) - F.col("j") - k, F.lit(0)))
    head = F.slice("w", 1, F.col("j")) == F.slice("v", 1, F.col("j"))
    d = F.size("w") - F.size("v")
    tail = F.when(d == 0, rest("w", 1) == rest("v", 1)).when(d == 1, rest("w", 1) == rest("v", 0)).when(d == -1, rest("w", 0) == rest("v", 1))
    return materialise(pairs.filter(head & tail).select("at.absent", "at.doc_id", "at.h", "at.pos").distinct(), "near")


def _removed(rows: DataFrame, min_words: int, near_words: int) -> DataFrame:
    """d, g (a row's doc_id and hash) and removed (the numbers of its lines that go)."""
    lines = _lines(rows, min_words)
    halves = F.when(F.size("w") >= near_words, _halves(F.col("w"))).otherwise(F.array().cast("array<bigint>"))
    lines = materialise(lines.select("absent", "doc_id", "h", "pos", F.xxhash64("w").alias("a"), F.hash("w").alias("b"), halves.alias("halves")), "keys")
    firsts = lines.groupBy("a", "b").agg(F.min(_at(lines)).alias("at"), F.first("halves").alias("halves"), F.count("*").alias("n"))
    firsts = materialise(firsts, "firsts")
    again = lines.join(firsts.filter("n > 1").select("a", "b", "at"), ["a", "b"]).filter(_at(lines) != F.col("at")).select("absent", "doc_id", "h", "pos")
    gone = again.union(_near(rows, firsts))
    return gone.groupBy(F.col("doc_id").alias("d"), F.col("h").alias("g")).agg(F.collect_set("pos").alias("removed"))


def _deduped(docs: DataFrame, min_words: int, near_words: int) -> DataFrame:
    """row (all columns of ``docs`` but the text), text without the removed lines, n_lines and n_removed."""
    rows = docs.select(packed(docs, but="text").alias("row"), "doc_id", "text", row_hash(docs).alias("h"))
    out = rows.join(_removed(rows.drop("row"), min_words, near_words), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left")
    out = out.select("row", "text", F.split("text", "\n").alias("lines"), "removed")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "removed")
    text = F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
    count = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return out.select("row", text.alias("text"), F.greatest(count("lines"), F.lit(0).cast("long")).alias("n_lines"), F.greatest(count("removed"), F.lit(0).cast("long")).alias("n_removed"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS) -> DataFrame:
    """``docs`` with its texts without the removed lines; every other column as it was."""
    return _deduped(docs, min_words, near_words).select(*(F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))


def line_counts(docs: DataFrame, min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS) -> DataFrame:
    """doc_id, text without the removed lines, n_lines and n_removed of every row of ``docs``."""
    return _deduped(docs.select("doc_id", "text"), min_words, near_words).select(F.col("row.doc_id").alias("doc_id"), "text", "n_lines", "n_removed")


def counts_sql(table: str = "documents") -> str:
    """The same in DuckDB's SQL: variants are texts there, not hashes. doc_id must be unique."""
    return f"""
WITH l AS (SELECT doc_id, i AS pos, regexp_extract_all(ls[i], '[^\\x20\\x09-\\x0D]+') AS w
           FROM (SELECT doc_id, ls, unnest(generate_series(1, len(ls))) AS i
                 FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM {table}))),
e AS (SELECT doc_id, pos, w, array_to_string(w, ' ') AS s FROM l WHERE len(w) >= {MIN_WORDS}),
c AS (SELECT s, any_value(w) AS w, min(row(doc_id, pos)) AS f FROM e GROUP BY s),
v AS (SELECT s, f, array_to_string(w[1:j], ' ') || chr(1) || array_to_string(w[j + 2:], ' ') AS k
      FROM (SELECT *, unnest(generate_series(0, len(w) - 1)) AS j FROM c WHERE len(w) >= {NEAR_WORDS})
      UNION ALL
      SELECT s, f, array_to_string(w[1:j], ' ') || chr(1) || array_to_string(w[j + 1:], ' ') AS k
      FROM (SELECT *, unnest(generate_series(0, len(w))) AS j FROM c WHERE len(w) >= {NEAR_WORDS})),
m AS (SELECT k, min(f) AS m FROM v GROUP BY k HAVING count(*) > 1),
near AS (SELECT DISTINCT s FROM v JOIN m USING (k) WHERE m < f),
gone AS (SELECT doc_id, pos FROM e JOIN c USING (s) LEFT JOIN near USING (s) WHERE row(e.doc_id, e.pos) <> c.f OR near.s IS NOT NULL),
t AS (SELECT doc_id, list(pos) AS p FROM gone GROUP BY doc_id)
SELECT doc_id, len(string_split(text, chr(10))) AS n_lines, coalesce(len(p), 0) AS n_removed,
       sha256(CASE WHEN p IS NULL THEN text ELSE coalesce((SELECT string_agg(x, chr(10) ORDER BY i) FROM
         (SELECT unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i) WHERE NOT list_contains(p, i)), '') END) AS text_sha256
FROM {table} LEFT JOIN t USING (doc_id)"""
