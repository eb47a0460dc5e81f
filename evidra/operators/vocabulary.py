"""Dictionary joins on tokens: terms, phrases, contexts and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lexicon_hits(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Tokens that are a form of the lexicon; one row for each of several entries."""
    return tokens.join(lexicon, "form")


def phrase_hits(tokens: DataFrame, phrases: DataFrame, keys: list[str], lengths: list[int]) -> DataFrame:
    """Places where a phrase of one of the given lengths in words stands, words side by side."""
    w = Window.partitionBy(*keys).orderBy("pos")
    grams = [F.struct(F.lit(n).alias("n"), F.concat_ws(" ", *(F.lead("form", k).over(w) if k else F.col("form") for k in range(n))).alias("phrase"), F.lead("form", n - 1).over(w).isNotNull().alias("whole")) for n in lengths]
    each = tokens.select(*keys, "pos", F.array(*grams).alias("grams")).select(*keys, "pos", F.inline("grams")).filter("whole")
    return each.join(phrases, "phrase").select(*keys, "pos", "n", "phrase")


def gap_phrase(words: list[str], gap: int = 2) -> str:
    """A pattern for the words in order with up to ``gap`` others between two of them, over tokens joined by spaces."""
    import re

    return r"\b" + (r"(?: \S+){0,%d} " % gap).join(re.escape(w) for w in words) + r"\b"


def in_context(tokens: DataFrame, keys: list[str], cues: list[str], before: int, after: int) -> DataFrame:
    """Whether a cue stands within so many words, and the nearest one before."""
    w = Window.partitionBy(*keys).orderBy("pos")
    cue = F.col("form").isin(*cues)
    near = F.max(cue.cast("int")).over(w.rowsBetween(-before, -1)), F.max(cue.cast("int")).over(w.rowsBetween(1, after))
    last = F.max(F.when(cue, F.col("pos"))).over(w.rowsBetween(-before, -1))
    flags = [F.coalesce(x == 1, F.lit(False)) for x in near]
    return tokens.select(*keys, "pos", "form", flags[0].alias("cue_before"), flags[1].alias("cue_after"), last.alias("last_cue"))


def first_phrase(phrases: list[str], *texts: Column) -> Column:
    """The first of the phrases that stands in one of the texts, whole words in a row; null if none does."""
    inside = lambda t, p: F.contains(F.concat(F.lit(" "), t, F.lit(" ")), F.lit(f" {p} "))
    found = [F.coalesce(*(F.when(inside(t, p), F.lit(p)) for p in phrases), F.lit(None).cast("string")) for t in texts]
    return F.coalesce(*found)


def event_context(
    tokens: DataFrame, keys: list[str], verbs: list[str], negations: list[str], cues: list[str], reach: int = 14, negated: int = 4, span_ms: int = 20_000,
    markers: list[str] | None = None, condemnations: list[str] | None = None, marked: int = 8,
) -> DataFrame:
    """Each token with whether it is quoted, negated, condemned, or near a warning cue, and by what.

    Quoted: the last reporting verb within ``reach`` words before began at most ``span_ms`` earlier, or one of the
    ``markers``, phrases of any length, stands within ``marked`` words on either side: before it opens a quotation, after
    it closes one. Negated: one of the last ``negated`` words negates. Condemned: one of the phrases ``condemnations``
    stands in the ``reach`` words on both sides, which are read as one. Near a cue: one stands in these.
    """
    w = Window.partitionBy(*keys).orderBy("pos")
    verb = F.max(F.when(F.col("form").isin(*verbs), F.struct("pos", "start_ms", "form"))).over(w.rowsBetween(-reach, -1))
    said = verb.isNotNull() & (F.col("start_ms") - verb["start_ms"] <= span_ms)
    any_ = lambda words, *rows: F.coalesce(F.max(F.col("form").isin(*words)).over(w.rowsBetween(*rows)), F.lit(False))
    text = lambda *rows: F.array_join(F.collect_list("form").over(w.rowsBetween(*rows)), " ")
    near = any_(cues, -reach, -1) | any_(cues, 1, reach)
    none = F.lit(None).cast("string")
    marker = first_phrase(markers, text(-marked, -1), text(1, marked)) if markers else none
    around = F.concat_ws(" ", F.nullif(text(-reach, -1), F.lit("")), F.nullif(text(1, reach), F.lit("")))
    condemned = first_phrase(condemnations, around) if condemnations else none
    return tokens.select(
        "*", (F.coalesce(said, F.lit(False)) | marker.isNotNull()).alias("quoted"), F.coalesce(F.when(said, verb["form"]), marker).alias("quoted_by"),
        any_(negations, -negated, -1).alias("negated"), near.alias("warned"), condemned.isNotNull().alias("condemned"), condemned.alias("condemned_by"),
    )


def sentence_around(tokens: DataFrame, keys: list[str], most: int = 40) -> DataFrame:
    """Each token with the sentence that it stands in: from after the last word that ends one to the next that does.

    It reaches no further than one word over ``most`` on either side. ``tokens(keys, pos, w)``, positions without gaps.
    """
    w = Window.partitionBy(*keys).orderBy("pos")
    ends = F.col("w").rlike("[.?!]$")
    before, after = w.rowsBetween(-most - 1, -1), w.rowsBetween(0, most)
    first = F.coalesce(F.max(F.when(ends, F.col("pos"))).over(before) + 1, F.min("pos").over(w.rowsBetween(-most - 1, 0)))
    last = F.coalesce(F.min(F.when(ends, F.col("pos"))).over(after), F.max("pos").over(w.rowsBetween(0, most + 1)))
    wide = F.collect_list("w").over(w.rowsBetween(-most - 1, most + 1))
    begin = F.min("pos").over(w.rowsBetween(-most - 1, 0))
    found = tokens.select("*", first.alias("_a"), last.alias("_b"), wide.alias("_wide"), begin.alias("_begin"))
    text = F.array_join(F.slice("_wide", (F.col("_a") - F.col("_begin") + 1).cast("int"), (F.col("_b") - F.col("_a") + 1).cast("int")), " ")
    return found.withColumn("sentence", text).drop("_a", "_b", "_wide", "_begin")


def _edits_allowed(n, share: float, least: int):
    return F.greatest(F.lit(least), F.floor(n * share + 1e-9).cast("int"))


def similar_names(names: DataFrame, keys: list[str], share: float = 0.15, least: int = 2) -> DataFrame:
    """Pairs (keys, a, b) of distinct names of one key, a and b alike, within ``least`` edits or ``share`` of the longer.

    The longer name is cut into one part more than it may have edits, so that one part stands in the shorter whole, moved
    by no more than the edits; pairs meet by such parts and are then verified. ``names`` has the column ``name``.
    """
    each = names.select(*keys, "name").distinct()
    start = lambda i, n, k: F.floor(i * n / (k + 1)).cast("int")
    part = lambda n, i, text: F.struct(n.alias("n"), i.alias("i"), text.alias("part"))
    n, k = F.length("name"), _edits_allowed(F.length("name"), share, least)
    parts = F.transform(F.sequence(F.lit(0), k), lambda i: part(n, i, F.substring("name", start(i, n, k) + 1, start(i + 1, n, k) - start(i, n, k))))
    longer = each.select(*keys, F.col("name").alias("b"), F.inline(parts))

    def of_length(m):
        q = _edits_allowed(m, share, least)

        def of_part(i):
            at, size = start(i, m, q), start(i + 1, m, q) - start(i, m, q)
            low, high = F.greatest(at - q, F.lit(0)), F.least(at + q, n - size)
            return F.when(low <= high, F.transform(F.sequence(low, high), lambda s: part(m, i, F.substring("name", s + 1, size)))).otherwise(F.array().cast("array<struct<n:int,i:int,part:string>>"))

        return F.when(m - n <= q, F.flatten(F.transform(F.sequence(F.lit(0), q), of_part))).otherwise(F.array().cast("array<struct<n:int,i:int,part:string>>"))

    most = F.greatest(n + least, F.floor(n / (1 - share)).cast("int"))
    probes = F.array_distinct(F.flatten(F.transform(F.sequence(n, most), of_length)))
    pairs = each.select(*keys, F.col("name").alias("a"), F.inline(probes)).join(longer, [*keys, "n", "i", "part"]).filter("a <> b").select(*keys, "a", "b").distinct()
    allowed = _edits_allowed(F.length("b"), share, least)
    found = pairs.filter(F.levenshtein("a", "b") <= allowed)
    both = found.union(found.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    return both.union(each.select(*keys, F.col("name").alias("a"), F.col("name").alias("b")))


def listed_pairs(rows: DataFrame, alike: DataFrame, keys: list[str], block: int = 1_000, task: int = 20_000_000) -> DataFrame:
    """``left_key``, ``right_key`` (the greater) and ``alike``'s other columns for all rows (keys, name, key) of names alike (keys, a, b).

    ``alike`` has every two names in both orders, of which one is used, and each name with itself.

    The pairs grow with the square of a name's rows, so these are cut into blocks of about ``block``. Pairs of blocks are
    dealt out, in as many partitions as there are ``task`` pairs, and listed there: a task holds two blocks at a time and
    lists its share, however frequent a name is.
    """
    each, alike = rows.filter("key is not null"), alike.filter("a <= b")
    sizes = each.groupBy(*keys, "name").agg(F.count("*").alias("_n"))
    n_blocks = F.ceil(F.col("_n") / block)
    blocks = each.join(sizes, [*keys, "name"]).withColumn("_block", F.pmod(F.xxhash64("key"), n_blocks)).groupBy(*keys, "name", "_block").agg(F.collect_list("key").alias("_rows"))
    of = lambda df, name, as_: df.select(*keys, F.col("name").alias(name), *(F.col(c).alias(f"{as_}{c}") for c in df.columns if c.startswith("_")))
    total = alike.join(of(sizes, "a", "l"), [*keys, "a"]).join(of(sizes, "b", "r"), [*keys, "b"]).agg(F.sum(F.col("l_n") * F.col("r_n"))).first()[0] or 0
    partitions = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // task))
    pairs = alike.join(of(blocks, "a", "l"), [*keys, "a"]).join(of(blocks, "b", "r"), [*keys, "b"]).repartition(partitions, *keys, "a", "b", "l_block", "r_block")
    rest = [c for c in alike.columns if c not in (*keys, "a", "b")]
    x, y = F.col("_x"), F.col("_y")
    both = pairs.select(*rest, (F.col("a") != F.col("b")).alias("_two"), F.explode("l_rows").alias("_x"), "r_rows").select(*rest, "_two", "_x", F.explode("r_rows").alias("_y"))
    return both.filter((x < y) | (F.col("_two") & (x > y))).select(F.least(x, y).alias("left_key"), F.greatest(x, y).alias("right_key"), *rest)


def sentences(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Tokens with the number of their sentence: one ends with the word that carries a full stop, question or exclamation mark."""
    w = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return tokens.withColumn("sentence", F.coalesce(F.sum(F.col("w").rlike("[.!?]$").cast("int")).over(w), F.lit(0)))


def normalise_label(labels: DataFrame, vocabulary: DataFrame, synonyms: DataFrame, blocked: list[str]) -> DataFrame:
    """raw and its canonical label: exact, else by synonym, else the most salient one that it contains; blocked words give none.

    ``vocabulary(label, salience)`` and ``synonyms(form, label)`` are dimensions of fixed size.
    """
    raw = labels.select("raw", F.lower(F.trim("raw")).alias("form")).distinct()
    raw = raw.withColumn("bad", F.lit(False) if not blocked else F.col("form").rlike("|".join(blocked)))
    exact = raw.join(vocabulary.select(F.col("label").alias("form"), F.col("label").alias("exact")), "form", "left")
    named = exact.join(synonyms.select("form", F.col("label").alias("synonym")), "form", "left")
    held = named.filter("not bad and exact is null and synonym is null").join(vocabulary, F.expr("contains(form, label)")).groupBy("raw").agg(
        F.min_by("label", F.struct("salience", -F.length("label"), "label")).alias("held")
    )
    out = named.join(held, "raw", "left")
    return out.select("raw", F.when(~F.col("bad"), F.coalesce("exact", "synonym", "held")).alias("label"))


def maximal_run(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Of overlapping phrase hits (pos, n) those that no longer or earlier hit of the same length contains."""
    w = Window.partitionBy(*keys).orderBy("pos", F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    return hits.withColumn("_end", F.max(F.col("pos") + F.col("n")).over(w)).filter("_end is null or pos + n > _end").drop("_end")
