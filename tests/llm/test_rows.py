"""Quality rules, line dedup, SimHash and mixing against plain Python, on rows with nulls, ties and clashing names."""

import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from evidra.llm import line_dedup, mixing, quality_rules, simhash
from evidra.llm.components import components
from evidra.llm.rows import row_hash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Names that the operators use inside or return.
CLASHES = "row words lines text_ n_words kept rules h k n size copies fp component component_id d g at pos removed source_size target r u v"


def some_texts(seed=3, n=60):
    pick = random.Random(seed)
    vocabulary = ["the", "and", "of", "alpha", "beta", "###", "é", "漢字", "!!"] + [f"w{i}" for i in range(30)]
    line = lambda: " ".join(pick.choice(vocabulary) for _ in range(pick.choice([1, 3, 6, 12, 13, 20])))
    pool = [line() for _ in range(25)]
    texts = []
    for _ in range(n):
        chosen = [pick.choice(pool) for _ in range(pick.randint(1, 6))]
        for k in range(len(chosen)):
            if pick.random() < 0.4:
                w = chosen[k].split()
                i = pick.randrange(len(w))
                chosen[k] = " ".join(pick.choice([w[:i] + w[i + 1 :], [*w[:i], "new", *w[i:]], [*w[:i], "other", *w[i + 1 :]]]))
        texts.append("\n".join(chosen))
    return [*texts, "", " \t ", "\n\n", "x", "so it goes " * 3000, texts[0], texts[0]]


def docs(spark):
    rows = [(i, t, f"s{i % 4}") for i, t in enumerate(some_texts())] + [(5, "tie", None), (5, "tie", None), (None, None, "s1"), (None, "a b c d e f g", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for name in CLASHES.split():
        df = df.withColumn(name, F.lit("clash"))
    return df.repartition(3)


def quality(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = Counter(grams)
    repeated = {i + s for i, g in enumerate(grams) if often[g] > 1 for s in range(5)}
    failed = len(w) < 10 or 100 * len(repeated) > 20 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated), failed)


def test_quality_rules(spark):
    out = quality_rules.quality_counts(docs(spark)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    texts = Counter((r.doc_id, *quality(r.text)) for r in docs(spark).collect())
    assert Counter((r.doc_id, *(r[n] for n in names)) for r in out) == texts
    kept = quality_rules.keep_good(docs(spark))
    assert kept.columns == docs(spark).columns
    assert kept.count() == sum(r.kept for r in out) > 0
    assert quality_rules.quality_counts(docs(spark).limit(0)).count() == 0


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def test_line_dedup(spark):
    rows = [(i, t) for i, t in enumerate(some_texts())] + [(None, some_texts()[3]), (900, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("removed", F.lit(1)).repartition(3)
    earlier, wanted = [], {}
    for doc_id, text in rows[:-2] + [rows[-1], rows[-2]]:
        left = []
        for line in (text or "").split("\n"):
            w = WORD.findall(line)
            near = lambda e, w=w: min(len(w), len(e)) >= line_dedup.NEAR_WORDS and one_edit(w, e)
            same = len(w) >= line_dedup.MIN_WORDS and any(w == e or near(e) for e in earlier)
            if not same:
                left.append(line)
            if len(w) >= line_dedup.MIN_WORDS:
                earlier.append(w)
        wanted[doc_id] = None if text is None else "\n".join(left)
    out = line_dedup.dedup_lines(df)
    assert out.columns == df.columns
    assert {r.doc_id: r.text for r in out.collect()} == wanted
    assert any(w is not None and w != t for (i, t), w in zip(rows, map(wanted.get, dict(rows))))


def test_line_dedup_on_repeated_rows_and_nothing(spark):
    out = line_dedup.dedup_lines(docs(spark))
    assert out.count() == docs(spark).count() and out.columns == docs(spark).columns
    tie = [r.text for r in out.filter("doc_id = 5 and source is null").collect()]
    assert tie == ["tie", "tie"]  # equal rows do not remove each other's lines
    assert line_dedup.dedup_lines(docs(spark).limit(0)).count() == 0


def plain_fingerprint(text):
    w = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    w = WORD.findall(w)
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(fps, bits=3):
    names = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                low, high = sorted((names[i], names[j]))
                names = [low if x == high else x for x in names]
    return names


def test_simhash(spark):
    rows = docs(spark).collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    group = linked(fps)
    least = {g: min((r.doc_id for r, x in zip(rows, group) if x == g and r.doc_id is not None), default=None) for g in group}
    wanted = Counter((r.doc_id, f, least[g]) for r, f, g in zip(rows, fps, group))
    out = simhash.near_duplicates(docs(spark)).collect()
    assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in out) == wanted
    kept = simhash.keep_one(docs(spark))
    assert kept.columns == docs(spark).columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted((v is None, v or 0) for v in least.values())
    assert simhash.near_duplicates(docs(spark).limit(0)).count() == 0


@pytest.mark.parametrize("spread", [0, 1, 2])
def test_links_of_near_fingerprints(spark, spread):
    pick = random.Random(spread)
    fps = [pick.getrandbits(64) for _ in range(30)]
    for _ in range(150):
        f = pick.choice(fps)
        for _ in range(pick.randint(1, 2 + spread)):
            f ^= 1 << pick.randrange(64)
        fps.append(f)
    fps = sorted(set(fps))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    found = {r.node % 2**64: r.component % 2**64 for r in components(simhash.fingerprint_links(df)).collect()}
    names = linked(fps)
    assert len({found.get(f, f) for f in fps}) == len(set(names))
    for f, g in zip(fps, names):
        assert (found.get(f, f) == found.get(fps[g], fps[g])) is True


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")).orderBy(F.xxhash64("u"))
    assert {r.component for r in components(edges).collect()} == {0}
    assert components(edges.limit(0)).count() == 0


def plain_targets(sizes, weights=(5, 2, 1), epochs=1.5):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total, target, open_ = epochs * sum(sizes.values()), {}, set(order)
    while open_:
        share = {s: total * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] >= 2 * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 2 * sizes[s]
            total -= target[s]
            open_.remove(s)
    return target


def test_mixing(spark):
    # One document of 9,000 words would leave its source no copies that come near the target.
    every = docs(spark).filter("text is null or length(text) < 9000")
    rows = every.collect()
    size = [len(WORD.findall(r.text or "")) for r in rows]
    sizes = Counter()
    for r, n in zip(rows, size):
        sizes[r.source] += n
    target = plain_targets(sizes)
    plan = mixing.plan_mix(every.select("doc_id", "source", "text")).collect()
    assert Counter((r.doc_id, r.size) for r in plan) == Counter((r.doc_id, n) for r, n in zip(rows, size))
    taken = Counter()
    for r in plan:
        assert 0 <= r.copies <= 2
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6
        taken[r.source] += r.copies * r.size
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 12, s
    again = mixing.plan_mix(every.repartition(7).select("doc_id", "source", "text")).collect()
    assert Counter(again) == Counter(plan)
    mixed = mixing.mix(every)
    assert mixed.columns == every.columns
    assert sum(len(WORD.findall(r.text or "")) for r in mixed.collect()) == sum(taken.values())
    assert mixing.mix(docs(spark).limit(0)).count() == 0


def test_mixing_with_a_document_of_most_words(spark):
    """Nothing is left out for its size: other sources come near their targets, and this one as near as whole copies allow."""
    every = docs(spark)
    rows = every.collect()
    size = [len(WORD.findall(r.text or "")) for r in rows]
    sizes, longest = Counter(), Counter()
    for r, n in zip(rows, size):
        sizes[r.source] += n
        longest[r.source] = max(longest[r.source], n)
    assert max(longest.values()) == 9000
    plan = mixing.plan_mix(every.select("doc_id", "source", "text")).collect()
    assert Counter((r.doc_id, r.size) for r in plan) == Counter((r.doc_id, n) for r, n in zip(rows, size))
    target, taken = plain_targets(sizes), Counter()
    for r in plan:
        assert 0 <= r.copies <= 2 and abs(r.target - target[r.source]) < 1e-6
        taken[r.source] += r.copies * r.size
    for s in sizes:
        assert abs(taken[s] - target[s]) <= (12 if longest[s] < 9000 else 9000), s
    assert Counter(mixing.plan_mix(every.repartition(5).select("doc_id", "source", "text")).collect()) == Counter(plan)


def test_tilt_meets_the_balance_conditions(spark):
    """At the optimum the odds of a copy are exp(tilt * size / mean), and expected words meet the target."""
    import math

    sizes = spark.createDataFrame([("a", 3, 10), ("a", 50, 4), ("b", 7, 9), ("b", 1, 100)], "source string, size long, n long")
    targets = mixing.source_targets(sizes, (1.0, 4.0), 1.0)
    keyed = sizes.join(targets.select("source", "k"), "source").select("k", "size", "n")
    tilts = {r.source: r for r in mixing.balance(keyed, targets).collect()}
    for s in "ab":
        t = tilts[s]
        rows = [r for r in sizes.collect() if r.source == s]
        mean = sum(r.size * r.n for r in rows) / sum(r.n for r in rows)
        words = sum(r.n * r.size * 2 / (1 + math.exp(-t.tilt * r.size / mean)) for r in rows)
        assert abs(words - t.target) < 1e-6 * t.target


def rows_of_any_kind(spark):
    """Null in either of two columns, a map, nested nulls, and names that need quotes."""
    rows = [
        (1, "a b c d e f g h i j k l", "s", None, "x", {"k": 1}, (None, "y")),
        (1, "a b c d e f g h i j k l", "s", "x", None, {"k": 1}, (None, "y")),
        (1, "a b c d e f g h i j k l", "s", "x", None, {"k": 1}, ("y", None)),
        (1, "a b c d e f g h i j k l", "s", "x", None, {"k": None}, ("y", None)),
        (None, None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, `a.b` string, `c``d e` string, row map<string,int>, struct struct<l:string,r:string>")


def plain_rows(df):
    return Counter(str(r.asDict(recursive=True)) for r in df.collect())


def test_rows_are_told_apart_by_every_column(spark):
    df = rows_of_any_kind(spark)
    assert df.select(row_hash(df).alias("h")).distinct().count() == 5
    twice = mixing.mix(df, epochs=2.0)
    assert twice.columns == df.columns and plain_rows(twice) == Counter({r: n * (1 if "'text': None" in r else 2) for r, n in plain_rows(df).items()})
    kept = line_dedup.dedup_lines(df)
    assert kept.columns == df.columns and sorted(r.text or "" for r in kept.collect()) == ["", "", "", "", "a b c d e f g h i j k l"]
    assert simhash.keep_one(df).count() == 2 and simhash.keep_one(df).columns == df.columns
    assert quality_rules.keep_good(df).columns == df.columns


@pytest.mark.parametrize("limit", [1, 5])
def test_large_blocks_are_split(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "BLOCK", limit)
    test_links_of_near_fingerprints(spark, 1)


def test_pivots_discard_pairs_before_they_are_formed():
    import numpy as np

    fps = np.random.default_rng(2).integers(0, 1 << 20, 3000, np.uint64)
    seen = Counter()
    simhash.block_forest(np.zeros(len(fps), np.int64), fps, 3, seen)
    assert 0 < seen["verified"] < seen["formed"] < len(fps) * (len(fps) - 1) // 2
