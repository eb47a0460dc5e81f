import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from evidra.llm import prefix_free_dedup
from evidra.llm.prefix_free_dedup import LENGTH, merged, phrases, remove_repeats


def texts(seed):
    pick = random.Random(seed)
    word = lambda: "".join(pick.choice("abcdeé ") for _ in range(pick.randint(2, 9)))
    passages = ["".join(word() for _ in range(pick.randint(12, 90))) for _ in range(12)]
    out = []
    for _ in range(45):
        parts = []
        for _ in range(pick.randint(1, 5)):
            p = pick.choice(passages) if pick.random() < 0.5 else "".join(word() for _ in range(pick.randint(1, 60)))
            if pick.random() < 0.4:
                i = pick.randrange(len(p))
                p = p[:i] + pick.choice(["", "X", "YZ"]) + p[i + pick.randint(0, 2) :]
            parts.append(p)
        out.append("".join(parts))
    return [*out, "a" * 777, "ab" * 300, "abc" * 500, "a" * 99, "a" * 100, "", out[0], out[1][:120], out[2][5:], "z" * 99 + out[3]]


def plain(rows):
    """doc_id, bytes, removed, runs and what is kept, by looking every string up."""
    ordered = sorted(((LAST if i is None else i), at, (t or "").encode()[at : at + LENGTH]) for i, t in rows for at in range(len((t or "").encode()) - LENGTH + 1))
    first = {}
    for i, at, s in ordered:
        first.setdefault(s, (i, at))
    out = []
    for i, t in rows:
        data, gone = (t or "").encode(), set()
        for at in range(len(data) - LENGTH + 1):
            if first[data[at : at + LENGTH]] < (LAST if i is None else i, at):
                gone.update(range(at, at + LENGTH))
        runs = sum(k - 1 not in gone for k in gone)
        out.append((i, len(data), len(gone), runs, bytes(b for k, b in enumerate(data) if k not in gone)))
    return Counter(out)


LAST = 2**63 - 1


def test_equal_to_brute_force(spark, monkeypatch):
    for seed in (1, 2):
        rows = [(k, t) for k, t in enumerate(texts(seed))]
        rows += [(7, rows[7][1]), (8, rows[9][1] + "tail"), (None, rows[4][1]), (None, rows[5][1]), (None, None), (500, None)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        for name in ("doc", "th", "spans", "lo", "n", "key"):
            df = df.withColumn(name, F.lit("clash"))
        monkeypatch.setattr(prefix_free_dedup, "TOGETHER", 3000)
        out = remove_repeats(df.repartition(3)).collect()
        found = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out)
        assert found == plain(rows)
        assert sum(r.n_removed for r in out) > 3000


def test_nothing(spark):
    df = spark.createDataFrame([(1, "short"), (2, None)], "doc_id long, text string")
    assert [r.n_removed for r in remove_repeats(df).collect()] == [0, 0]
    assert remove_repeats(df.limit(0)).count() == 0


def test_every_string_has_a_phrase_of_its_own():
    pick = np.random.default_rng(3)
    data = pick.integers(0, 4, 3000).astype(np.uint8)
    starts, ends = np.array([0, 900, 950, 1100]), np.array([900, 950, 1100, 3000])
    _, _, text, lo, hi = phrases(data, starts, ends)
    covered = np.concatenate([np.arange(a, b) for a, b in zip(lo, hi)])
    assert sorted(covered) == [k for a, b in zip(starts, ends) for k in range(a, b - LENGTH + 1)]


def test_merged_spans():
    lo, hi = merged(np.array([5, 0, 8, 30]), np.array([9, 5, 12, 31]))
    assert lo.tolist() == [0, 30] and hi.tolist() == [12, 31]


def test_equal_to_brute_force_where_phrases_are_hot(spark, monkeypatch):
    """A passage in every document has as many contexts at its ends; they are dealt out singly."""
    monkeypatch.setattr(prefix_free_dedup, "TOGETHER", 3000)
    monkeypatch.setattr(prefix_free_dedup, "HOT", 2)
    monkeypatch.setattr(prefix_free_dedup, "BUCKET_BYTES", 2000)
    pick = random.Random(5)
    some = lambda n: "".join(pick.choice("abcdefgh") for _ in range(n))
    passage, long = some(130), some(20_000)
    rows = [(k, some(pick.randint(0, 200)) + passage + some(pick.randint(0, 200))) for k in range(120)]
    rows += [(200, long), (201, "x" + long[:15_000]), (None, passage + long[100:300]), (None, passage + long[100:300])]
    out = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out) == plain(rows)


def test_contexts_of_one_phrase_are_told_apart():
    """100,000 different contexts of each phrase of a passage; with 32 bits about one pair a phrase would be the same."""
    pick = np.random.default_rng(9)
    n, around, passage = 100_000, 60, pick.integers(0, 256, 110).astype(np.uint8)
    found: dict[int, list] = {}
    for _ in range(0, n, 10_000):
        rows = pick.integers(0, 256, (10_000, 110 + 2 * around)).astype(np.uint8)
        rows[:, around : around + 110] = passage
        ends = np.arange(1, 10_001) * rows.shape[1]
        key, more, *_ = phrases(rows.ravel(), ends - rows.shape[1], ends)
        kinds, counts = np.unique(key, return_counts=True)
        for k in kinds[counts > 5000].tolist():
            found.setdefault(k, []).append(more[key == k])
    sizes = [(len(m), len(np.unique(m))) for m in map(np.concatenate, found.values()) if len(np.unique(m)) > n // 2]
    assert len(sizes) >= 2 and all(a == b for a, b in sizes)
