import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidra.llm import quality_crf, queries
from evidra.llm.quality_crf import forward_backward

SF = "/root/testdata/sf0.01"


def test_marginals_equal_enumeration():
    pick = np.random.default_rng(2)
    counts = np.array([1, 3, 6, 2, 5])
    e, pairs = pick.normal(size=counts.sum()) * 2, pick.normal(size=(2, 2))
    p, expected, sums = forward_backward(e, counts, pairs)
    total, at = np.zeros((2, 2)), 0
    for k, n in enumerate(counts):
        own, z, good, joint = e[at : at + n], 0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(own[i] * y[i] for i in range(n)) + sum(pairs[a, b] for a, b in zip(y, y[1:])))
            z, good = z + w, good + w * np.array(y)
            for a, b in zip(y, y[1:]):
                joint[a, b] += w
        assert np.allclose(p[at : at + n], good / z) and np.isclose(sums[k], np.log(z))
        total, at = total + joint / z, at + n
    assert np.allclose(expected.sum(axis=0), total)


def test_held_out_accuracy(spark):
    out = queries.op2_quality_crf(spark, SF)
    rows = out.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert out.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert len(rows) > 100 and sum(r.predicted == r.quality for r in rows) >= 0.97 * len(rows)
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) >= 0.99 * len(good) * len(bad)


def test_fold_and_unknown_labels(spark):
    import zlib

    ids = spark.range(200).select(F.col("id").alias("doc_id"), quality_crf.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in ids)


@pytest.mark.parametrize("kinds, wanted", [((), 0.5), ((1,), 1.0), ((0,), 0.0)])
def test_odd_rows(spark, kinds, wanted):
    rows = [(i, t) for i, t in enumerate(["", None, "a b c", "x\n\n\ny", "### !!! ###", "long " * 50000])] + [(2, "a b c"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("quality", F.lit("x"))
    labels = spark.createDataFrame([(i, q) for i in range(6) for q in kinds] + [(3, None), (99, 1), (None, 1)], "doc_id long, quality int")
    field = quality_crf.fit(docs, labels)
    assert field == wanted
    assert quality_crf.score(docs, field).count() == len(rows)
    both = quality_crf.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, quality int"))
    out = quality_crf.score(docs, both).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert len({r.score for r in out if r.doc_id in (0, 1)}) == 1
    assert quality_crf.score(docs.limit(0), both).count() == 0


def test_lines_of_one_document_differ():
    """Documents of both kinds of line, labelled by which prevail: the field tells the lines apart, not only the documents."""
    pick = np.random.default_rng(4)
    good = lambda: "The " + " ".join(pick.choice(["river", "house", "went", "over", "slowly", "and"], 12)) + "."
    bad = lambda: " ".join(pick.choice(["###", "$$ 12", "CLICK", "!!!", "99%", "||"], 8))
    texts, labels, kinds = [], [], []
    for k in range(300):
        label = k % 2
        kind = [int(pick.random() < (0.8 if label else 0.3)) for _ in range(10)]
        texts.append("\n".join(good() if x else bad() for x in kind))
        labels.append(label)
        kinds += kind
    x, lengths, counts = quality_crf.line_features(texts)
    half = 150 * 10
    field = quality_crf.train(x[:half], lengths[:half], counts[:150], np.array(labels[:150]))
    p, *_ = forward_backward(field.emissions(x[half:]), counts[150:], field.pairs)
    kinds, of_bad = np.array(kinds[half:]) == 1, np.repeat(np.array(labels[150:]) == 0, 10)
    assert p[kinds & of_bad].mean() - p[~kinds & of_bad].mean() > 0.5
    assert (quality_crf.score_texts(field, texts[150:]).round() == labels[150:]).mean() > 0.85
