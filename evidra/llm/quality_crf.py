"""Operator 2: document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features (shares of capitals, symbols, marks, digits and spaces, length of words, repeated
words), those of the lines before and after it, and the labels of neighbouring lines decide together: forward-backward
gives each line's marginal probability of good, and the mean of the marginals, weighted by the lines' lengths, is the
document's score. A last logistic map of one variable, fitted with the field, puts the border at 0.5.

The field is trained by gradient steps on a bounded sample of labelled documents: ``sample`` of each label, the least by
hash, and of them no more than ``lines`` lines of each label. Labels of lines are not known: while training, a document's
label is one more node of the field, tied to each of its lines by ``AGREEMENT``, and its likelihood is raised. Lines that
agree with it only because the document's others do leave no trace in the scores of neighbouring labels, so good lines of
a bad document can be told from its bad ones. The driver gets the sample's features, never texts. Scoring, without that
node, is one pass without a shuffle.

Defined results
---------------
* null or empty text: one empty line, scored like any other;
* labels that are null, or of documents that are absent, are not learned from; of several labels of one document the
  larger counts; with one kind of label only every score is that label, without any it is 0.5;
* null doc_id: scored, never learned from; repeated rows: each scored by itself;
* very long texts: scored whole; for training cut into segments of ``SEGMENT`` lines, all of which count, and not
  learned from beyond a sixteenth of ``lines``;
* empty table: empty result; extra columns, whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.llm.chunks import slices

SAMPLE, LINES, SEGMENT, STEPS, RATE, DECAY = 1500, 100_000, 256, 250, 0.05, 1e-3
#: Weight of a line that is as its document is labelled, while training.
AGREEMENT = 2.0


def _class(chars: bytes) -> np.ndarray:
    table = np.zeros(256, np.int64)
    table[list(chars)] = 1
    return table


UPPER = _class(bytes(range(65, 91)))
LETTER = _class(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
CLASSES = (UPPER, LETTER, _class(b"#*$%&|<>"), _class(b"!?"), _class(b"0123456789"), _class(b" \t\x0b\x0c\r"), _class(b".,;:"))
OWN = 11


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line and its neighbours, its length in bytes, and the number of lines of each text."""
    encoded = [(t or "").encode() for t in texts]
    lines = [line for t in encoded for line in t.split(b"\n")]
    counts = np.array([t.count(b"\n") + 1 for t in encoded], np.int64)
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    data = np.frombuffer(b"\n".join(lines) + b"\n", np.uint8)
    starts = np.cumsum(lengths + 1) - lengths - 1
    upper, letter, symbol, mark, digit, space, stop = (np.add.reduceat(c[data], starts) if len(lines) else np.zeros(0) for c in CLASSES)
    found = [line.lower().split() for line in lines]
    n_words = np.fromiter(map(len, found), np.int64, len(found))
    again = np.fromiter((sum(map(eq, w, w[1:])) for w in found), np.int64, len(found))
    kinds = np.fromiter((len(set(w)) for w in found), np.int64, len(found))
    size, n = np.maximum(lengths, 1), np.maximum(n_words, 1)
    own = np.stack([
        np.log1p(lengths), upper / np.maximum(letter, 1), np.sqrt(symbol / size), np.sqrt(mark / size), digit / size, space / size,
        np.log1p((lengths - space) / n), again / n, kinds / n, np.sqrt(stop / size), lengths == 0,
    ], axis=1).astype(np.float64)
    first = np.zeros(len(lines), bool)
    first[np.cumsum(counts) - counts] = True
    last = np.roll(first, -1)
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first], after[last] = 0, 0
    return np.concatenate([own, before, after, first[:, None], last[:, None]], axis=1), lengths, counts


@dataclass
class Field:
    """Emissions ``x @ weights`` for good over bad, scores of the label pairs, and the last map's slope and offset."""

    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray
    pairs: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.deviation @ self.weights[:-1] + self.weights[-1]


def forward_backward(emissions: np.ndarray, counts: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over texts of ``counts`` lines: marginals of good of every line; the expected number of each label pair and the
    logarithm of the sum over all labellings of each text."""
    starts = np.cumsum(counts) - counts
    marginals, expected, sums = np.empty(len(emissions)), np.zeros((len(counts), 2, 2)), np.zeros(len(counts))
    power = np.frexp(np.maximum(counts - 1, 0))[1]
    for p in np.unique(power):
        texts = np.flatnonzero(power == p)
        n, width = counts[texts], int(counts[texts].max())
        at = np.minimum(np.arange(width), n[:, None] - 1) + starts[texts][:, None]
        real = np.arange(width) < n[:, None]
        e = np.zeros((len(texts), width, 2))
        e[:, :, 1] = emissions[at]
        forward, backward = np.empty_like(e), np.zeros_like(e)
        forward[:, 0] = e[:, 0]
        for t in range(1, width):
            forward[:, t] = np.logaddexp(forward[:, t - 1, :1] + pairs[0], forward[:, t - 1, 1:] + pairs[1]) + e[:, t]
        for t in range(width - 2, -1, -1):
            step = e[:, t + 1] + backward[:, t + 1]
            through = np.logaddexp(pairs[:, 0] + step[:, :1], pairs[:, 1] + step[:, 1:])
            backward[:, t] = np.where(real[:, t + 1, None], through, 0)
        total = np.logaddexp.reduce(forward[np.arange(len(texts)), n - 1], axis=1)
        sums[texts] = total
        both = forward + backward - total[:, None, None]
        marginals[at[real]] = np.exp(both[:, :, 1])[real]
        if width > 1:
            joint = forward[:, :-1, :, None] + pairs + (e + backward)[:, 1:, None, :] - total[:, None, None, None]
            expected[texts] = (np.exp(np.minimum(joint, 0)) * real[:, 1:, None, None]).sum(axis=1)
    return np.clip(marginals, 0, 1), expected, sums


def _segments(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Line counts with long texts cut, and the text that each segment is of."""
    parts = -(-counts // SEGMENT)
    text = np.repeat(np.arange(len(counts)), parts)
    k = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
    return np.minimum(SEGMENT, counts[text] - SEGMENT * k), text


def document_scores(marginals: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Means of the marginals weighted by length; an empty line weighs as one byte."""
    starts, weight = np.cumsum(counts) - counts, np.maximum(lengths, 1)
    return np.add.reduceat(marginals * weight, starts) / np.add.reduceat(weight, starts) if len(counts) else np.zeros(0)


def _logistic(scores: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    x, (a, b) = _logit(scores), (1.0, 0.0)
    for _ in range(100):
        p = 1 / (1 + np.exp(-(a * x + b)))
        w, g = p * (1 - p) + 1e-9, labels - p
        h = np.array([[(w * x * x).sum() + 1, (w * x).sum()], [(w * x).sum(), w.sum() + 1]])
        step = np.linalg.solve(h, [(g * x).sum() - (a - 1), g.sum() - b])
        a, b = a + np.clip(step[0], -1, 1), b + np.clip(step[1], -1, 1)
    return max(a, 1e-3), b


def _logit(scores: np.ndarray) -> np.ndarray:
    p = np.clip(scores, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def train(x: np.ndarray, lengths: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> Field:
    """Gradient ascent with momentum and per-weight rates on the mean log likelihood of the documents' labels; both weigh
    the same. By it a step moves expected features from what they are under the wrong label to those under the right one."""
    mean, deviation = x.mean(axis=0), x.std(axis=0)
    field = Field(mean, np.where(deviation > 1e-9, deviation, 1), np.zeros(x.shape[1] + 1), np.zeros((2, 2)))
    segments, text = _segments(counts)
    z = np.concatenate([(x - field.mean) / field.deviation, np.ones((len(x), 1))], axis=1)
    weight = np.where(labels == 1, 0.5 / max(labels.sum(), 1), 0.5 / max((1 - labels).sum(), 1))[text]
    label = labels[text]
    theta = np.zeros(x.shape[1] + 1 + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        field.weights, field.pairs = theta[:-4], theta[-4:].reshape(2, 2)
        gradient = -DECAY * theta
        e = z @ field.weights
        (good, good_pairs, good_sums), (bad, bad_pairs, bad_sums) = (forward_backward(e + a, segments, field.pairs) for a in (AGREEMENT, -AGREEMENT))
        likely = 1 / (1 + np.exp(-np.clip(good_sums - bad_sums - AGREEMENT * segments, -500, 500)))
        scale = weight * (label - likely)
        gradient[:-4] += (np.repeat(scale, segments) * (good - bad)) @ z
        gradient[-4:] += np.tensordot(scale, good_pairs - bad_pairs, 1).ravel()
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        theta = theta + RATE * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    field.weights, field.pairs = theta[:-4], theta[-4:].reshape(2, 2)
    p, *_ = forward_backward(field.emissions(x), counts, field.pairs)
    field.slope, field.offset = _logistic(document_scores(p, lengths, counts), labels)
    return field


def score_texts(field: Field, texts: list[str | None]) -> np.ndarray:
    x, lengths, counts = line_features(texts)
    p, *_ = forward_backward(field.emissions(x), counts, field.pairs)
    return 1 / (1 + np.exp(-(field.slope * _logit(document_scores(p, lengths, counts)) + field.offset)))


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from; null doc_ids are in neither fold and count as held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, lines: int = LINES) -> Field | float:
    """A field from at most ``sample`` documents and ``lines`` lines of each label; without both labels that label, or 0.5."""
    known = labels.filter(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    text = F.coalesce("text", F.lit(""))
    size = docs.select(F.col("doc_id").alias("of"), (F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1).alias("n"))
    known = known.join(size, F.col("doc_id") == F.col("of")).groupBy("doc_id", "quality").agg(F.sum("n").alias("n")).filter(F.col("n") <= lines // 16)
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    first = lambda label: known.filter(F.col("quality") == label).orderBy(*order).limit(sample)
    up_to = Window.partitionBy("quality").orderBy(*order)  # over the sample alone
    chosen = first(0).union(first(1)).withColumn("up_to", F.sum("n").over(up_to)).filter(F.col("up_to") <= lines).select("doc_id", "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for batch in batches for part in slices(batch, "text")):
            x, lengths, counts = line_features(batch.column("text").to_pylist())
            ends = np.cumsum(counts)
            cells = [x[b - n : b].astype(np.float32).tobytes() for b, n in zip(ends, counts, strict=True)]
            sizes = [lengths[b - n : b].astype("<i8").tobytes() for b, n in zip(ends, counts, strict=True)]
            features = {"x": pa.array(cells, pa.binary()), "lengths": pa.array(sizes, pa.binary())}
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("doc_id", "quality")} | features)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen.withColumn("quality", F.col("quality").cast("int")), "doc_id")
    rows = texts.mapInArrow(run, "doc_id long, quality int, x binary, lengths binary").toPandas().sort_values(["doc_id", "x"])
    if rows["quality"].nunique() < 2:
        return float(rows["quality"].iloc[0]) if len(rows) else 0.5
    counts = (rows["lengths"].map(len) // 8).to_numpy(np.int64)
    x = np.frombuffer(b"".join(rows["x"]), np.float32).astype(np.float64).reshape(counts.sum(), -1)
    return train(x, np.frombuffer(b"".join(rows["lengths"]), "<i8"), counts, rows["quality"].to_numpy(np.int64))


def score(docs: DataFrame, field: Field | float) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for batch in batches for part in slices(batch, "text")):
            texts = batch.column("text").to_pylist()
            found = score_texts(field, texts) if isinstance(field, Field) else np.full(len(texts), field)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
