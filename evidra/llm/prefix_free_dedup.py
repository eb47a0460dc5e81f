"""Operator 7: bytes covered by long strings that also start earlier in the corpus.

Prefix-free parsing. A rolling hash over ``GRAM`` bytes triggers wherever it is least within some window of
``WINDOW``; a phrase runs from one trigger to the end of the next. Triggers depend on the bytes near them alone, so a
string of ``LENGTH`` bytes is parsed alike wherever it stands: the phrase across its byte ``WINDOW`` lies inside it and
stands in every copy of it. Each phrase so stands for the starts of the strings that it lies across, and all of these
strings together for the phrase's context.

The dictionary of distinct phrases and the parse are combined in three steps, each a shuffle of numbers:

1. Phrases meet by their hash (one dictionary entry), and in it by the hash of their context, which is the part of the
   parse's order that ``LENGTH`` bytes can show. Of equal contexts the earliest has the string's first occurrence; all
   strings of the others start earlier. A phrase of a single context needs no more.
2. Where a phrase has several contexts, the earliest of each emits the hashes of its single strings: at the ends of
   repeated passages strings are equal although contexts are not.
3. Equal strings meet by their hashes, and all but the earliest start earlier.

Equal entries are first combined within the rows that a task reads together, so a phrase or string found everywhere
arrives once from each of them. Hashes take the place of the lexicographic order of suffixes: only which strings are
equal is asked for, and the order of all suffixes is many times the size of the corpus. Phrases meet by 48 bits, which
decides only where work is done; contexts of one phrase are the same by 64 bits more, strings by 96.

A phrase that has ``HOT`` contexts in one slice of texts has more than one for sure. Its rows are then dealt out by
their contexts instead of meeting in one place, and one mark for each task tells the phrase's other rows; contexts that
so miss each other are compared string by string. A bucket thus gets at most ``HOT`` rows of a phrase from a slice, and
there are more buckets the more text there is.

Defined results
---------------
* null or empty text, or one shorter than ``LENGTH``: nothing removed;
* null doc_id: after all others; rows that share a doc_id are one document: of two places in it the one of smaller
  start is earlier, whatever the row, and equal starts are not; so repeated rows come out alike;
* very long texts: whole; empty table: empty result;
* extra columns, whatever their names, are left out.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm.chunks import slices
from evidra.session import materialise

LENGTH, GRAM, WINDOW = 100, 12, 44
#: Buckets of phrases or strings for each shuffle partition, and the most bytes of text for each bucket.
BUCKETS, BUCKET_BYTES = 4, 32 << 20
#: Contexts of one phrase in a slice from which on they are dealt out singly.
HOT = 16
#: Bytes of text parsed together.
TOGETHER = 3 << 20
LAST = 2**63 - 1
#: Bits of a phrase's hash that it meets by.
PHRASE_BITS = np.uint64((1 << 48) - 1)
#: What is known of a row: nothing, that it starts later than an equal one, that its phrase has other contexts; and a
#: mark that says so of a phrase's other rows.
UNKNOWN, LATER, OPEN, MARK = range(4)
#: Odd multipliers of the two hashes.
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
PLACE = np.dtype([("key", "<u8"), ("more", "<u8"), ("doc", "<i8"), ("th", "<i8"), ("lo", "<i4"), ("n", "<i4"), ("known", "u1")])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


@functools.lru_cache(4)
def _powers(factor: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of a factor and of its inverse modulo 2**64, and a number for each byte."""
    base = np.full(size + 1, factor, np.uint64)
    back = np.full(size + 1, pow(factor, -1, 1 << 64), np.uint64)
    base[0] = back[0] = 1
    return np.cumprod(base), np.cumprod(back), mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(factor))


class Hashes:
    """Hashes of any slices of ``data``, equal for equal bytes."""

    def __init__(self, data: np.ndarray, factor: int = FACTORS[0]):
        powers, self.back, values = _powers(factor, 1 << (max(len(data), TOGETHER) - 1).bit_length())
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * powers[: len(data)], out=self.sums[1:])

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.back[a] + (b - a).astype(np.uint64))


def _slide(op, x: np.ndarray, width: int) -> np.ndarray:
    """op over x[i : i + width] at each i; the last ``width - 1`` are not."""
    y, span = x.copy(), 1
    while 2 * span <= width:
        y[:-span] = op(y[:-span], y[span:])
        span *= 2
    if width > span:
        y[: span - width] = op(y[: span - width], y[width - span :])
    return y


def triggers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places where the hash of ``GRAM`` bytes is least within a window of ``WINDOW`` places of the same text."""
    size = len(data)
    if size < WINDOW + GRAM:
        return np.empty(0, np.int64)
    factor = np.uint64(FACTORS[1])
    one = data.astype(np.uint64) + np.uint64(1)
    two, four, eight = np.zeros_like(one), np.zeros_like(one), np.zeros_like(one)
    two[:-1] = one[:-1] * factor + one[1:]
    four[:-3] = two[:-3] * factor**2 + two[2:-1]
    eight[:-7] = four[:-7] * factor**4 + four[4:-3]
    eight[: -GRAM + 1] = eight[: -GRAM + 1] * factor**4 + four[8 : size - GRAM + 9]
    grams = ((eight * np.uint64(FACTORS[0])) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    least = _slide(np.minimum, grams, WINDOW)
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        least[max(a, b - WINDOW - GRAM + 2) : b] = 0  # windows that would leave the text
    over = _slide(np.maximum, np.concatenate([np.zeros(WINDOW - 1, np.uint32), least]), WINDOW)[:size]
    return np.flatnonzero(over == grams)


def phrases(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each phrase that strings lie across: its hash, its context's, the number of its text, and the starts lo to hi."""
    at = triggers(data, starts, ends)
    text = np.searchsorted(starts, at, side="right") - 1
    pair = np.flatnonzero(text[1:] == text[:-1]) if len(at) else at
    a, b, text = at[pair], at[pair + 1] if len(pair) else at[pair], text[pair]
    lo, hi = np.maximum(a - WINDOW, starts[text]), np.minimum(b - WINDOW, ends[text] - LENGTH + 1)
    some = hi > lo
    a, b, text, lo, hi = a[some], b[some], text[some], lo[some], hi[some]
    hashes = Hashes(data)
    context = mix(hashes(lo, hi - 1 + LENGTH) ^ ((a - lo).astype(np.uint64) << np.uint64(8)) ^ (hi - lo).astype(np.uint64))
    return hashes(a, b + GRAM) & PHRASE_BITS, context, text, lo, hi


def _texts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of a batch's texts, and where each text begins and ends in them."""
    column = pc.fill_null(batch.column("text"), "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets[:-1] - offsets[0], offsets[1:] - offsets[0]


def _ordered(rows: np.ndarray) -> np.ndarray:
    return rows[np.lexsort((rows["th"], rows["lo"], rows["doc"], rows["more"], rows["key"]))]


def _later(rows: np.ndarray) -> np.ndarray:
    """Of ordered rows, which stand later than the first of their (key, more)."""
    new = np.ones(len(rows), bool)
    new[1:] = (rows["key"][1:] != rows["key"][:-1]) | (rows["more"][1:] != rows["more"][:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))
    return (rows["doc"] > rows["doc"][first]) | (rows["lo"] > rows["lo"][first])


def _dealt(rows: np.ndarray, buckets: int, hot: set[int] | None = None) -> Iterator[pa.RecordBatch]:
    """Rows by bucket, packed: those known to start later by their document, the others by their key.

    ``hot`` collects the keys that had many contexts in a slice of the task; their rows go by key and context.
    """
    rows = _ordered(rows)
    rows["known"] = _later(rows)
    by = rows["key"].copy()
    if hot is not None:
        first = rows[rows["known"] == UNKNOWN]["key"]
        new = np.flatnonzero(np.diff(first, prepend=first[:1] ^ np.uint64(1)))
        many = first[new[np.diff(new, append=len(first)) >= HOT]]
        marks = np.array([k for k in many.tolist() if k not in hot], np.uint64)
        hot.update(marks.tolist())
        of_hot = (rows["known"] == UNKNOWN) & np.isin(rows["key"], np.fromiter(hot, np.uint64, len(hot)))
        rows["known"][of_hot] = OPEN
        by[of_hot] = mix(by[of_hot] ^ rows["more"][of_hot])
        told = np.zeros(len(marks), PLACE)
        told["key"], told["known"] = marks, MARK
        rows, by = np.concatenate([rows, told]), np.concatenate([by, marks])
    away = mix(rows["doc"].astype(np.uint64) ^ (rows["th"].astype(np.uint64) << np.uint64(32)))
    route = np.where(rows["known"] == LATER, away, by) % np.uint64(buckets)
    rows = rows[np.argsort(route, kind="stable")]
    counts = np.bincount(route.astype(np.int64), minlength=buckets)
    ends = np.cumsum(counts)
    full = np.flatnonzero(counts)
    cells = []
    for k in full:
        part = rows[ends[k] - counts[k] : ends[k]]
        cells.append(pa.compress(b"".join(part[c].tobytes() for c in PLACE.names), codec="zstd", asbytes=True))
    yield pa.RecordBatch.from_pydict({"bucket": full, "n": counts[full], "cell": pa.array(cells, pa.binary())})


DEALT = "bucket long, n long, cell binary"
FOUND = "doc long, th long, lo int, n int, open boolean"


def _unpacked(table: pa.Table) -> np.ndarray:
    parts = []
    for n, cell in zip(table.column("n").to_pylist(), table.column("cell"), strict=True):
        data = pa.decompress(cell.as_buffer(), n * PLACE.itemsize, codec="zstd")
        part, at = np.empty(n, PLACE), 0
        for c in PLACE.names:
            kind = PLACE[c]
            part[c] = np.frombuffer(data, kind, n, at)
            at += n * kind.itemsize
        parts.append(part)
    return np.concatenate(parts) if parts else np.empty(0, PLACE)


def _found(rows: np.ndarray, open_: np.ndarray) -> pa.Table:
    return pa.table({c: rows[c] for c in ("doc", "th", "lo", "n")} | {"open": open_})


def _meet(table: pa.Table) -> pa.Table:
    """Starts that are known to be repeats, and (open) those of the first places of contexts whose phrase has others."""
    rows = _unpacked(table)
    known, marks = rows[rows["known"] == LATER], np.unique(rows["key"][rows["known"] >= OPEN])
    rows = rows[(rows["known"] == UNKNOWN) | (rows["known"] == OPEN)]
    key = np.sort(rows["key"])
    rows = _ordered(rows[np.isin(rows["key"], np.concatenate([marks, key[1:][key[1:] == key[:-1]]]))])
    later = _later(rows)
    firsts = rows[~later]
    other = np.isin(firsts["key"], marks)
    change = (firsts["key"][1:] == firsts["key"][:-1]) & (firsts["more"][1:] != firsts["more"][:-1])
    other[1:] |= change
    other[:-1] |= change
    # A phrase of three contexts or more has inner ones with a neighbour on either side, so neighbours tell all.
    out = np.concatenate([known, rows[later], firsts[other]])
    return _found(out, np.repeat([False, True], [len(known) + int(later.sum()), int(other.sum())]))


def _same(table: pa.Table) -> pa.Table:
    """Starts of strings that are not the first of their hash."""
    rows = _unpacked(table)
    known, rows = rows[rows["known"] == LATER], _ordered(rows[rows["known"] == UNKNOWN])
    out = np.concatenate([known, rows[_later(rows)]])
    return _found(out, np.zeros(len(out), bool))


def _spans(cell: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    lo, n = np.array([x["lo"] for x in cell], np.int64), np.array([x["n"] for x in cell], np.int64)
    return lo, lo + n


def merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half-open spans joined where they touch or overlap."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.concatenate([[True], lo[1:] > hi[:-1]])
    return lo[new], hi[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(lo) - 1]])]


def _parse(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    hot: set[int] = set()
    for batch in (part for batch in batches for part in slices(batch, "text", TOGETHER)):
        data, starts, ends = _texts(batch)
        key, more, text, lo, hi = phrases(data, starts, ends)
        rows = np.empty(len(key), PLACE)
        rows["key"], rows["more"], rows["lo"], rows["n"] = key, more, lo - starts[text], hi - lo
        rows["doc"], rows["th"] = batch.column("doc").to_numpy()[text], batch.column("th").to_numpy()[text]
        yield from _dealt(rows, buckets, hot)


def _strings(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """A row for each start that is open."""
    for batch in (part for batch in batches for part in slices(batch, "text", TOGETHER)):
        data, starts, _ = _texts(batch)
        spans = [merged(*_spans(cell)) for cell in batch.column("spans").to_pylist()]
        text = np.repeat(np.arange(len(spans)), [len(lo) for lo, _ in spans])
        lo, hi = (np.concatenate([x[k] for x in spans]) for k in (0, 1))
        n = hi - lo
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        text = np.repeat(text, n)
        rows = np.empty(len(at), PLACE)
        place = at + starts[text]
        rows["key"], rows["lo"], rows["n"] = Hashes(data)(place, place + LENGTH), at, 1
        rows["more"] = Hashes(data, FACTORS[1])(place, place + LENGTH) >> np.uint64(32)
        rows["doc"], rows["th"] = batch.column("doc").to_numpy()[text], batch.column("th").to_numpy()[text]
        yield from _dealt(rows, buckets)


def _lists(found: DataFrame) -> DataFrame:
    return found.groupBy("doc", "th").agg(F.collect_list(F.struct("lo", "n")).alias("spans"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` as doc_id, text and spans, a list of (lo, n): the starts of strings that start earlier."""
    # Several buckets for each partition, so that hashing them to partitions evens out and each stays small.
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(BUCKETS * partitions, size // BUCKET_BYTES)
    tasks = max(partitions, buckets // BUCKETS)
    # Rows are told apart by (doc, th). Few share a doc_id, so 32 bits do there; rows without one have the whole hash.
    th = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.hash("text").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), th.alias("th"), "text")
    texts = rows.select("doc", "th", "text")
    dealt = texts.mapInArrow(lambda batches: _parse(batches, buckets), DEALT)
    places = materialise(dealt.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(_meet, FOUND), "places")
    opened = texts.join(_lists(places.filter("open").distinct()), ["doc", "th"])
    dealt = opened.mapInArrow(lambda batches: _strings(batches, buckets), DEALT)
    strings = materialise(dealt.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(_same, FOUND), "strings")
    spans = _lists(places.filter("not open").union(strings))
    return rows.join(spans, ["doc", "th"], "left").select("doc_id", "text", "spans")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, kept (binary: the bytes that stay), n_bytes, n_removed and n_spans (runs of removed bytes) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for batch in batches for part in slices(batch, "text", TOGETHER)):
            data, starts, ends = _texts(batch)
            kept, removed, runs = [], [], []
            for a, b, cell in zip(starts, ends, batch.column("spans").to_pylist(), strict=True):
                text = data[a:b]
                lo, hi = _spans(cell or [])
                lo, hi = merged(lo, hi - 1 + LENGTH)
                if len(lo):
                    bounds = np.concatenate([[0], np.stack([lo, hi], axis=1).ravel(), [len(text)]])
                    text = np.concatenate([text[i:j] for i, j in zip(bounds[::2], bounds[1::2], strict=True)])
                kept.append(text.tobytes())
                removed.append(int((hi - lo).sum()))
                runs.append(len(lo))
            counts = {"n_bytes": ends - starts, "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(runs, pa.int64())}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "kept": pa.array(kept, pa.binary())} | counts)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return repeated_spans(docs).mapInArrow(run, f"doc_id {kind}, kept binary, n_bytes long, n_removed long, n_spans long")
