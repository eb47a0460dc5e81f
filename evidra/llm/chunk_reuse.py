"""Operator 12: byte-pair encoding and decoding that reuses content-defined chunks.

A rolling hash over the bytes of a text says where its chunks begin, so documents that share a passage share its chunks.
Each distinct chunk is encoded once with the tokenizers library, and remembered by its worker for later documents (new
chunks also draw on the words that the worker remembers). Chunks
end anywhere, so the ids on both sides of a join may be wrong; each join is repaired: the text around it is encoded
again, from the last piece before the join that its chunk's end can't change, to a little after it. Where that encoding
and the next chunk's have a piece end in common, far enough from the window's end, both agree from there on. Joins
that don't agree are tried again with windows four times as wide, up to the text's end, where they must.

Why that is exact: the pattern cuts pieces from left to right, and what it does at a place depends on the text from
there to ``AHEAD`` bytes after the piece, and on whether a special token's string begins there. A piece that ends
further than that before its chunk's end is thus a piece of the whole text, once any piece end before it is; and the
window begins at such an end. Ids of a piece depend on the piece alone.

Spark deals the rows out; a task holds one slice of a batch, and a worker a bounded memory of chunks and windows.

Defined results
---------------
* null or empty text: no ids, an empty decoded text;
* null doc_id or other null columns: kept as they are;
* repeated rows and ties: each row is encoded by itself;
* very long texts and pieces: whole; a text without chunk places is one chunk, chunks without piece ends are repaired
  by one window over all of them;
* strings of special tokens in a text become their ids, as in the library; they must not overlap one another;
* ids whose bytes aren't UTF-8: decoded with replacement characters, as in the library; unknown ids give no bytes;
* empty table: empty result; extra columns, whatever their names, are left out by ``encode``.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from evidra.llm.bpe import cells
from evidra.llm.chunks import slices, spread
from evidra.llm.library_bpe import STOP, LibraryEncoder, open_tokenizer, token_table

#: A chunk begins after each window of 2**WINDOW bytes whose hash has BITS leading zeros, at least LEAST bytes after the last.
WINDOW, BITS, LEAST = 4, 9, 64
#: Multiplier of the rolling hash, and the seed of its byte values.
BASE, SEED = 2654435761, 12
#: Bytes that the pattern may read after a piece: two characters of at most four bytes, and as much to spare.
AHEAD = 16
#: Bytes after a join that its first window has besides those that can't be trusted.
FIRST = 48
#: Ids that a worker remembers, with their strings; beyond them the least used half is forgotten. Bounds memory only.
REMEMBERED = 8_000_000


def _values() -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 32, 256, np.uint32)


def chunk_starts(data: np.ndarray, bounds: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Where chunks begin in texts that lie one after another in ``data``; text k is from ``bounds[k]`` to ``bounds[k + 1]``."""
    rolling = values[data]
    for k in range(WINDOW):  # each step doubles the bytes that a hash is of
        span = 1 << k
        rolling[span:] = rolling[span:] + rolling[:-span] * np.uint32(pow(BASE, span, 1 << 32))
    places = np.flatnonzero(rolling >> np.uint32(32 - BITS) == 0) + 1
    places = places[places < len(data)]
    places = places[data[places] & 0xC0 != 0x80]  # at a character's beginning
    texts = np.unique(bounds[:-1][np.diff(bounds) > 0])
    found, ends = [], np.append(texts[1:], len(data)).tolist()
    for at, end in zip(texts.tolist(), ends, strict=True):
        found.append(at)
        k = int(np.searchsorted(places, at + LEAST))
        while k < len(places) and places[k] < end:
            at = int(places[k])
            found.append(at)
            k = int(np.searchsorted(places, at + LEAST))
    return np.array(found, np.int64)


class Memory:
    """Sequences of numbers for strings, each computed once for as long as it is remembered."""

    def __init__(self, encode, remembered: int = REMEMBERED):
        self.encode, self.remembered = encode, remembered
        self.known: dict[str, int] = {}
        self.flat, self.lengths, self.uses = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def trim(self) -> None:
        if len(self.flat) <= self.remembered:
            return
        least = np.median(self.uses)
        kept = [(s, k) for s, k in self.known.items() if self.uses[k] > least]
        keep = np.fromiter((k for _, k in kept), np.int64, len(kept))
        self.known = {s: k for k, (s, _) in enumerate(kept)}
        self.flat, _ = spread(self.flat, (np.cumsum(self.lengths) - self.lengths)[keep], self.lengths[keep])
        self.lengths, self.uses = self.lengths[keep], self.uses[keep] // 2

    def __call__(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All sequences one after another, and the length of each."""
        coded = strings.dictionary_encode()
        distinct, of = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        number = np.fromiter((self.known.get(s, -1) for s in distinct), np.int64, len(distinct))
        new = np.flatnonzero(number < 0)
        if len(new):
            number[new] = np.arange(len(new)) + len(self.lengths)
            fresh = [distinct[k] for k in new.tolist()]
            self.known |= zip(fresh, number[new].tolist(), strict=True)
            flat, lengths = self.encode(fresh)
            self.flat, self.lengths = np.concatenate([self.flat, flat]), np.concatenate([self.lengths, lengths])
            self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])
        chosen = number[of]
        self.uses += np.bincount(chosen, minlength=len(self.uses))
        lengths = self.lengths[chosen]
        return spread(self.flat, (np.cumsum(self.lengths) - self.lengths)[chosen], lengths)[0], lengths


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    flat, at = spread(data, starts, ends - starts)
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(np.concatenate([[0], at])), pa.py_buffer(flat)])


class ReusingEncoder:
    """A byte-level tokenizer file's ids of whole texts, from the ids of their chunks."""

    def __init__(self, data: bytes, remembered: int = REMEMBERED):
        self.library, self.values = LibraryEncoder(data, stops=True), _values()
        self.token_bytes = self.library.token_bytes
        special = [len(t.content.encode()) for t in self.library.tokenizer.get_added_tokens_decoder().values()]
        self.guard = AHEAD + max(special, default=0)
        self.memory = Memory(self._encode, remembered)

    def _encode(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids with ``STOP`` set on each piece's last, and their number for each string."""
        entries, at = self.library.encode(strings)
        return entries, np.diff(at)

    def _ends(self, entries: np.ndarray) -> np.ndarray:
        """Where each entry's bytes end, counted from the first one's beginning."""
        return np.cumsum(self.token_bytes[entries & ~STOP])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts``, and where each text's ids begin, with their end at last."""
        self.memory.trim()
        column = pc.fill_null(texts, "").cast(pa.large_string())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        if not len(column) or offsets[-1] == offsets[0]:
            return np.empty(0, np.uint32), np.zeros(len(column) + 1, np.int64)
        data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        bounds = offsets - offsets[0]
        starts = chunk_starts(data, bounds, self.values)
        stops = np.append(starts[1:], len(data))
        entries, sizes = self.memory(_strings(data, starts, stops))
        ends = self._ends(entries)
        # Piece ends that are the whole text's, once one before them in their chunk is.
        last = np.isin(stops, bounds)  # chunks at whose end the text ends
        trusted = np.where(last, stops, stops - self.guard)
        sure = ends[((entries & STOP) != 0) & (ends <= np.repeat(trusted, sizes))]
        joins = starts[1:][~last[:-1]]
        texts_of = np.searchsorted(bounds, joins, side="right") - 1
        begin, end = bounds[texts_of], bounds[texts_of + 1]
        before = np.searchsorted(sure, joins, side="right")
        left = np.maximum(begin, np.where(before > 0, sure[before - 1], 0))
        # Chunks without a sure end of their own are repaired together with the join before them.
        alone = np.append(left[1:] != left[:-1], True)[: len(joins)]
        joins, left, end = joins[alone], left[alone], end[alone]
        agreed, fixed = self._repair(data, sure, joins, left, end)
        ids = self._assemble(entries, ends, left, agreed, joins, fixed)
        at = np.searchsorted(np.cumsum(self.token_bytes[ids]), bounds, side="right")
        at[0] = 0
        return ids, at

    def _repair(self, data: np.ndarray, sure: np.ndarray, joins: np.ndarray, left: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Where each join's window agrees with the chunks after it, and the ids from ``left`` to there."""
        agreed, fixed = np.full(len(joins), -1), [np.empty(0, np.uint32)] * len(joins)
        todo, width = np.arange(len(joins)), self.guard + FIRST
        while len(todo):
            right = np.minimum(joins[todo] + width, end[todo])
            inside = right < end[todo]
            while (split := inside & (data[np.minimum(right, len(data) - 1)] & 0xC0 == 0x80)).any():
                right[split] -= 1  # to a character's beginning
            entries, sizes = self.memory(_strings(data, left[todo], right))
            firsts = np.cumsum(sizes) - sizes
            ends = self._ends(entries)
            ends += np.repeat(left[todo] - np.where(firsts > 0, ends[firsts - 1], 0), sizes)
            limit = np.where(inside, right - self.guard, right)
            good = ((entries & STOP) != 0) & (ends >= np.repeat(joins[todo], sizes)) & (ends <= np.repeat(limit, sizes))
            at = np.flatnonzero(good)
            k = np.searchsorted(sure, ends[at])
            at = at[sure[np.minimum(k, len(sure) - 1)] == ends[at]]
            of = np.repeat(np.arange(len(todo)), sizes)[at]
            of, first = np.unique(of, return_index=True)
            for j, i in zip(of.tolist(), at[first].tolist(), strict=True):
                agreed[todo[j]] = ends[i]
                fixed[todo[j]] = entries[firsts[j] : i + 1] & ~STOP
            # A join that an earlier window went past needs no window of its own.
            passed = np.maximum.accumulate(np.concatenate([[-1], agreed[:-1]])) >= joins if len(joins) else joins
            todo = todo[(agreed[todo] < 0) & ~passed[todo]]
            width *= 4
        return agreed, fixed

    def _assemble(self, entries: np.ndarray, ends: np.ndarray, left: np.ndarray, agreed: np.ndarray, joins: np.ndarray, fixed: list[np.ndarray]) -> np.ndarray:
        kept, reached = [], -1
        for k, (join, to) in enumerate(zip(joins.tolist(), agreed.tolist(), strict=True)):
            if join > reached:
                kept.append(k)
                reached = to
        a, b = np.searchsorted(ends, left[kept], side="right"), np.searchsorted(ends, agreed[kept], side="right")
        parts, at = [], 0
        for k, x, y in zip(kept, a.tolist(), b.tolist(), strict=True):
            parts += [entries[at:x] & ~STOP, fixed[k]]
            at = y
        return np.concatenate([*parts, entries[at:] & ~STOP])


class LibraryDecoder:
    """From ids to bytes, as the library decodes a byte-level tokenizer's ids with special tokens kept."""

    def __init__(self, data: bytes):
        tokens = token_table(open_tokenizer(data))
        self.lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray, at: np.ndarray) -> pa.Array:
        """The text of each run of ids; ``at`` has where each begins, with the last one's end."""
        ids = ids[ids < len(self.lengths)] if (ids >= len(self.lengths)).any() else ids
        flat, ends = spread(self.bytes, self.starts[ids], self.lengths[ids])
        raw = cells(flat, np.concatenate([[0], ends])[at])
        try:
            return raw.cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())


@functools.lru_cache(1)
def _encoder(data: bytes) -> ReusingEncoder:
    """One encoder for all tasks of a Python worker."""
    return ReusingEncoder(data)


@functools.lru_cache(1)
def _decoder(data: bytes) -> LibraryDecoder:
    return LibraryDecoder(data)


def _broadcast(df: DataFrame, path: str):
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, decoded: bool = False) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit) and n_tokens of each row of ``docs``.

    With ``decoded`` also the text that the ids decode to, in the same pass and so by the same workers.
    """
    data = _broadcast(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _encoder(data.value), _decoder(data.value)
        for batch in (part for batch in batches for part in slices(batch, "text")):
            ids, at = encoder.encode(batch.column("text"))
            columns = {"doc_id": batch.column("doc_id"), "ids": cells(ids.astype("<u4"), at), "n_tokens": pa.array(np.diff(at))}
            if decoded:
                columns["decoded"] = decoder.decode(ids, at)
            yield pa.RecordBatch.from_pydict(columns)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary, n_tokens long" + ", decoded string" * decoded)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with the text of its ids as ``decoded``; null ids have an empty text."""
    data = _broadcast(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(data.value)
        for batch in (part for batch in batches for part in slices(batch, "ids")):
            ids = [np.frombuffer(x or b"", "<u4") for x in batch.column("ids").to_pylist()]
            known = [x[x < len(decoder.lengths)] for x in ids]
            out = decoder.decode(np.concatenate([np.empty(0, np.uint32), *known]), np.cumsum([0, *map(len, known)]))
            yield pa.RecordBatch.from_arrays([*batch.columns, out], [*batch.schema.names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields if f.name != "decoded")
    return encoded.drop("decoded").mapInArrow(run, f"{fields}, decoded string")
