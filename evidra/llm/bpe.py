"""Operator 6: byte-level BPE encoding and decoding on length-bucketed, padded numpy matrices.

Texts are cut into chunks (see ``chunks``) and each distinct chunk into the matches of the pattern; the distinct
matches are laid out as rows of matrices, one matrix for each power-of-two length. In each round every row looks all
its pairs up in a hash table, merges its leftmost pair of least rank and closes the gap, so the matrix loses a column;
rows without a pair in the table leave it. A piece of more than ``LONG`` bytes is a row by itself; there all places of
its least pair are merged in one round, from the left up to the first whose token makes a pair of lesser rank. Spark
deals the rows out, and each task keeps only Arrow batches and a bounded memory of chunks. The vocabulary is a file of fixed size, read by the driver and broadcast.

Defined results
---------------
* null or empty text: no ids, no bytes;
* null doc_id or other null columns: kept as they are;
* repeated rows and ties: each row is encoded by itself;
* very long texts and pieces: whole; a piece takes at most as many rounds as it has bytes, a long one as it has merges;
* special tokens' strings in a text are ordinary text;
* empty table: empty result;
* extra columns, whatever their names, are left out by ``encode``.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from evidra.llm.chunks import ChunkEncoder, slices, spread

NONE = np.int32(2**31 - 1)
#: Multiplier of the pair table's hash: 2**64 divided by the golden ratio, made odd.
SPREAD = np.uint64(11400714819323198485)
#: Bytes from which on a piece is merged by itself.
LONG = 1024


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}


class PairTable:
    """Open-addressed hash table from two adjacent token ids to the id that both merge into."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        keys, values = np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs))
        slots = self._slots(keys)
        while len(keys):
            free = self.keys[slots] < 0
            self.keys[slots[free]] = keys[free]  # of several keys for one slot the last stays
            put = self.keys[slots] == keys
            self.values[slots[put]] = values[put]
            keys, values, slots = keys[~put], values[~put], (slots[~put] + 1) & (1 << self.bits) - 1

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * SPREAD >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged ids, ``NONE`` where there is none; negative ids are padding and merge with nothing."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        out = np.full(keys.shape, NONE, np.int32)
        todo = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        flat, found = keys.ravel(), out.ravel()
        slots = self._slots(flat[todo])
        while len(todo):
            held = self.keys[slots]
            hit = held == flat[todo]
            found[todo[hit]] = self.values[slots[hit]]
            on = ~hit & (held >= 0)
            todo, slots = todo[on], (slots[on] + 1) & (1 << self.bits) - 1
        return found.reshape(keys.shape)


class Codec:
    """Encodes matches of a pattern by a rank file, and decodes ids."""

    def __init__(self, data: bytes, pattern: str):
        self.ranks = read_ranks(data)
        self.pattern = regex.compile(pattern)
        self.pairs = PairTable(self.ranks)
        self.single = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self.single < 0).any():
            raise ValueError("the ranks lack single bytes")
        self.chunks = ChunkEncoder(self._encode_chunks)

    def _encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        numbers: dict[str, int] = {}
        rows, sizes = [], []
        for chunk in chunks:
            found = self.pattern.findall(chunk)
            rows += found
            sizes.append(len(found))
        chosen = np.fromiter((numbers.setdefault(p, len(numbers)) for p in rows), np.int64, len(rows))
        flat, lengths = self.encode_pieces([p.encode() for p in numbers])
        ids, ends = spread(flat, (np.cumsum(lengths) - lengths)[chosen], lengths[chosen])
        return ids, np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])])

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces in order, and the number of each piece's ids."""
        whole = np.fromiter((self.ranks.get(p, -1) for p in pieces), np.int64, len(pieces))
        at = np.flatnonzero(whole >= 0)
        rows, lengths, ids = [at], [np.ones(len(at), np.int64)], [whole[at].astype(np.uint32)]
        rest = np.flatnonzero(whole < 0)
        sizes = np.fromiter((len(pieces[k]) - 1 for k in rest), np.int64, len(rest))
        power = np.frexp(sizes)[1]  # the least power of two that holds the piece
        for k in rest[sizes >= LONG].tolist():
            rows.append(np.array([k]))
            ids.append(self._merge_long(pieces[k]))
            lengths.append(np.array([len(ids[-1])]))
        rest, power = rest[sizes < LONG], power[sizes < LONG]
        for p in np.unique(power):
            members = rest[power == p]
            self._merge([pieces[k] for k in members], members, 1 << int(p), rows, lengths, ids)
        row, size, flat = np.concatenate(rows), np.concatenate(lengths), np.concatenate(ids)
        order = np.argsort(row)
        return spread(flat, (np.cumsum(size) - size)[order], size[order])[0], size[order]

    def _merge_long(self, piece: bytes) -> np.ndarray:
        ids = self.single[np.frombuffer(piece, np.uint8)]
        ranks = self.pairs(ids[:-1], ids[1:])
        while len(ranks) and (least := ranks.min()) != NONE:
            at = np.flatnonzero(ranks == least)
            # Of places side by side, which share a token, each second one is merged, from the left.
            first = np.flatnonzero(np.diff(at, prepend=-2) != 1)
            at = at[(at - np.repeat(at[first], np.diff(first, append=len(at)))) % 2 == 0]
            # A pair of lesser rank that a merge makes comes before the merges to its right.
            padded = np.concatenate([[-1], ids, [-1]])
            before = np.where(np.diff(at, prepend=-3) == 2, least, padded[at])
            token = np.full(len(at), least)
            lesser = np.flatnonzero(np.minimum(self.pairs(before, token), self.pairs(token, padded[at + 3])) < least)
            at = at[: lesser[0] + 1] if len(lesser) else at
            ids[at] = least
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            at -= np.arange(len(at))  # where the merged tokens are after the gaps are closed
            ids, kept = ids[stay], np.ones(len(ranks), bool)
            kept[np.minimum(np.flatnonzero(~stay), len(ranks)) - 1] = False
            ranks = ranks[kept][: len(ids) - 1]
            near = np.unique(np.concatenate([at - 1, at]))
            near = near[(near >= 0) & (near < len(ranks))]
            ranks[near] = self.pairs(ids[near], ids[near + 1])
        return ids.astype(np.uint32)

    def _merge(self, pieces: list[bytes], rows: np.ndarray, width: int, out_rows: list, out_sizes: list, out_ids: list) -> None:
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = np.full((len(pieces), width + 1), -1, np.int32)
        ids[np.arange(width + 1) < lengths[:, None]] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = self.pairs(ids[:, :-1], ids[:, 1:])
        while len(rows):
            best = ranks.argmin(axis=1)  # the leftmost of the least
            done = ranks[np.arange(len(rows)), best] == NONE
            if done.any():
                real = ids[done] >= 0
                out_rows.append(rows[done])
                out_sizes.append(real.sum(axis=1))
                out_ids.append(ids[done][real].astype(np.uint32))
            ids, ranks, rows, best = ids[~done], ranks[~done], rows[~done], best[~done]
            if not len(rows):
                break
            each = np.arange(len(rows))
            ids[each, best] = ranks[each, best]
            stay = np.ones(ids.shape, bool)
            stay[each, best + 1] = False
            ids = ids[stay].reshape(len(rows), -1)
            # The pair after the merged one goes; its neighbours' ranks are looked up again.
            stay = np.ones(ranks.shape, bool)
            stay[each, np.minimum(best + 1, ranks.shape[1] - 1)] = False
            ranks = ranks[stay].reshape(len(rows), -1)
            if not ranks.shape[1]:
                ranks = np.full((len(rows), 1), NONE, np.int32)
                ids = np.concatenate([ids, np.full((len(rows), 1), -1, np.int32)], axis=1)
            last = ranks.shape[1]
            inside = best < last
            at, b = each[inside], best[inside]
            ranks[at, b] = self.pairs(ids[at, b], ids[at, b + 1])
            inside = best > 0
            at, b = each[inside], best[inside]
            ranks[at, b - 1] = self.pairs(ids[at, b - 1], ids[at, b])

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts``, and where each text's ids begin, with their end at last."""
        return self.chunks(texts)


class Decoder:
    """From ids to bytes by a rank file."""

    def __init__(self, data: bytes):
        tokens = dict(sorted((rank, token) for token, rank in read_ranks(data).items()))
        self.lengths = np.zeros(max(tokens) + 1, np.int64)
        self.lengths[list(tokens)] = [len(t) for t in tokens.values()]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens.values()), np.uint8)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ``ids``, and where each id's bytes end."""
        return spread(self.bytes, self.starts[ids], self.lengths[ids])


@functools.lru_cache(1)
def _codec(data: bytes, pattern: str) -> Codec:
    """One codec for all tasks of a Python worker."""
    return Codec(data, pattern)


@functools.lru_cache(1)
def _decoder(data: bytes) -> Decoder:
    return Decoder(data)


def _broadcast(df: DataFrame, path: str):
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, pattern: str, decoded: bool = False) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit) and n_tokens of each row of ``docs``.

    With ``decoded`` also the bytes that the ids decode to, in the same pass and so by the same workers.
    """
    data = _broadcast(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, decoder = _codec(data.value, pattern), _decoder(data.value)
        for batch in (part for batch in batches for part in slices(batch, "text")):
            ids, at = codec.encode(batch.column("text"))
            columns = {"doc_id": batch.column("doc_id"), "ids": cells(ids.astype("<u4"), at), "n_tokens": pa.array(np.diff(at))}
            if decoded:
                flat, ends = decoder.decode(ids)
                columns["decoded"] = cells(flat, np.concatenate([[0], ends])[at])
            yield pa.RecordBatch.from_pydict(columns)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary, n_tokens long" + ", decoded binary" * decoded)


def cells(flat: np.ndarray, at: np.ndarray) -> pa.Array:
    """Slices of ``flat`` as binary cells without a copy; ``at`` has where each begins, with the last one's end."""
    offsets = pa.py_buffer((at * flat.itemsize).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, offsets, pa.py_buffer(np.ascontiguousarray(flat))])


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with its bytes decoded again as ``decoded`` (binary)."""
    data = _broadcast(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(data.value)
        for batch in (part for batch in batches for part in slices(batch, "ids")):
            ids = [np.frombuffer(x or b"", "<u4") for x in batch.column("ids").to_pylist()]
            flat, ends = decoder.decode(np.concatenate([np.empty(0, np.uint32), *ids]))
            out = cells(flat, np.concatenate([[0], ends])[np.cumsum([0, *map(len, ids)])])
            yield pa.RecordBatch.from_arrays([*batch.columns, out], [*batch.schema.names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields if f.name != "decoded")
    return encoded.drop("decoded").mapInArrow(run, f"{fields}, decoded binary")
