"""Operator 13: alignment of two tokenizers' ids, and how often ids are aligned over the whole corpus.

A byte-level tokenizer (A) and a piece tokenizer (B) cut the same bytes, a space and the text, into tokens. Places where a
token of each ends cut both sequences into groups; the two tokens that end there are a link. ``align`` gives each
document's groups and links, packed as ``B id << 32 | A id`` in 64 bits. ``count_links`` counts the links of all
documents: each partition counts its own by ``np.unique``, the counts are sorted by ranges of keys over the whole
cluster, and each range's runs of equal keys are summed and written as one shard of sorted keys and counts. ``look_up``
maps shards into memory and finds keys by binary search, so no task holds more of them than it touches.

Both tokenizers work on chunks of texts that are cut before single spaces, where neither has a token across the cut
(see ``chunks``; B's vocabulary has no piece with a space after another character, which is checked), so frequent chunks
are encoded once a worker. A key has one row for each partition that counted it, whatever its links' number.

Defined results
---------------
* null or empty text, and texts whose bytes B's tokens don't give back (such as those with its own space sign): no
  tokens, zeros and an empty string; such texts count for no pair;
* null doc_id: kept; repeated rows: each counts by itself;
* ties: all pairs that share their B id's highest count are best;
* very long texts: whole; empty table: no shard, an empty result;
* extra columns, whatever their names, are left out; strings of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame
from sentencepiece import SentencePieceProcessor

from evidra.llm.bpe import cells
from evidra.llm.chunks import ChunkEncoder, slices, spread
from evidra.llm.library_bpe import LibraryEncoder
from evidra.session import materialise, shared_path

#: Bytes of text that are aligned together, keys that a partition counts before it merges them, and rows of a batch that it returns.
SLICE, MERGE, ROWS = 1 << 20, 1_000_000, 200_000
#: Bytes of links that are counted or looked up together.
LINKS = 4 << 20
#: Chunks that a worker remembers, with both tokenizers' ids.
REMEMBERED = 300_000
#: The bit that tells B's ids from A's in what is remembered of a chunk.
OF_B = np.uint32(1 << 31)
SPACE_SIGN = "▁"


class PieceEncoder:
    """A sentencepiece model's ids for strings that begin with a space, which is the one that the model adds."""

    def __init__(self, data: bytes):
        self.model = SentencePieceProcessor(model_proto=data)
        pieces = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        if any(SPACE_SIGN in p.lstrip(SPACE_SIGN) for p in pieces):
            raise ValueError("a piece goes on after a space, so texts can't be cut before spaces")
        self.space = self.model.piece_to_id(SPACE_SIGN)
        self.tokens = [bytes([int(p[3:-1], 16)]) if self.model.is_byte(k) else p.replace(SPACE_SIGN, " ").encode() for k, p in enumerate(pieces)]

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the chunks in order, and the number of each chunk's ids."""
        # The model makes nothing of an empty text, which a space alone is without the one that it adds.
        found = [x or [self.space] * len(c) for x, c in zip(self.model.encode([c[1:] for c in chunks], num_threads=1), chunks, strict=True)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((k for x in found for k in x), np.uint32, int(lengths.sum())), lengths


class Table:
    """Byte strings by id: of tokens, or of the ids' own decimal digits."""

    def __init__(self, entries: list[bytes]):
        self.lengths = np.fromiter(map(len, entries), np.int64, len(entries))
        self.starts, self.bytes = np.cumsum(self.lengths) - self.lengths, np.frombuffer(b"".join(entries), np.uint8)

    def of(self, ids: np.ndarray) -> np.ndarray:
        return spread(self.bytes, self.starts[ids], self.lengths[ids])[0]


class Aligned(NamedTuple):
    """Of texts one after another: tokens, groups and links of each, all links' keys, and each text's groups as a string."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_links: np.ndarray
    links: np.ndarray
    groups: list[bytes]


class Aligner:
    def __init__(self, a: bytes, b: bytes):
        self.a, self.b = LibraryEncoder(a, plain=True), PieceEncoder(b)
        self.chunks = ChunkEncoder(self._encode, REMEMBERED)
        self.a_bytes, self.b_bytes = Table(self.a.tokens), Table(self.b.tokens)
        # Digits with room for the sign after them.
        self.digits = Table([b"%d," % k for k in range(max(len(self.a.tokens), len(self.b.tokens)))])

    def _encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of each chunk A's ids and then B's."""
        (a, n_a), (b, n_b) = self.a.encode_chunks(chunks), self.b.encode_chunks(chunks)
        flat = np.empty(len(a) + len(b), np.uint32)
        of_b = np.repeat(np.tile([False, True], len(chunks)), np.stack([n_a, n_b], axis=1).ravel())
        flat[~of_b], flat[of_b] = a, b | OF_B
        return flat, n_a + n_b

    def __call__(self, texts: pa.Array) -> Aligned:
        full = pc.fill_null(texts, "")
        spaced = pc.if_else(pc.equal(full, ""), "", pc.binary_join_element_wise(pa.scalar(" "), full, ""))
        both, at = self.chunks(spaced)
        of_b = both & OF_B != 0
        a, b = both[~of_b], both[of_b] & ~OF_B
        b_at = np.concatenate([[0], np.cumsum(of_b)])[at]
        a_at = at - b_at
        same = self._same(spaced, b, b_at)
        a, a_at = _only(a, a_at, same)
        b, b_at = _only(b, b_at, same)
        a_ends, b_ends = np.cumsum(self.a_bytes.lengths[a]), np.cumsum(self.b_bytes.lengths[b])
        ends, in_a, in_b = np.intersect1d(a_ends, b_ends, assume_unique=True, return_indices=True)
        at = np.searchsorted(in_a, a_at)  # links before each text, which begins and ends with a common end
        return Aligned(np.diff(a_at), np.diff(b_at), np.diff(at), b[in_b].astype(np.int64) << 32 | a[in_a], self._groups(a, b, in_a, in_b, at))

    def _same(self, texts: pa.Array, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which texts' ids give the text's bytes back."""
        flat = memoryview(self.b_bytes.of(ids))
        ends = np.concatenate([[0], np.cumsum(self.b_bytes.lengths[ids])])[at].tolist()
        wanted = texts.cast(pa.large_binary()).to_pylist()
        return np.fromiter((x == flat[i:j] for x, i, j in zip(wanted, ends, ends[1:])), bool, len(wanted))  # noqa: B905

    def _groups(self, a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, at: np.ndarray) -> list[bytes]:
        if not len(items := np.empty(len(a) + len(b), np.int64)):
            return [b""] * (len(at) - 1)
        # A group's tokens of A come after all tokens of B in the groups before, and those of B after A's up to its own.
        after_a, after_b = np.searchsorted(in_a, np.arange(len(a))), np.searchsorted(in_b, np.arange(len(b)))
        where_a = np.arange(len(a)) + np.concatenate([[0], in_b + 1])[after_a]
        where_b = np.arange(len(b)) + (in_a + 1)[after_b]
        items[where_a], items[where_b] = a, b
        flat, ends = spread(self.digits.bytes, self.digits.starts[items], self.digits.lengths[items])
        flat[ends[where_a[in_a]] - 1] = ord("|")
        flat[ends[where_b[in_b]] - 1] = ord(";")
        # Each text's string ends before its last sign.
        last = np.concatenate([[0], ends])[np.concatenate([[0], in_a + in_b + 2])[at]].tolist()
        data = flat.tobytes()
        return [data[i : max(i, j - 1)] for i, j in zip(last, last[1:])]  # noqa: B905


def _only(ids: np.ndarray, at: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.diff(at) * kept
    return spread(ids, at[:-1], lengths)[0], np.concatenate([[0], np.cumsum(lengths)])


@functools.lru_cache(1)
def _aligner(a: bytes, b: bytes) -> Aligner:
    """One aligner for all tasks of a Python worker."""
    return Aligner(a, b)


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups_sha256 and links of each row of ``docs``.

    ``links`` has the B id and the A id of each link in binary, little-endian, in two bytes each where both vocabularies
    fit them, else in four.
    """
    contents = []
    for path in (a_path, b_path):
        with open(path, "rb") as f:
            contents.append(f.read())
    data = docs.sparkSession.sparkContext.broadcast(contents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(*data.value)
        kind_of_id = "<u2" if max(len(aligner.a_bytes.lengths), len(aligner.b_bytes.lengths)) <= 1 << 16 else "<u4"
        for batch in (part for batch in batches for part in slices(batch, "text", SLICE)):
            found = aligner(batch.column("text"))
            digests = [hashlib.sha256(g).hexdigest() if n else "" for g, n in zip(found.groups, found.n_links.tolist(), strict=True)]
            links = cells(_pairs(found.links, kind_of_id), 2 * np.concatenate([[0], np.cumsum(found.n_links)]))
            counts = [pa.array(x, pa.int64()) for x in (found.n_a, found.n_b, found.n_links)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array(digests, pa.string()), links], names)

    names = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, links binary")


def _pairs(keys: np.ndarray, kind: str) -> np.ndarray:
    return np.stack([keys >> 32, keys & 0xFFFFFFFF], axis=1).astype(kind).ravel()


def _keys(batch: pa.RecordBatch) -> np.ndarray:
    """The packed keys of a batch's ``links``; their number, ``n_groups``, tells how wide an id is."""
    rows = zip(batch.column("links").to_pylist(), batch.column("n_groups").to_pylist(), strict=True)
    parts = [np.frombuffer(x, f"<u{len(x) // (2 * n)}").reshape(-1, 2).astype(np.int64) for x, n in rows if n]
    pairs = np.concatenate([np.empty((0, 2), np.int64), *parts])
    return pairs[:, 0] << 32 | pairs[:, 1]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys, each once, and the sum of its counts: the runs of equal keys are summed."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1)) if len(keys) else order
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def partial_counts(aligned: DataFrame) -> DataFrame:
    """key and n of each partition's links; a partition holds its distinct keys, no more than ``MERGE`` links besides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = counts = np.empty(0, np.int64)
        waiting: list[np.ndarray] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            new, n = np.unique(np.concatenate([np.empty(0, np.int64), *waiting]), return_counts=True)
            return _summed(np.concatenate([keys, new]), np.concatenate([counts, n]))

        for batch in (part for batch in batches for part in slices(batch, "links", LINKS)):
            waiting.append(_keys(batch))
            size += len(waiting[-1])
            if size > MERGE:
                keys, counts = merged()
                waiting, size = [], 0
            if len(keys) > 8 * MERGE:  # a partition as large as that hands on what it has
                yield from _batches(keys, counts)
                keys = counts = np.empty(0, np.int64)
        yield from _batches(*merged())

    return aligned.select("n_groups", "links").mapInArrow(run, "key long, n long")


def _batches(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(keys), ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + ROWS]), pa.array(counts[i : i + ROWS])], ["key", "n"])


def count_links(aligned: DataFrame, path: str) -> DataFrame:
    """Write the counts of all links under the URI ``path``; returns one row for each shard.

    ``shard, n, first, last`` are its number, keys and bounds; ``ids`` and ``best`` (binary, 64 bits each) are the B ids
    that it has and the highest count of each there: over all shards at most the vocabulary, and one for each shard.
    """
    spark = aligned.sparkSession
    parts = materialise(partial_counts(aligned), "counts")
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = FileSystem.from_uri(path)
        context = TaskContext.get()
        shard = context.partitionId()
        name, attempt = f"{root}/part-{shard:05d}", f"{root}/_attempt-{context.taskAttemptId()}"
        files: list = []
        best: dict[int, int] = {}
        first, last, written = None, 0, 0
        held = np.empty(0, np.int64), np.empty(0, np.int64)

        def write(keys: np.ndarray, counts: np.ndarray) -> None:
            nonlocal first, last, written
            if not len(keys):
                return
            if not files:
                fs.create_dir(root)
                files.extend(fs.open_output_stream(attempt + end) for end in (".keys", ".counts"))
                first = int(keys[0])
            last, written = int(keys[-1]), written + len(keys)
            for f, x in zip(files, (keys, counts), strict=True):
                f.write(x.astype("<i8").tobytes())
            ids = keys >> 32
            starts = np.flatnonzero(np.diff(ids, prepend=-1))
            for k, n in zip(ids[starts].tolist(), np.maximum.reduceat(counts, starts).tolist(), strict=True):
                best[k] = max(best.get(k, 0), n)

        for batch in batches:
            keys, counts = _summed(np.concatenate([held[0], batch.column("key").to_numpy()]), np.concatenate([held[1], batch.column("n").to_numpy()]))
            write(keys[:-1], counts[:-1])
            held = keys[-1:], counts[-1:]  # the next batch may go on with it
        write(*held)
        if files:
            for f, end in zip(files, (".keys", ".counts"), strict=True):
                f.close()
                fs.move(attempt + end, name + end)
            ids, top = np.array(list(best), "<i8").tobytes(), np.array(list(best.values()), "<i8").tobytes()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "n": [written], "first": [first], "last": [last], "ids": [ids], "best": [top]})

    dealt = parts.repartitionByRange(shards, "key").sortWithinPartitions("key")
    return materialise(dealt.mapInArrow(run, "shard long, n long, first long, last long, ids binary, best binary"), "shards")


class SortedCounts:
    """Counts of keys in the shards under a URI; local files are mapped into memory, others read shard by shard."""

    def __init__(self, path: str, shards: list[tuple[int, int, int]]):
        self.path, self.shards = path, sorted(shards, key=lambda x: x[1])  # shard, first and last key
        self.fs, self.root = FileSystem.from_uri(path)
        self.mapped: dict[int, list[np.ndarray]] = {}

    def _open(self, shard: int) -> list[np.ndarray]:
        names = [f"{self.root}/part-{shard:05d}{end}" for end in (".keys", ".counts")]
        if not isinstance(self.fs, LocalFileSystem):
            return [np.frombuffer(self.fs.open_input_file(n).read_buffer(), "<i8") for n in names]
        if shard not in self.mapped:
            self.mapped[shard] = [np.memmap(n, "<i8", "r") for n in names]
        return self.mapped[shard]

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """The counts of sorted keys; 0 for those that no shard has."""
        out = np.zeros(len(keys), np.int64)
        for shard, first, last in self.shards:
            i, j = np.searchsorted(keys, first), np.searchsorted(keys, last, side="right")
            if i < j:
                known, counts = self._open(shard)
                at = np.searchsorted(known, keys[i:j])
                out[i:j] = np.where(known[np.minimum(at, len(known) - 1)] == keys[i:j], counts[np.minimum(at, len(known) - 1)], 0)
        return out


def look_up(aligned: DataFrame, path: str, manifest: DataFrame) -> DataFrame:
    """``aligned`` with n_best (links whose count is their B id's highest) and count_sum in place of its links."""
    rows = manifest.collect()  # a row for each shard, with as many ids as the vocabulary has, and one for each shard
    shards = [(r["shard"], r["first"], r["last"]) for r in rows]
    ids, tops = (np.concatenate([np.empty(0, "<i8"), *(np.frombuffer(r[c], "<i8") for r in rows)]) for c in ("ids", "best"))
    best = np.zeros(int(ids.max(initial=0)) + 1, np.int64)
    np.maximum.at(best, ids, tops)
    shared = aligned.sparkSession.sparkContext.broadcast(best)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = SortedCounts(path, shards)
        for batch in (part for batch in batches for part in slices(batch, "links", LINKS)):
            links, of = np.unique(_keys(batch), return_inverse=True)
            found = counts.look_up(links)
            good = found == shared.value[links >> 32]
            at = np.concatenate([[0], np.cumsum(batch.column("n_groups").to_numpy())])
            sums = [np.diff(np.concatenate([[0], np.cumsum(x[of])])[at]) for x in (good.astype(np.int64), found)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *map(pa.array, sums)], [*names, "n_best", "count_sum"])

    names = [c for c in aligned.columns if c != "links"]
    fields = ", ".join(f"{c} {aligned.schema[c].dataType.simpleString()}" for c in names)
    return aligned.mapInArrow(run, f"{fields}, n_best long, count_sum long")


def cross_align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row of ``docs``."""
    path = shared_path(docs.sparkSession, "pairs")
    aligned = materialise(align(docs, a_path, b_path), "aligned")
    found = look_up(aligned, path, count_links(aligned, path))
    return found.selectExpr("doc_id", "n_a", "n_b", "n_groups", "n_groups AS n_links", "n_best", "count_sum", "groups_sha256")
