"""Operator 8: SimHash fingerprints, linked where few bits differ, with pivot distance tables.

Distances to fixed reference fingerprints (the pivots) are looked up for every fingerprint: by the triangle
inequality two fingerprints within ``max_bits`` differ by no more than that in every pivot distance, so a pair is
discarded by its largest coordinate difference before the two are compared bit by bit. Pivot distances alone give no
key to join on, and scanning all pairs is not to be done; pairs are therefore formed within blocks. The 64 bits are
cut into ``max_bits + 3`` bands: fingerprints that differ in at most ``max_bits`` bits agree on at least three whole
bands, and every choice of three bands is one block key. A block of more than ``BLOCK`` fingerprints is cut once more in
the same way by the bits that its key leaves open; what then shares a key has at most 16 open bits left, so no block
holds more than 65,536. Blocks hold distinct fingerprints only, copies of a text being one, are ordered by the first
pivot's distances, so that pairs further apart there are never formed, and give a spanning forest of their links.

Defined results
---------------
* null or empty text, or only white space: fingerprint 0, linked like any other;
* fewer than three words: the whole sequence of words is the one shingle;
* null doc_id: fingerprinted and linked; ``component_id`` is the least doc_id that is present, null if there is none;
* repeated rows: each gets the same result; ``keep_one`` keeps one row of each component, the one of least doc_id
  (nulls last), of equal doc_ids the one of least row hash;
* very long texts: whole;
* empty table: empty result;
* extra columns, whatever their names: ``near_duplicates`` leaves them out, ``keep_one`` returns them unchanged.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm.components import components
from evidra.llm.rows import packed, row_hash
from evidra.session import materialise

SEED, SHINGLE, MAX_BITS, PIVOTS = 42, 3, 3, 16
#: Rows of sorted block keys that a task compares together.
TOGETHER = 100_000
#: Fingerprints of a block from which on it is cut once more.
BLOCK = 4096


def fingerprint(text: str | None) -> int:
    """Unsigned; bit k is set if it is set in over half of the shingles' hashes."""
    found = (text or "").encode().lower().split()  # bytes: only ASCII is lowered, only ASCII white space separates
    if not found:
        return 0
    if len(found) < SHINGLE:
        shingles = [b" ".join(found)]
    else:
        shingles = map(b" ".join, zip(*(found[k:] for k in range(SHINGLE)), strict=False))
    n = max(1, len(found) - SHINGLE + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        part = hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(rows: DataFrame) -> DataFrame:
    """``rows`` with its text replaced by ``fp``, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter(map(fingerprint, batch.column("text").to_pylist()), np.uint64, batch.num_rows)
            rest = batch.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(fps.view(np.int64))], [*rest.schema.names, "fp"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text")
    return rows.mapInArrow(run, f"{fields}, fp long")


def block_masks(max_bits: int, within: int = (1 << 64) - 1) -> list[int]:
    """One mask for each choice of three of ``max_bits + 3`` bands of the bits of ``within``."""
    n, bits = max_bits + 3, [k for k in range(64) if within >> k & 1]
    edges = [len(bits) * k // n for k in range(n + 1)]
    bands = [sum(1 << k for k in bits[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(bands, 3)]


def pivot_table(fps: np.ndarray, pivots: int = PIVOTS) -> np.ndarray:
    """Hamming distances of each fingerprint to each of the fixed reference fingerprints."""
    reference = np.random.default_rng(SEED).integers(0, 2**64, pivots, np.uint64)
    return np.bitwise_count(fps[:, None] ^ reference).astype(np.int8)


def block_forest(block: np.ndarray, fps: np.ndarray, max_bits: int, seen: Counter | None = None) -> np.ndarray:
    """For rows in order of ``block``: the number of a row that each is connected to within its block, its own at last.

    ``seen`` counts the pairs that are formed, and of them those that all pivots let through to be verified.
    """
    table = pivot_table(fps)
    order = np.lexsort((table[:, 0], block))
    table, fps = table[order], fps[order]
    root = np.arange(len(fps))
    # The last row of the same block that is no further from the first pivot than a link can be.
    place = block[order].astype(np.int64) * 256 + table[:, 0]
    last = np.searchsorted(place, place + max_bits, side="right") - 1
    at, lag = np.arange(len(fps)), 1
    while len(at := at[at + lag <= last[at]]):
        a = at[root[at] != root[at + lag]]
        formed = len(a)
        for p in range(1, table.shape[1]):  # the largest coordinate difference, pivot by pivot
            a = a[np.abs(table[a, p] - table[a + lag, p]) <= max_bits]
        if seen is not None:
            seen.update(formed=formed, verified=len(a))
        a = a[np.bitwise_count(fps[a] ^ fps[a + lag]) <= max_bits]
        b = a + lag
        while len(a):
            low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
            np.minimum.at(root, high, low)
            while (root[root] != root).any():
                root = root[root]
            apart = root[a] != root[b]
            a, b = a[apart], b[apart]
        lag += 1
    found = np.empty_like(order)
    found[order] = order[root]
    return found


def fingerprint_links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges (u, v) that connect whatever fingerprints of ``distinct(fp)`` differ in at most ``max_bits`` bits."""
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    masks = block_masks(max_bits)
    each = lambda c, m: F.struct(F.lit(c).alias("c"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key"))
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = distinct.select("fp", F.inline(F.array(*(each(k, m) for k, m in enumerate(masks)))))
    large = materialise(blocks.groupBy("c", "key").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK).select("c", "key"), "blocks")
    if large.head(1):
        finer = []
        for k, m in enumerate(masks):
            open_bits = ~m & (1 << 64) - 1
            keys = [each(len(masks) * (k + 1) + i, m | x) for i, x in enumerate(block_masks(max_bits, open_bits))]
            finer += [F.lit(k), F.array(*keys)]
        of_block = F.element_at(F.create_map(*finer), F.col("c"))
        cut = blocks.join(large, ["c", "key"], "left_semi").select("fp", F.inline(of_block))
        blocks = blocks.join(large, ["c", "key"], "left_anti").select("fp", "c", "key").union(cut)
    blocks = blocks.repartition(n, "c", "key").sortWithinPartitions("c", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def linked(rows: np.ndarray) -> pa.RecordBatch:
            change = np.any(np.diff(rows[:, 1:], axis=0) != 0, axis=1)
            block = np.concatenate([[0], np.cumsum(change)]) if len(rows) else np.empty(0, np.int64)
            fps = rows[:, 0].astype(np.int64)
            root = block_forest(block, fps.view(np.uint64), max_bits)
            other = root != np.arange(len(root))
            return pa.RecordBatch.from_pydict({"u": fps[other], "v": fps[root[other]]})

        for batch in batches:
            held.append(np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("fp", "c", "key")], axis=1))
            if sum(map(len, held)) >= TOGETHER:
                rows = np.concatenate(held)
                open_block = np.all(rows[:, 1:] == rows[-1, 1:], axis=1)
                yield linked(rows[~open_block])
                held = [rows[open_block]]
        if held:
            yield linked(np.concatenate(held))

    return blocks.mapInArrow(run, "u long, v long")


def _with_component(fps: DataFrame, max_bits: int) -> DataFrame:
    """``fps(..., fp)`` with ``component``, the least fingerprint that each is connected to."""
    found = components(fingerprint_links(fps.select("fp").distinct(), max_bits)).withColumnRenamed("node", "fp")
    return fps.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fp (signed long) and component_id, the least doc_id of the row's component."""
    fps = materialise(fingerprints(docs.select("doc_id", "text")), "fingerprints")
    # The least doc_id is found for fingerprints first, so that copies of a text meet before the shuffle.
    least = _with_component(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), max_bits)
    ids = least.groupBy("component").agg(F.min("least").alias("component_id"))
    named = least.join(ids, "component").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of ``docs`` for each component, all columns as they were."""
    rows = docs.select(packed(docs).alias("row"), "doc_id", "text", row_hash(docs).alias("h"))
    fps = materialise(fingerprints(rows.select("doc_id", "h", "text")), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "h"))
    least = _with_component(fps.groupBy("fp").agg(first.alias("first")), max_bits)
    kept = least.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("d"), F.col("first.h").alias("g"))
    out = rows.drop("text").join(kept, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")))
    return out.dropDuplicates(["d", "g"]).select("row.*")
