"""Operator 4: token ids in length-delimited binary records, with a separate offset index.

``write_records`` deals documents out by ranges of doc_id, encodes each range with the tokenizers library and writes
one shard a task; ``read_records`` reads shards back, checks every checksum and returns the records.

A shard ``part-NNNNN.rec`` is a sequence of records, each
    length of the payload (8 bytes) | masked checksum of those 8 bytes (4) | payload | masked checksum of it (4),
all little-endian. The payload is the ids as unsigned integers of 2 bytes where the vocabulary fits them, else of 4.
The checksum is CRC-32, rotated right by 15 bits plus a constant, so that checksums of data that holds checksums stay
sound. ``part-NNNNN.idx`` has one entry of 25 bytes a record: offset, number of ids, doc_id (8 bytes each) and whether
doc_id is present; a reader may fetch records in any order by it. A shard is written under a name of its own task
attempt and then renamed, so a task that runs again replaces it by the same bytes.

Defined results
---------------
* null or empty text: a record that holds the end id alone;
* null doc_id: after all others; rows of one doc_id, and repeated rows: one record each, in order of their texts;
* very long texts: whole;
* empty table: no shard, no record;
* other columns, whatever their names, are left out.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidra.llm.chunks import slices
from evidra.llm.library_bpe import library_encoder
from evidra.session import materialise

#: Fixed value: the constant that the record format adds to a rotated checksum.
MASK_DELTA = 0xA282EAD8
#: Records read before they are handed on.
TOGETHER = 500
INDEX = np.dtype([("offset", "<i8"), ("n", "<i8"), ("doc_id", "<i8"), ("present", "u1")])


def masked_crc(data: bytes | memoryview) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes | memoryview) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked_crc(length)), payload, struct.pack("<I", masked_crc(payload))))


def read_frame(read) -> bytes:
    """The payload of the next record; ``read(n)`` returns the next n bytes."""
    length = bytes(read(8))
    (check,) = struct.unpack("<I", read(4))
    if check != masked_crc(length):
        raise ValueError("a record's length is damaged")
    payload = bytes(read(*struct.unpack("<Q", length)))
    (check,) = struct.unpack("<I", read(4))
    if check != masked_crc(payload):
        raise ValueError("a record's payload is damaged")
    return payload


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int, shards: int | None = None) -> DataFrame:
    """Write ``docs(doc_id, text)`` under the URI ``path``; returns the manifest (shard, n_records, n_ids, start).

    ``start`` counts the ids of all shards before. The manifest has one row a shard.
    """
    spark = docs.sparkSession
    with open(tokenizer, "rb") as f:
        data = spark.sparkContext.broadcast(f.read())
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.xxhash64("text")  # rows that share a doc_id can still be dealt to several shards
    order = [F.col("doc_id").asc_nulls_last(), key, F.col("text")]
    # Dealing out by numbers alone keeps texts out of the sample that sets the ranges.
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(shards, order[0], key).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(data.value)
        kind = "<u2" if encoder.size <= 1 << 16 else "<u4"
        fs, root = FileSystem.from_uri(path)
        context = TaskContext.get()
        shard = context.partitionId()
        name, attempt = f"{root}/part-{shard:05d}", f"{root}/_attempt-{context.taskAttemptId()}"
        records = ids = offset = 0
        rec = idx = None
        for batch in (part for batch in batches for part in slices(batch, "text")):
            if rec is None:
                fs.create_dir(root)
                rec, idx = fs.open_output_stream(attempt + ".rec"), fs.open_output_stream(attempt + ".idx")
            flat, at = encoder.encode(batch.column("text"))
            entries = np.zeros(len(at) - 1, INDEX)
            frames = []
            for k in range(len(at) - 1):
                frames.append(frame(np.append(flat[at[k] : at[k + 1]], end_id).astype(kind).tobytes()))
            sizes = np.fromiter(map(len, frames), np.int64, len(frames))
            entries["offset"] = offset + np.cumsum(sizes) - sizes
            entries["n"] = np.diff(at) + 1
            entries["doc_id"] = batch.column("doc_id").fill_null(0).to_numpy()
            entries["present"] = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            rec.write(b"".join(frames))
            idx.write(entries.tobytes())
            offset += int(sizes.sum())
            records += len(entries)
            ids += int(entries["n"].sum())
        if rec is not None:
            rec.close()
            idx.close()
            fs.move(attempt + ".rec", name + ".rec")
            fs.move(attempt + ".idx", name + ".idx")
            yield pa.RecordBatch.from_pydict({"shard": [shard], "n_records": [records], "n_ids": [ids], "width": [int(kind[-1])]})

    manifest = materialise(dealt.mapInArrow(run, "shard long, n_records long, n_ids long, width long"), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_records(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all records before) and ids (binary: unsigned 32-bit) of every record under ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = FileSystem.from_uri(path)
        for batch in batches:
            for row in batch.to_pylist():
                name = f"{root}/part-{row['shard']:05d}"
                with fs.open_input_stream(name + ".idx") as f:
                    index = np.frombuffer(f.read(), INDEX)
                if len(index) != row["n_records"] or index["n"].sum() != row["n_ids"]:
                    raise ValueError(f"{name}.idx doesn't match the manifest")
                starts = row["start"] + np.cumsum(index["n"]) - index["n"]
                with fs.open_input_stream(name + ".rec", buffer_size=1 << 20) as f:
                    for i in range(0, len(index), TOGETHER):
                        part = index[i : i + TOGETHER]
                        cells = [np.frombuffer(read_frame(f.read), f"<u{row['width']}").astype("<u4").tobytes() for _ in part]
                        if [len(c) // 4 for c in cells] != part["n"].tolist():
                            raise ValueError(f"{name}.rec doesn't match its index")
                        doc_id = pa.array(part["doc_id"].copy(), mask=part["present"] == 0)
                        yield pa.RecordBatch.from_arrays([doc_id, pa.array(starts[i : i + TOGETHER]), pa.array(cells, pa.binary())], ["doc_id", "start", "ids"])

    # One row a shard, dealt out one to a task.
    return manifest.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard").mapInArrow(run, "doc_id long, start long, ids binary")


def fetch_record(path: str, shard: int, k: int) -> np.ndarray:
    """Record ``k`` of a shard by its index, without the records before it."""
    fs, root = FileSystem.from_uri(path)
    name = os.path.join(root, f"part-{shard:05d}")
    with fs.open_input_file(name + ".idx") as f:
        f.seek(k * INDEX.itemsize)
        entry = np.frombuffer(f.read(INDEX.itemsize), INDEX)[0]
    with fs.open_input_file(name + ".rec") as f:
        f.seek(int(entry["offset"]))
        payload = read_frame(f.read)
    return np.frombuffer(payload, f"<u{len(payload) // int(entry['n'])}").astype(np.uint32)
