"""Vectors with a payload: upserts under ids made of names, and nearest vectors among those that a filter admits.

The store is a folder of Parquet files, partitioned by payload columns, so a filter on these reads only the partitions
that it admits. A search multiplies each batch of vectors with all questions at once and keeps the best of each question
while it goes on; what leaves a task is a few rows for each question, whatever the number of vectors, and these meet
in one window. Questions are broadcast in blocks of a checked size.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from evidra.session import discard, materialise

#: The most numbers of questions that are broadcast together, and the most scores that a task computes at once.
QUESTIONS, SCORES = 4_000_000, 4_000_000


def name_id(namespace: uuid.UUID, name: Column) -> Column:
    """The version 5 UUID of a name in a namespace, as RFC 4122 makes it from SHA-1: equal names have equal ids."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.substring(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)), -1, 1)
    parts = F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(F.lower(variant), F.substring(digest, 18, 3)), F.substring(digest, 21, 12)
    return F.concat_ws("-", *parts)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of one question's candidates the k of highest score, the smaller id first of equal ones."""
    if len(ids) > 4 * k:  # nothing below the k-th score can be among them
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, scores = ids[scores >= least], scores[scores >= least]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _search_block(vectors: DataFrame, rows: list, k: int, scale: float | None, schema: StructType) -> DataFrame:
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]
    keys = pa.array([r[0] for r in rows], kinds[0])
    shared = vectors.sparkSession.sparkContext.broadcast((keys, np.array([r[1] for r in rows], np.float64).reshape(len(rows), -1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, questions = shared.value
        best: list[tuple] = [(np.empty(0, object), np.empty(0))] * len(keys)
        step = max(1, SCORES // max(1, len(keys)))
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                ids = part.column("id").to_numpy(zero_copy_only=False)
                matrix = np.array(part.column("vector").to_pylist(), np.float64).reshape(len(ids), -1)
                scores = questions @ matrix.T
                if scale:
                    scores = np.floor(scores * scale + 0.5)
                for q in range(len(keys)):
                    known = best[q]
                    best[q] = _best(np.concatenate([known[0], ids]), np.concatenate([known[1], scores[q]]), k)
        sizes = [len(b[0]) for b in best]
        if sum(sizes):
            of = np.repeat(np.arange(len(keys)), sizes)
            ids = pa.array(np.concatenate([b[0] for b in best]).tolist(), kinds[1])
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(of)), ids, pa.array(np.concatenate([b[1] for b in best]))], ["qid", "id", "score"])

    return vectors.select("id", "vector").mapInArrow(run, schema)


def nearest(vectors: DataFrame, questions: DataFrame, k: int, scale: float | None = None) -> DataFrame:
    """qid, id, score and rank (from 0) of the k vectors (id, vector) of highest dot product with each of ``questions(qid, vector)``.

    Equal scores go to the smaller id; with ``scale`` scores are whole numbers of 1/scale before they are compared.
    Rows whose vector is null take no part; there must be one question at most of each qid.
    """
    asked, given = questions.filter("vector is not null"), vectors.filter("vector is not null")
    schema = StructType([StructField("qid", asked.schema["qid"].dataType), StructField("id", given.schema["id"].dataType), StructField("score", DoubleType())])
    n, width = asked.agg(F.count("*"), F.max(F.size("vector"))).first()
    blocks = max(1, -(-n * (width or 1) // QUESTIONS))
    found = None
    for b in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).select("qid", "vector").collect()
        if rows:
            part = _search_block(given, rows, k, scale, schema)
            found = part if found is None else found.unionByName(part)
    if found is None:
        return vectors.sparkSession.createDataFrame([], StructType([*schema.fields, StructField("rank", IntegerType())]))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
    return found.withColumn("place", place).filter(F.col("place") <= k).select("qid", "id", "score", (F.col("place") - 1).alias("rank"))


class VectorStore:
    """A folder of (id, name, vector, payload); ``payload`` names its partition columns, which filters prune by."""

    def __init__(self, spark: SparkSession, root: str, payload: list[str], namespace: str = "evidra"):
        self.spark, self.root, self.payload = spark, root.rstrip("/"), payload
        self.namespace = uuid.uuid5(uuid.NAMESPACE_URL, namespace)
        self.fs, self.base = FileSystem.from_uri(self.root)

    def _snapshots(self) -> list[str]:
        found = self.fs.get_file_info(FileSelector(self.base, allow_not_found=True))
        return sorted(f.base_name for f in found if f.type == FileType.File and f.base_name.startswith("snapshot-"))

    def read(self) -> DataFrame:
        """All rows of the latest snapshot."""
        names = self._snapshots()
        if not names:
            raise LookupError("the store is empty")
        with self.fs.open_input_stream(f"{self.base}/{names[-1]}") as f:
            return self.spark.read.parquet(f"{self.root}/{json.loads(f.read())['folder']}")

    def upsert(self, rows: DataFrame) -> None:
        """Add ``rows(name, vector, payload…)``; one of a known name replaces it, also if its payload has changed.

        Of rows that share a name the least by all columns is taken. Readers see the old snapshot or the new one.
        """
        fresh = rows.withColumn("id", name_id(self.namespace, F.col("name"))).filter("name is not null")
        rest = [c for c in fresh.columns if c != "id"]
        fresh = materialise(fresh.groupBy("id").agg(F.min(F.struct(*rest)).alias("row")).select("id", "row.*"), "upsert")
        names = self._snapshots()
        whole = fresh
        if names:
            old = self.read()
            whole = old.join(fresh.select("id"), "id", "left_anti").unionByName(fresh)
        number = int(names[-1].split("-")[1].split(".")[0]) + 1 if names else 0
        folder = f"data-{number:08d}-{uuid.uuid4().hex}"
        whole.repartition(*self.payload).write.partitionBy(*self.payload).parquet(f"{self.root}/{folder}")
        temporary = f"{self.base}/_{uuid.uuid4().hex}"
        with self.fs.open_output_stream(temporary) as f:
            f.write(json.dumps({"folder": folder, "payload": self.payload}).encode())
        self.fs.move(temporary, f"{self.base}/snapshot-{number:08d}.json")
        discard(fresh)

    def search(self, questions: DataFrame, k: int, where: Column | None = None, scale: float | None = None) -> DataFrame:
        """The k nearest vectors of each question among the rows that ``where`` admits, with their names."""
        admitted = self.read() if where is None else self.read().filter(where)
        found = nearest(admitted, questions, k, scale)
        return found.join(admitted.select("id", "name"), "id")
