"""Tables kept by their contents: written once under their digest, and read only when they are whole.

A table's digest is of its schema and of the multiset of its rows, so neither the order of rows nor the number of files
counts. Each writer writes into a folder of its own attempt, and only when all files are there does it write a marker
that names the attempt, by one rename. Readers go by markers alone: a folder without one, of a writer that was interrupted or is still
writing, is never read. Two writers of one content both end with a marker; as their rows are equal, either is right,
and ``sweep`` deletes the other. No step needs a lock, or a rename of more than one small file.

A table by a *key* (a digest of what it was computed from) is looked up before it is computed: ``cached`` does both.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable

from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.session import CLEANUP

#: Sums of rows' hashes: SHA-256 in eight parts of 32 bits, so that sums of 10**28 rows fit a decimal.
PARTS = 8


def row_sums(df: DataFrame) -> list:
    """Columns that sum up the rows' SHA-256, part by part; equal for equal multisets of rows, in any order."""
    digest = F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"}), 256)
    part = lambda k: F.conv(F.substring("_d", 8 * k + 1, 8), 16, 10).cast("decimal(38,0)")
    return [df.select(digest.alias("_d")), [F.sum(part(k)).alias(f"s{k}") for k in range(PARTS)]]


def content_digest(df: DataFrame) -> str:
    """SHA-256 of a table's schema, number of rows and rows, whatever their order and partitions."""
    hashed, sums = row_sums(df)
    row = hashed.agg(F.count("*").alias("n"), *sums).first()
    body = {"schema": [[f.name, f.dataType.simpleString()] for f in df.schema.fields], "n": row["n"], "sums": [str(row[f"s{k}"] or 0) for k in range(PARTS)]}
    return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def key_of(**inputs: object) -> str:
    """A digest of what a table is computed from: digests of tables, versions, parameters; by name, in no order."""
    return hashlib.sha256(json.dumps(inputs, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


class ContentStore:
    """A folder of tables in namespaces, each under its digest or key."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.fs, self.base = FileSystem.from_uri(self.root)

    def _folder(self, namespace: str, digest: str) -> str:
        return f"{namespace}/{digest}"

    def _listed(self, folder: str, recursive: bool = False) -> list:
        return self.fs.get_file_info(FileSelector(f"{self.base}/{folder}", allow_not_found=True, recursive=recursive))

    def markers(self, namespace: str, digest: str) -> list[str]:
        """The attempts at a table that are whole, the first by name first."""
        found = [f.base_name for f in self._listed(self._folder(namespace, digest)) if f.type == FileType.File]
        return sorted(x.removeprefix("ready-") for x in found if x.startswith("ready-"))

    def exists(self, namespace: str, digest: str) -> bool:
        return bool(self.markers(namespace, digest))

    def write_attempt(self, df: DataFrame, namespace: str, digest: str) -> str:
        """Write the rows under a new attempt's name; they aren't read until ``commit``."""
        attempt = uuid.uuid4().hex
        was = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(f"{self.root}/{self._folder(namespace, digest)}/{attempt}")
        finally:
            self.spark.conf.unset(CLEANUP) if was is None else self.spark.conf.set(CLEANUP, was)
        return attempt

    def commit(self, namespace: str, digest: str, attempt: str) -> None:
        """Mark an attempt as whole: its marker appears at once, with its content."""
        folder = f"{self.base}/{self._folder(namespace, digest)}"
        with self.fs.open_output_stream(f"{folder}/_marker-{attempt}") as f:
            f.write(json.dumps({"attempt": attempt, "at": time.time()}).encode())
        self.fs.move(f"{folder}/_marker-{attempt}", f"{folder}/ready-{attempt}")

    def put(self, df: DataFrame, namespace: str = "tables") -> str:
        """Write a table unless its content is there; returns its digest.

        The table is computed twice, for the digest and for the rows; materialise it first if that is dear.
        """
        digest = content_digest(df)
        if not self.exists(namespace, digest):
            self.commit(namespace, digest, self.write_attempt(df, namespace, digest))
        return digest

    def get(self, digest: str, namespace: str = "tables", verify: bool = False) -> DataFrame:
        """The table of a digest or key; with ``verify`` its rows must still have that digest."""
        found = self.markers(namespace, digest)
        if not found:
            raise KeyError(f"{namespace}/{digest}")
        out = self.spark.read.parquet(f"{self.root}/{self._folder(namespace, digest)}/{found[0]}")
        if verify and content_digest(out) != digest:
            raise ValueError(f"the rows of {namespace}/{digest} are not those that were written")
        return out

    def cached(self, key: str, compute: Callable[[], DataFrame], namespace: str = "results") -> DataFrame:
        """The table of a key; computed and written only where it isn't there."""
        if not self.exists(namespace, key):
            self.commit(namespace, key, self.write_attempt(compute(), namespace, key))
        return self.get(key, namespace)

    def stats(self) -> dict[str, int]:
        """How many whole tables each namespace has."""
        names = [f.base_name for f in self._listed("") if f.type == FileType.Directory]
        return {n: sum(self.exists(n, f.base_name) for f in self._listed(n) if f.type == FileType.Directory) for n in sorted(names)}

    def sweep(self, older_than_s: float = 86_400) -> int:
        """Delete what no reader uses: attempts without a marker that are older than that, and all whole ones but the first."""
        gone = 0
        for space in (f for f in self._listed("") if f.type == FileType.Directory):
            for table in (f for f in self._listed(space.base_name) if f.type == FileType.Directory):
                ready = self.markers(space.base_name, table.base_name)
                for f in self._listed(f"{space.base_name}/{table.base_name}"):
                    if f.type != FileType.Directory or f.base_name in ready[:1]:
                        continue
                    if f.base_name in ready:
                        self.fs.delete_file(f"{table.path}/ready-{f.base_name}")  # first, so that no reader finds it
                    elif time.time() - f.mtime.timestamp() < older_than_s:
                        continue
                    self.fs.delete_dir(f.path)
                    gone += 1
        return gone
