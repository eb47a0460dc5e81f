"""A log of events that can be read again from any place.

Each micro-batch of a stream is appended under its number: its rows are written into a folder of the attempt, with their
places in the batch, and one rename of a small file then makes them part of the log. A batch that runs again after a
crash finds its entry and writes nothing, or finds none and writes anew; so every event is in the log once, over any
number of restarts, as long as the stream keeps its checkpoint. Readers go by the entries alone.

A place in the log is a cursor: the batch and the event's place in it. ``replay`` gives all events after a cursor, in an
order that never changes; only the batches after it are read.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


class Cursor(NamedTuple):
    """The last event that a reader has had; the default is before all."""

    batch: int = -1
    place: int = -1

    def __str__(self) -> str:
        return f"{self.batch}:{self.place}"

    @classmethod
    def parse(cls, text: str) -> Cursor:
        batch, place = text.split(":")
        return cls(int(batch), int(place))


class EventLog:
    """The log under the URI ``root``; ``order`` names the columns that order the events of a batch, all of them together unique."""

    def __init__(self, spark: SparkSession, root: str, order: list[str]):
        self.spark, self.root, self.order = spark, root.rstrip("/"), order
        self.fs, self.base = FileSystem.from_uri(self.root)

    def entries(self) -> dict[int, dict]:
        """What the log has of each batch: its folder, number of events and last place."""
        found = {}
        for f in self.fs.get_file_info(FileSelector(f"{self.base}/entries", allow_not_found=True)):
            if f.type == FileType.File and f.base_name.endswith(".json"):
                with self.fs.open_input_stream(f.path) as data:
                    found[int(f.base_name.removesuffix(".json"))] = json.loads(data.read())
        return found

    def _entry(self, batch: int) -> str:
        return f"{self.base}/entries/{batch:012d}.json"

    def has(self, batch: int) -> bool:
        return self.fs.get_file_info(self._entry(batch)).type == FileType.File

    def write_attempt(self, events: DataFrame, batch: int) -> dict:
        """Write a batch's events with their places; they aren't in the log before ``commit``.

        Ranges of the order are dealt out and sorted, so a row's place is its partition's number and its own in that.
        """
        folder = f"batches/{batch:012d}-{uuid.uuid4().hex}"
        dealt = events.repartitionByRange(*self.order).sortWithinPartitions(*self.order)
        dealt.withColumn("place", F.monotonically_increasing_id()).write.parquet(f"{self.root}/{folder}")
        written = self.spark.read.schema("place long").parquet(f"{self.root}/{folder}")
        n, last = written.agg(F.count("*"), F.max("place")).first()
        return {"folder": folder, "n": n, "last": -1 if last is None else last}

    def commit(self, batch: int, entry: dict) -> bool:
        """Make an attempt the batch's entry; False where the batch has one already."""
        if self.has(batch):
            return False
        self.fs.create_dir(f"{self.base}/entries")
        temporary = f"{self.base}/entries/_{uuid.uuid4().hex}"
        with self.fs.open_output_stream(temporary) as f:
            f.write(json.dumps(entry).encode())
        self.fs.move(temporary, self._entry(batch))
        return True

    def append(self, events: DataFrame, batch: int) -> None:
        """Add a batch's events, once: the function for ``foreachBatch``."""
        if not self.has(batch):
            self.commit(batch, self.write_attempt(events, batch))

    def follow(self, events: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Append a stream's batches as they come."""
        return events.writeStream.foreachBatch(self.append).option("checkpointLocation", checkpoint).trigger(**trigger).start()

    def replay(self, after: Cursor = Cursor(), upto: Cursor | None = None) -> DataFrame:  # noqa: B008
        """batch, place and the columns of all events after a cursor, up to another and with it where one is given."""
        entries = {b: e for b, e in sorted(self.entries().items()) if b >= after.batch and (upto is None or b <= upto.batch) and e["n"]}
        if not entries:
            raise LookupError(f"the log has no event after {after}")
        # One read of all folders: the file's name tells the batch, and only folders that hold wanted events are listed.
        read = self.spark.read.parquet(*(f"{self.root}/{e['folder']}" for e in entries.values()))
        batch = F.regexp_extract("_metadata.file_path", r"/batches/(\d{12})-", 1).cast("long")
        found = read.select(batch.alias("batch"), "place", *(c for c in read.columns if c != "place"))
        if after.place >= 0:
            found = found.filter((F.col("batch") > after.batch) | (F.col("place") > after.place))
        elif after.batch >= 0:
            found = found.filter(F.col("batch") >= after.batch)
        if upto is not None:
            found = found.filter((F.col("batch") < upto.batch) | (F.col("place") <= upto.place))
        return found

    def last(self) -> Cursor:
        """The cursor after which there is nothing yet."""
        entries = {b: e for b, e in self.entries().items() if e["n"]}
        return Cursor(max(entries), entries[max(entries)]["last"]) if entries else Cursor()

    def sweep(self) -> int:
        """Delete folders of attempts that became no entry; not while a batch is being written."""
        used = {e["folder"].split("/")[1] for e in self.entries().values()}
        gone = [f for f in self.fs.get_file_info(FileSelector(f"{self.base}/batches", allow_not_found=True)) if f.base_name not in used]
        for f in gone:
            self.fs.delete_dir(f.path)
        return len(gone)
