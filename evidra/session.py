"""Session defaults, and the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import weakref
from collections.abc import Iterator

from pyarrow.fs import FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("evidra")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The URI in ``spark.checkpoint.dir``; where it is unset a temporary folder, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="evidra-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, in a folder of the application's own that is deleted as the driver ends."""
    own = f"{shared_dir(spark)}/evidra-{spark.sparkContext.applicationId}"
    if own not in OWN:
        OWN.add(own)
        atexit.register(_delete, own)
    path = f"{own}/{label}-{uuid.uuid4().hex}"
    for made in MADE:
        made.append(path)
    return path


#: The folders of applications, and the paths that each open ``scratch`` has seen.
OWN: set[str] = set()
MADE: list[list[str]] = []


def _delete(path: str) -> None:
    fs, root = FileSystem.from_uri(path)
    with contextlib.suppress(OSError):
        if fs.get_file_info(root).type == FileType.Directory:
            fs.delete_dir(root)


@contextlib.contextmanager
def scratch(*kept: DataFrame) -> Iterator[list[DataFrame]]:
    """Delete at its end what was written for intermediate results within it.

    What is appended to the list that it gives stays; everything else must have been written or collected by then::

        with scratch() as kept:
            found = materialise(near_duplicates(docs), "found")
            kept.append(found)
    """
    made: list[str] = []
    keep = list(kept)
    MADE.append(made)
    try:
        yield keep
    finally:
        # By identity: lists of paths are equal when they are empty.
        MADE[:] = [m for m in MADE if m is not made]
        stay = {WRITTEN.get(df) for df in keep}
        for path in made:
            if path not in stay:
                _delete(path)


#: Spark's switch to delete a query's shuffle files as it ends; else they stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage like ``checkpoint()``: a lost executor costs a reread, never a recomputation, and unlike
    ``checkpoint()`` the plan above runs once and stays columnar. The write's shuffle files go as it ends.
    """
    spark = df.sparkSession
    path, was = shared_path(spark, label), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)
    out = spark.read.schema(df.schema).parquet(path)
    WRITTEN[out] = path
    return out


#: Where the data frames that ``materialise`` returned are written, for as long as they are in use.
WRITTEN: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def discard(df: DataFrame) -> None:
    """Delete the files of a data frame that ``materialise`` returned, once nothing reads it any more."""
    path = WRITTEN.pop(df, None)
    if path:
        _delete(path)
