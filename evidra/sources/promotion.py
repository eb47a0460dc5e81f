"""Publishing a set of outputs so that readers see all of the new ones or all of the old ones.

All outputs are first written into a staging folder beside their places, and checked there, as the bytes that readers
would see. Then a journal is written, each old output is renamed away and each new one into its place. A failure between
two renames is rolled back at once; a process that dies between them leaves its journal, and the next call (or
``recover``) rolls back by it. The journal's deletion is the commit: before it the old set can be restored, after it only
leftovers are deleted. The folder must be in a store that renames.
"""

from __future__ import annotations

import json
import uuid

from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class RefusedError(ValueError):
    """A staged output failed a check; nothing was published."""


def _exists(fs: FileSystem, path: str) -> bool:
    return fs.get_file_info(path).type != FileType.NotFound


def _delete(fs: FileSystem, path: str) -> None:
    kind = fs.get_file_info(path).type
    if kind == FileType.Directory:
        fs.delete_dir(path)
    elif kind == FileType.File:
        fs.delete_file(path)


def leaks(spark: SparkSession, path: str, secrets: list[str]) -> bool:
    """Whether any line of the text files under ``path`` holds one of the secrets; shorter ones than four characters don't count."""
    known = [s.strip() for s in secrets if len(s.strip()) >= 4]
    if not known:
        return False
    leak = F.lit(False)
    for s in known:
        leak = leak | F.contains("value", F.lit(s)) | F.contains("value", F.lit(json.dumps(s)[1:-1]))
    return bool(spark.read.text(path, recursiveFileLookup=True).filter(leak).head(1))


def _roll_back(fs: FileSystem, base: str, run: str, journal: dict) -> None:
    """Restore the set before a run; may itself be interrupted and done again."""
    for name in journal["names"]:
        old, place = f"{base}/_old-{run}/{name}", f"{base}/{name}"
        if _exists(fs, old):
            _delete(fs, place)
            fs.move(old, place)
        elif name not in journal["had"] and not _exists(fs, f"{base}/_staged-{run}/{name}"):
            _delete(fs, place)  # it was renamed into place, and there was none before


def _clear(fs: FileSystem, base: str, run: str) -> None:
    for part in (f"_staged-{run}", f"_old-{run}", f"_writing-{run}.json"):
        _delete(fs, f"{base}/{part}")


def recover(target: str) -> int:
    """Roll back what runs that died left half done; how many there were."""
    fs, base = FileSystem.from_uri(target.rstrip("/"))
    found = fs.get_file_info(FileSelector(base, allow_not_found=True))
    journals = [f for f in found if f.base_name.startswith("_journal-")]
    for f in journals:
        run = f.base_name.removeprefix("_journal-").removesuffix(".json")
        with fs.open_input_stream(f.path) as data:
            _roll_back(fs, base, run, json.loads(data.read()))
        fs.delete_file(f.path)
        _clear(fs, base, run)
    return len(journals)


def promote(outputs: dict[str, DataFrame], target: str, secrets: list[str] | None = None, required: tuple[str, ...] = ()) -> None:
    """Publish data frames as folders of JSON lines under ``target``, all or none.

    None of them may hold a secret, and those in ``required`` must have a row. Outputs of other names stay as they are.
    """
    target = target.rstrip("/")
    fs, base = FileSystem.from_uri(target)
    recover(target)
    run = uuid.uuid4().hex
    staged = f"{target}/_staged-{run}"
    fs.create_dir(base)
    try:
        for name, df in outputs.items():
            df.write.json(f"{staged}/{name}")
            spark = df.sparkSession
            if leaks(spark, f"{staged}/{name}", secrets or []):
                raise RefusedError(f"{name} holds a secret; nothing was published")
            if name in required and not spark.read.text(f"{staged}/{name}").head(1):
                raise RefusedError(f"{name} is empty; nothing was published")
        _swap(fs, base, run, list(outputs))
    finally:
        _clear(fs, base, run)


def _swap(fs: FileSystem, base: str, run: str, names: list[str]) -> None:
    journal = {"names": names, "had": [n for n in names if _exists(fs, f"{base}/{n}")]}
    written = f"{base}/_writing-{run}.json"
    with fs.open_output_stream(written) as f:
        f.write(json.dumps(journal).encode())
    fs.move(written, f"{base}/_journal-{run}.json")
    fs.create_dir(f"{base}/_old-{run}")
    try:
        for name in names:
            if name in journal["had"]:
                fs.move(f"{base}/{name}", f"{base}/_old-{run}/{name}")
            fs.move(f"{base}/_staged-{run}/{name}", f"{base}/{name}")
    except Exception:
        _roll_back(fs, base, run, journal)
        fs.delete_file(f"{base}/_journal-{run}.json")
        raise
    fs.delete_file(f"{base}/_journal-{run}.json")
