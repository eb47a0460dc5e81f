"""Scans in order over the rows that share keys, one group in memory at a time."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: How pandas holds the types that scans give.
TYPES = {"long": "Int64", "double": "float64", "string": "object"}


def _starts(rows: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Where in sorted rows the groups begin; nulls of a key are equal."""
    new = np.zeros(len(rows), bool)
    new[:1] = True
    for key in keys:
        codes, _ = pd.factorize(rows[key], use_na_sentinel=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def groups(batches: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[list[list[tuple]]]:
    """The groups of equal keys in batches that are sorted by them: for each batch those that end in it, and at last the rest.

    A group is a list of named tuples, as a frame for each of many small groups costs far more than its rows. Of what came
    before only the group that goes on is held.
    """
    held: list[tuple] = []
    for batch in batches:
        if batch.empty:
            continue
        rows = list(batch.itertuples(index=False, name="Row"))
        starts = _starts(batch, keys).tolist()
        same = lambda a, b: a == b or (pd.isna(a) and pd.isna(b))
        if held and all(same(getattr(held[-1], key), getattr(rows[0], key)) for key in keys):  # the held group goes on
            del starts[0]
            if not starts:
                held += rows
                continue
            held += rows[: starts[0]]
        done = [held] if held else []
        done += [rows[i:j] for i, j in itertools.pairwise(starts)]
        held = rows[starts[-1] :]
        yield done
    if held:
        yield [held]


def scan_groups(df: DataFrame, scan: Callable[[list[tuple]], Iterable[tuple]], schema: str, keys: list[str], order: list[str]) -> DataFrame:
    """``scan`` of the rows of each group of equal keys, in order; nulls are equal, and last. Rows are named tuples, results tuples.

    Rows are dealt out by their keys and sorted in the JVM, where they can spill; a task then holds one group and one
    batch of rows at a time, whatever the table's size and the number of partitions. The partitions are as many as the
    session's: what takes time here is rows, so few bytes are no reason to put them into fewer tasks.
    """
    columns = [tuple(c.split(" ")) for c in schema.split(", ")]

    def result(found: list[tuple]) -> pd.DataFrame:
        values = zip(*found, strict=True) if found else ([] for _ in columns)
        return pd.DataFrame({name: pd.Series(list(v), dtype=TYPES[kind]) for (name, kind), v in zip(columns, values, strict=True)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for done in groups(batches, keys):
            yield result([row for group in done for row in scan(group)])

    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(partitions, *keys).sortWithinPartitions(*keys, *(F.col(c).asc_nulls_last() for c in order))
    return dealt.mapInPandas(run, schema)
