"""Operator 11: fill-in-the-middle samples, cut by a streaming matcher that keeps no units.

A text is cut into units by a pattern (lines, by default). A first pass over its matches only counts them; a second one
advances a lazy match iterator to the two ranks that are drawn from the document's id, and the ends of those two matches
are all that is kept: memory beside the text is constant, whatever the number of units. The three parts are then laid out
prefix-suffix-middle (psm) or suffix-prefix-middle (spm) between marks, and ``restore`` puts them together again.

Documents are rows of their own: one pass, no shuffle; restoring is a Spark expression.

Defined results
---------------
* null or empty text: no units, form plain, an empty output;
* a text that holds a mark: plain, as its parts could not be told apart again;
* null doc_id: drawn like an empty id, so all such rows are cut by the same draws;
* repeated rows and ties: each row is cut by itself, equal rows alike;
* very long texts, or texts of one unit: whole; empty parts are kept as such;
* empty table: empty result; extra columns, whatever their names, are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.llm.chunks import slices

#: Lines with the line feed that ends them.
LINES = r"[^\n]*\n|[^\n]+"
#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
SEED = "7"


def check_marks(marks: tuple[str, str, str]) -> None:
    """Marks are found again beside any text if all begin with one character that they hold nowhere else."""
    if len(set(marks)) < 3 or any(len(m) < 2 or m[0] != marks[0][0] or m[0] in m[1:] for m in marks):
        raise ValueError("marks must differ, and begin with one character that they hold nowhere else")


def draws(seed: str, doc_id: object) -> list[int]:
    """The first four groups of eight hexadecimal digits of the SHA-256 of seed and id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4]) for k in range(0, 16, 4)]


def count_units(units: re.Pattern[str], text: str) -> int:
    return sum(1 for _ in units.finditer(text))


def cut_places(units: re.Pattern[str], text: str, first: int, second: int) -> tuple[int, int]:
    """Where the ``first`` and the ``second`` unit end, in one lazy pass that stops there; ``first <= second``."""
    matches = units.finditer(text)
    a = next(islice(matches, first - 1, None)).end() if first else 0
    return a, next(islice(matches, second - first - 1, None)).end() if second > first else a


def fill_in_middle(
    docs: DataFrame, units: str = LINES, seed: str = SEED, rate: int = 100, spm_rate: int = 50, marks: tuple[str, str, str] = MARKS
) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (code points; null if plain) and output of each row of ``docs``.

    ``rate`` percent of the documents are cut, ``spm_rate`` percent of those into spm.
    """
    check_marks(marks)
    p, s, m = marks

    def cut(doc_id: object, text: str, matcher: re.Pattern[str]) -> tuple[int, str, int | None, int | None, str]:
        n = count_units(matcher, text)
        h1, h2, h3, h4 = draws(seed, doc_id)
        if not text or any(mark in text for mark in marks) or h3 % 100 >= rate:
            return n, "plain", None, None, text
        a, b = cut_places(matcher, text, *sorted((h1 % (n + 1), h2 % (n + 1))))
        if h4 % 100 < spm_rate:
            return n, "spm", a, b - a, f"{s}{text[b:]}{p}{text[:a]}{m}{text[a:b]}"
        return n, "psm", a, b - a, f"{p}{text[:a]}{s}{text[b:]}{m}{text[a:b]}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = re.compile(units)
        for batch in (part for batch in batches for part in slices(batch, "text")):
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            rows = [cut(i, x or "", matcher) for i, x in zip(ids.to_pylist(), texts, strict=True)]
            columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([ids, *columns], names)

    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def restore(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that ``output`` was made of: each mark is where it first stands after the one before it."""
    check_marks(marks)
    p, s, m = marks
    between = lambda a, mark, b: F.substr(output, a + len(mark), b - a - len(mark))
    second = lambda mark: F.instr(output, mark)
    third = lambda at: at + F.instr(F.substr(output, at), m) - 1
    first = F.lit(1)
    psm = F.concat(between(first, p, second(s)), F.substr(output, third(second(s)) + len(m)), between(second(s), s, third(second(s))))
    spm = F.concat(between(second(p), p, third(second(p))), F.substr(output, third(second(p)) + len(m)), between(first, s, second(p)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
