"""Words and lines as Spark expressions, shared by the native operators."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that separates words: the six ASCII characters, nothing of Unicode's.
SPACE = r"[\x20\x09-\x0D]"


def words(text: Column) -> Column:
    """Maximal runs of characters other than ``SPACE``; null text has none.

    Splitting at one character needs no pattern, so other white space is made plain first where there is any.
    """
    text = F.coalesce(text, F.lit(""))
    odd = reduce(or_, (F.contains(text, F.lit(c)) for c in "\t\n\x0b\x0c\r"))
    return F.array_remove(F.split(F.when(odd, F.regexp_replace(text, SPACE, " ")).otherwise(text), " "), "")


def has_word(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\x0b\x0c\r")) != ""
