"""What all operators do with whole rows: name every column, pack rows, and tell rows apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType, VariantType


def column(name: str) -> Column:
    """A column by its whole name, dots and back quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns(df: DataFrame, but: str | None = None) -> list[Column]:
    return [column(c) for c in df.columns if c != but]


def packed(df: DataFrame, but: str | None = None) -> Column:
    """All columns of a row, but one if need be, as one struct."""
    return F.struct(*columns(df, but))


def row_hash(df: DataFrame) -> Column:
    """64 bits of all columns. Which are null counts too, at any depth; maps count in the order that they are in."""
    nested = (ArrayType, MapType, StructType, VariantType)
    plain = [column(f.name) for f in df.schema.fields if not isinstance(f.dataType, nested)]
    deep = [F.to_json(F.struct(column(f.name).alias("x")), {"ignoreNullFields": "false"}) for f in df.schema.fields if isinstance(f.dataType, nested)]
    # The hash passes over nulls, so a string tells where they are.
    return F.xxhash64(F.concat(F.lit(""), *(F.when(c.isNull(), "0").otherwise("1") for c in plain)), *plain, *deep)
