"""Writers: snapshots, upserts, and publication that lets no secret out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.sources.promotion import promote


def write_snapshot(corpus: DataFrame, path: str, version: str) -> None:
    """A snapshot of a corpus under its version; writing a version again replaces it."""
    corpus.withColumn("version", F.lit(version)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path)


def read_snapshot(spark: SparkSession, path: str, version: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("version") == version).drop("version")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``old`` whose key ``new`` doesn't have, and one row of each key of ``new``."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new.dropDuplicates([key]))


def publish(documents: DataFrame, column: str, path: str, secrets: list[str]) -> None:
    """Write documents once none of them holds a secret, in any column; what was there before stays until all is written."""
    parent, _, name = path.rstrip("/").rpartition("/")
    promote({name: documents.filter(F.col(column).isNotNull())}, parent if "://" in parent else f"file://{parent}", secrets)
