"""From raw documents to token ids: five stages, each one of the operators in ``evidra.llm``.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's ``docs``.
All but the last return the columns of ``docs``. Nulls, empty tables, repeated rows and extra columns are defined by
the operators' own docstrings.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.llm import bpe, line_dedup, mixing, quality_rules, simhash
from evidra.llm.queries import RANKS
from evidra.session import discard, materialise, scratch

#: No SQL for run()'s rows: fingerprints' components, balancing and BPE are not expressible there.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go; ``n_chars``, where there is one, counts what is left."""
    out = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents appear as often as the mix takes them."""
    return mixing.mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit) and n_tokens."""
    return bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("simhash", keep_one_of_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = docs
        with scratch() as kept:  # what a stage writes on its way goes once its result is written
            docs = materialise(stage(spark, before, sf_dir), name)
            kept.append(docs)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
