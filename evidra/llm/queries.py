"""The numbered queries: thin adapters from a folder of tables to each operator's contract."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.llm import (
    block_neighbours,
    bpe,
    chunk_reuse,
    cross_alignment,
    fill_middle,
    line_dedup,
    main_text,
    mixing,
    prefix_free_dedup,
    quality_crf,
    quality_rules,
    simhash,
    token_records,
)
from evidra.session import shared_path

#: Vectors whose id this divides are the queries, and how many neighbours each gets.
QUERY_EVERY, NEAREST = 50, 5
#: Vocabulary of the records, and the id that ends a document there.
RECORD_TOKENIZER, END_ID = "byte_bpe_50k.json", 2
#: Vocabulary of the matrices.
RANKS = "byte_bpe_multi_50k.tiktoken"
#: The tokenizer that is aligned with that of the records.
PIECES = "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_counts(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(_table(spark, sf_dir, "pages"))


def op2_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_crf.score(docs, quality_crf.fit(docs, _table(spark, sf_dir, "labels")))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return block_neighbours.nearest(vectors, F.col("vec_id") % QUERY_EVERY == 0, NEAREST)


def op4_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "records")
    docs = _table(spark, sf_dir, "documents")
    manifest = token_records.write_records(docs, path, public_tokenizers.path(RECORD_TOKENIZER), END_ID)
    return token_records.read_records(spark, path, manifest).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(RANKS)
    docs = _table(spark, sf_dir, "documents")
    return bpe.encode(docs, path, public_tokenizers.PATTERN, decoded=True).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prefix_free_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.line_counts(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_middle.fill_in_middle(_table(spark, sf_dir, "documents"))
    restored = fill_middle.restore(F.col("output"), F.col("form"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256")
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op12_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunk_reuse.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path(RECORD_TOKENIZER), decoded=True)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_cross_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return cross_alignment.cross_align(docs, public_tokenizers.path(RECORD_TOKENIZER), public_tokenizers.path(PIECES))


QUERIES = {
    "op1_main_text": op1_main_text,
    "op2_quality_crf": op2_quality_crf,
    "op3_nearest": op3_nearest,
    "op4_token_records": op4_token_records,
    "op5_quality_rules": op5_quality_rules,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_repeats": op7_repeats,
    "op8_simhash": op8_simhash,
    "op9_line_dedup": op9_line_dedup,
    "op10_mixing": op10_mixing,
    "op11_fill_middle": op11_fill_middle,
    "op12_chunk_reuse": op12_chunk_reuse,
    "op13_cross_alignment": op13_cross_alignment,
}

ORACLE_SQL = {
    "op3_nearest": block_neighbours.nearest_sql(NEAREST, QUERY_EVERY),
    "op5_quality_rules": quality_rules.counts_sql(),
    "op9_line_dedup": line_dedup.counts_sql(),
}
