from collections import Counter

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from evidra.llm import bpe, mixing, queries, quality_rules, simhash

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_on_whole_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert out.columns == docs.columns, name
        if name == "quality_rules":
            assert out.count() == quality_rules.quality_counts(docs).filter("kept").count() < docs.count()
        if name == "line_dedup":
            assert out.count() == docs.count()
            assert out.select("text").subtract(docs.select("text")).count() > 0
            assert out.filter("n_chars <> length(text)").count() == 0
        if name == "simhash":
            assert out.count() == simhash.near_duplicates(docs).select("component_id").distinct().count()
        if name == "mixing":
            plan = mixing.plan_mix(docs.select("doc_id", "source", "text"))
            assert out.count() == plan.agg({"copies": "sum"}).first()[0]
        docs = out
    found = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    data = open(public_tokenizers.path(queries.RANKS), "rb").read()
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(data), special_tokens={})
    wanted = sorted((r.doc_id, own.encode_ordinary(r.text)) for r in docs.collect())
    assert sorted((r.doc_id, [int.from_bytes(r.ids[i : i + 4], "little") for i in range(0, len(r.ids), 4)]) for r in found) == wanted
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash", "mixing", "byte_bpe"]


def test_run_on_odd_rows(spark, tmp_path):
    """Nulls, repeats, a column named a.b and a map: every stage returns its columns, and every kept row is encoded."""
    line = lambda k: " ".join(f"w{k}x{j} of the and to" for j in range(12))
    rows = [(k, line(k), "en", f"s{k % 3}", k) for k in range(30)] + [(3, line(3), "en", "s0", 3), (None, line(99), None, None, 99), (None, None, None, None, None), (40, "", "en", "s1", 40), (41, "short", "en", "s1", 41)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, tag long")
    df = df.withColumn("n_chars", F.length("text").cast("long")).withColumn("a.b", F.col("tag") % 2).withColumn("m", F.when(F.col("tag") > 5, F.create_map(F.lit("k"), "tag")))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = Counter()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns
    for r in docs.collect():
        assert r.n_chars == len(r.text)
        kept[r.doc_id] += 1
    assert kept[None] >= 1 and kept[41] == kept[40] == 0 and len(kept) >= 25
    found = Counter(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert found == kept


def test_run_on_nothing(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_short_lines_are_judged(spark):
    lines = [
        ("All rights reserved.", True), ("a b c d e", True), (" ", True), ("All  rights reserved.", False), ("one", True), ("one", False), ("", True),
        ("a b c d X", False), ("a b c d e f", False), ("a b c d", True), ("a b c Y", True), ("a b c d", False), ("p q r s t u v w x", True), ("p q r s t u v w", False), ("", True),
    ]
    rows = [(1, "\n".join(x for x, _ in lines[:6])), (2, "\n".join(x for x, _ in lines[6:])), (3, "one\nAll rights reserved."), (4, None)]
    out = corpus_pipeline.drop_repeated_lines(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), SF)
    kept = lambda part: "\n".join(x for x, stays in part if stays)
    assert {r.doc_id: r.text for r in out.collect()} == {1: kept(lines[:6]), 2: kept(lines[6:]), 3: "", 4: None}
