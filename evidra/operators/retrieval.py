"""Retrieval over chunks of text: BM25, exact cosine, weighted rank fusion and distinct-on top k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B, RRF_K, DENSE_WEIGHT, SPARSE_WEIGHT, SPARSE_FLOOR = 1.5, 0.75, 60, 1.0, 0.5, 0.35


def bm25(chunks: DataFrame, queries: DataFrame, tokens) -> DataFrame:
    """qid, id and score of every chunk that shares a term with a query; a term counts as often as the query has it."""
    terms = chunks.select("id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    lengths = terms.groupBy("id").agg(F.sum("tf").alias("len"))
    # One row of totals; chunks without a term count too.
    totals = chunks.select(F.size(tokens(F.col("text"))).alias("n")).agg(F.count("*").alias("chunks"), F.avg("n").alias("mean"))
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    asked = queries.select("qid", F.explode(tokens(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("times"))
    hit = asked.join(df, "term").join(terms, "term").join(lengths, "id").crossJoin(F.broadcast(totals))  # one row
    idf = F.ln(1 + (F.col("chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    return hit.groupBy("qid", "id").agg(F.sum(F.col("times") * idf * tf).alias("score"))


def ranked(scores: DataFrame, limit: int, floor: float | None = None) -> DataFrame:
    """The ``limit`` best of each query with ``rank`` from 0, ties by id; with ``floor`` only scores above that share of the best."""
    w = Window.partitionBy("qid")
    # A bare limit on the row number is applied in each task before the rows meet; the best of a query is among the kept.
    out = scores.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= limit)
    if floor is not None:
        out = out.withColumn("_best", F.max("score").over(w)).filter((F.col("_best") > 0) & (F.col("score") > F.col("_best") * floor)).drop("_best")
    return out.withColumn("rank", F.col("rank") - 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12))
    return F.transform(v, lambda x: x / norm)


def fuse_ranks(sparse: DataFrame, dense: DataFrame) -> DataFrame:
    """Full outer union of two rankings: weight / (60 + rank) of each, summed; both ranks stay, null where absent."""
    part = lambda df, w, name: df.select("qid", "id", (w / (RRF_K + F.col("rank"))).alias("part"), F.lit(name).alias("kind"), "rank")
    both = part(sparse, F.lit(SPARSE_WEIGHT), "sparse").union(part(dense, F.lit(DENSE_WEIGHT), "dense"))
    rank = lambda name: F.max(F.when(F.col("kind") == name, F.col("rank")))
    return both.groupBy("qid", "id").agg(F.sum("part").alias("score"), rank("sparse").alias("sparse_rank"), rank("dense").alias("dense_rank"))


def distinct_on(hits: DataFrame, by: str, limit: int) -> DataFrame:
    """The best hit of each ``by`` of a query, the ``limit`` best of these."""
    best = hits.groupBy("qid", by).agg(F.min("rank").alias("rank"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy("rank", by)) - 1
    return best.withColumn("place", place).filter(F.col("place") < limit)


def rerank(hits: DataFrame, scores: DataFrame) -> DataFrame:
    """Hits in order of external scores; those without one behind, as they were."""
    out = hits.join(scores, ["qid", "id"], "left")
    order = Window.partitionBy("qid").orderBy(F.col("external").desc_nulls_last(), "rank")
    return out.withColumn("rank", F.row_number().over(order) - 1).drop("external")
