"""Labelled evaluation: confusion counts, pairs of twins and span accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.functions.evidence import temporal_iou


def confusion(rows: DataFrame, truth: Column, predicted: Column, *by: str) -> DataFrame:
    """tp, fp, fn, tn, precision, recall and f1, which are 0 where nothing counts."""
    n = lambda t, p: F.count_if((truth if t else ~truth) & (predicted if p else ~predicted))
    c = rows.groupBy(*by).agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(0, 0).alias("tn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    c = c.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return c.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def pair_accuracy(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """One row: pairs of twins, and those of which both are right."""
    pairs = left.select(on, F.col("correct").alias("a")).join(right.select(on, F.col("correct").alias("b")), on)
    return pairs.agg(F.count("*").alias("pairs"), F.count_if(F.col("a") & F.col("b")).alias("both_right"))


def located(labels: DataFrame, spans: DataFrame, key: str, floor: float = 0.30) -> DataFrame:
    """Whether any found span of the label's clip covers enough of the hull of both."""
    iou = temporal_iou(F.col("s"), F.col("e"), F.col("rs"), F.col("re"), hull=True)
    best = labels.join(spans, key, "left").groupBy("id").agg(F.max(iou).alias("iou"))
    return best.select("id", (F.coalesce("iou", F.lit(0.0)) >= floor).alias("located"))
