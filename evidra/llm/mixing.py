"""Operator 10: mixing sources to target weights by entropy balancing.

Each document gets a rate between 0 and ``MAX_COPIES`` copies. Of all rates whose words meet the sources' targets the
ones nearest to one copy each (in relative entropy) are exponentially tilted: the odds of a copy are
``exp(lambda * size / mean size)``, one multiplier a source. The multipliers are found by Newton steps on the convex
dual. A step needs two sums a source, which are taken over the table of (source, size) counts by Spark; sums are
decimals, so they do not depend on the order of the rows. Rates become whole copies in two steps: each class of equal
source and size gets a whole number of copies, carrying what is left over to the next smaller size, and the class's
copies go to its documents by the order of their hashes.

Defined results
---------------
* null or empty text: size 0, one copy of no words;
* null source: a source of its own, after all others; null doc_id: mixed like any other;
* repeated rows: each is a document; ties of hash are broken by row number, which equal rows do not show;
* very long texts: whole;
* sources without words: target 0; an empty table, or one without words: nothing is taken;
* extra columns, whatever their names: ``plan_mix`` leaves them out, ``mix`` returns them unchanged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.llm.rows import packed, row_hash
from evidra.llm.text import words
from evidra.session import discard, materialise

WEIGHTS, EPOCHS, MAX_COPIES = (5.0, 2.0, 1.0), 1.5, 2
#: A source is balanced when its expected words are this near its target, as a share of it.
TOLERANCE, MAX_STEPS = 1e-9, 100
#: Documents of a class that are ranked together.
RANKED = 1000


def source_targets(sizes: DataFrame, weights: tuple[float, ...], epochs: float) -> DataFrame:
    """source, k (its place), n, source_size and target of every source of ``sizes(source, size, n)``."""
    every = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n"))
    place = Window.orderBy(F.col("source").asc_nulls_last())
    every = every.withColumn("k", F.row_number().over(place) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod("k", F.lit(len(weights))) + 1)
    every = every.select("*", weight.alias("weight"), (F.col("source_size") * float(MAX_COPIES)).alias("cap"))
    # Sources reach their caps in the order of cap / weight; the level is what is left by weight after those below it.
    order = Window.orderBy(F.col("cap") / F.col("weight"), "k")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    used, gone = F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = (F.sum("source_size").over(whole) * epochs - used) / (F.sum("weight").over(whole) - gone)
    every = every.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("weight") * F.col("level"))
    first_open = F.min(F.when(~F.col("full"), F.struct((F.col("cap") / F.col("weight")).alias("at"), "k", "level")))
    open_level = F.coalesce(first_open.over(whole)["level"], F.lit(float("inf")))
    return every.withColumn("target", F.least("cap", F.col("weight") * open_level)).select("source", "k", "n", "source_size", "target")


def _rate(tilt: Column) -> Column:
    return F.when(tilt > 700, float(MAX_COPIES)).when(tilt < -700, 0.0).otherwise(MAX_COPIES / (F.exp(-tilt) * (MAX_COPIES - 1) + 1))


def balance(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """``targets`` with ``tilt``, each source's multiplier; infinite where only all or no copies meet the target."""
    free = (F.col("target") > 0) & (F.col("target") < F.col("source_size") * float(MAX_COPIES) * (1 - 1e-12))
    edge = F.when(F.col("target") > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    state = targets.select("*", F.when(free, 0.0).otherwise(edge).alias("tilt"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"), (~free).alias("done"))
    state = materialise(state, "tilts")
    z = F.col("size") / (F.col("source_size") / F.col("n_docs"))
    for _ in range(MAX_STEPS):
        open_ = state.filter(~F.col("done")).withColumnRenamed("n", "n_docs")
        rate = _rate(F.col("tilt") * z)
        mass = F.col("n") * F.col("size") * rate
        sums = sizes.join(open_.select("k", "tilt", "source_size", "n_docs"), "k").groupBy("k").agg(
            F.sum(mass.cast("decimal(38,9)")).cast("double").alias("mass"), F.sum((mass * z * (1 - rate / MAX_COPIES)).cast("decimal(38,9)")).cast("double").alias("slope")
        )
        now = state.join(sums, "k", "left")
        off = F.col("mass") - F.col("target")
        low = F.when(off < 0, F.greatest("low", "tilt")).otherwise(F.col("low"))
        high = F.when(off > 0, F.least("high", "tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - F.greatest(F.lit(-4.0), F.least(F.lit(4.0), F.coalesce(F.try_divide(off, "slope"), F.signum(off) * 4)))
        inside = (newton > F.col("low2")) & (newton < F.col("high2"))
        step = F.when(inside, newton).otherwise((F.col("low2") + F.col("high2")) / 2)
        near = F.coalesce(F.abs(off) <= F.col("target") * TOLERANCE, F.lit(True)) | F.col("done")
        now = now.withColumn("low2", low).withColumn("high2", high)
        now = now.select(*targets.columns, F.when(near, F.col("tilt")).otherwise(step).alias("tilt"), F.col("low2").alias("low"), F.col("high2").alias("high"), near.alias("done"))
        old, state = state, materialise(now, "tilts")
        discard(old)
        if not state.filter(~F.col("done")).head(1):
            break
    return state.select(*targets.columns, "tilt")


def _whole_copies(classes: pd.DataFrame) -> pd.DataFrame:
    """Whole copies of each size of one source, from the largest size on, carrying the words left over."""
    classes = classes.sort_values("size", ascending=False)
    size, n = classes["size"].to_numpy(), classes["n"].to_numpy()
    wanted, copies, carried = n * classes["rate"].to_numpy(), np.zeros(len(n), np.int64), 0.0
    for i in range(len(n)):
        copies[i] = min(MAX_COPIES * n[i], max(0, int(np.floor(wanted[i] + (carried / size[i] if size[i] else 0) + 0.5))))
        carried += (wanted[i] - copies[i]) * size[i]
    return classes.assign(copies=copies)[["k", "size", "n", "copies"]]


def plan_mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: float = EPOCHS) -> DataFrame:
    """doc_id, source, h, size, source_size, target and copies of every row of ``docs(doc_id, source, text[, h])``."""
    h = F.col("h") if "h" in docs.columns else F.xxhash64("doc_id", "text")
    sized = docs.select("doc_id", "source", h.alias("h"), F.size(words(F.col("text"))).cast("long").alias("size"))
    sized = materialise(sized.withColumn("r", F.monotonically_increasing_id()), "sizes")
    sizes = sized.groupBy("source", "size").agg(F.count("*").alias("n"))
    targets = materialise(source_targets(sizes, weights, epochs), "targets")
    same = F.col("s").eqNullSafe(F.col("source"))
    places = targets.select(F.col("source").alias("s"), "k")
    sizes = materialise(sizes.join(places, same).select("k", "size", "n"), "classes")
    tilts = balance(sizes, targets)
    tilt = tilts.select("k", "source_size", "target", "tilt", F.col("n").alias("n_docs"))
    each = F.when(F.col("source_size") > 0, F.col("tilt") * (F.col("size") / (F.col("source_size") / F.col("n_docs")))).otherwise(0.0)
    rated = sizes.join(tilt, "k").select("k", "size", "n", F.when(F.col("size") > 0, _rate(each)).otherwise(1.0).alias("rate"))
    # The table of sizes holds one row for each size that a source has, so a source's part is small whatever its rows.
    classes = rated.groupBy("k").applyInPandas(_whole_copies, "k int, size long, n long, copies long")
    classes = materialise(classes.withColumn("parts", F.col("n") / RANKED + 1).withColumn("parts", F.col("parts").cast("long")), "copies")
    # A class's copies beyond the even share go to its first parts whole, and by rank in the part where they end.
    keyed = sized.join(places, same).join(classes.join(tilt, "k"), ["k", "size"]).withColumn("part", F.pmod(F.xxhash64("h"), "parts"))
    # Dealt out anew by part: a class of a third of all rows is joined in splits and ranked in its parts.
    keyed = keyed.repartition("k", "size", "part")
    counts = keyed.groupBy("k", "size", "part").agg(F.count("*").alias("in_part"))
    before = Window.partitionBy("k", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("in_part").over(before), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("k", "size", "part").orderBy("h", "r"))
    ranked = keyed.withColumn("rank", rank).join(counts, ["k", "size", "part"])
    share = F.col("copies") - F.floor(F.col("copies") / F.col("n")) * F.col("n")
    extra = (F.col("before") + F.col("rank") <= share).cast("long")
    return ranked.select("doc_id", "source", "h", "size", "source_size", "target", (F.floor(F.col("copies") / F.col("n")) + extra).alias("copies"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: float = EPOCHS) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, all columns as they were."""
    rows = docs.select(packed(docs).alias("row"), "doc_id", "source", "text", row_hash(docs).alias("h"))
    plan = plan_mix(rows.drop("row"), weights, epochs).groupBy("doc_id", "h").agg(F.sum("copies").alias("copies"))
    plan = plan.filter("copies > 0").select(F.col("doc_id").alias("d"), F.col("h").alias("g"), "copies")
    out = rows.select("row", "doc_id", "h").join(plan, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")))
    # Equal rows share one entry of the plan: one of them stands for all.
    out = out.dropDuplicates(["d", "g"]).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return out.select("row.*")
