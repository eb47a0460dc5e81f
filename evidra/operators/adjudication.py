"""Charge, defend, rule: answers of models as tables, joined to what they were asked, with every row accounted for.

Models answer in rows that may name what they never were shown, repeat themselves or say nothing. ``adjudicate`` joins
charges, defences and rulings; each row of the three is used or stands in ``rejects`` with the reason, and only a charge
that was ruled on and upheld becomes a finding.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions import evidence as ev

# What models write for no defence, and what stands for a severity that there isn't.
NO_DEFENCE = ("", "null", "none", "n/a", "no defense", "no defence")
DEFAULT_SEVERITY, LEAST_MS = "MEDIUM", 200


class Outcome(NamedTuple):
    """``findings``, and ``rejects(stage, id, n, reason)``: the rows of each stage that are in no finding."""

    findings: DataFrame
    rejects: DataFrame


def judged_charges(charges: DataFrame, allowed: DataFrame, windows: DataFrame) -> DataFrame:
    """``charges(charge, window, clause, evidence, s, e)`` with spans clamped to their window and ``reason``, null if the charge stands.

    A charge must cite a clause that its window was shown (``allowed(window, clause)``), of a window that there is
    (``windows(window, ws, we)``), with words as evidence.
    """
    shown = allowed.select("window", "clause").distinct().withColumn("_shown", F.lit(True))
    out = charges.join(windows.select("window", "ws", "we"), "window", "left").join(shown, ["window", "clause"], "left")
    blank = F.trim(F.coalesce("evidence", F.lit(""))) == ""
    reason = F.when(F.col("ws").isNull(), "no such window").when(F.col("_shown").isNull(), "clause not shown").when(blank, "no evidence")
    s = F.least(F.greatest(F.coalesce("s", "ws"), "ws"), "we")
    e = F.greatest(F.least(F.coalesce("e", "we"), "we"), s + LEAST_MS)
    return out.withColumn("reason", reason).withColumn("s", s).withColumn("e", e).drop("_shown", "ws", "we")


def _verdict(text: Column) -> Column:
    return F.when(F.startswith(F.upper(F.trim(F.coalesce(text, F.lit("")))), F.lit("DIS")), "DISMISSED").otherwise("UPHELD")


def answers(charges: DataFrame, allowed: DataFrame, windows: DataFrame, defences: DataFrame, rulings: DataFrame) -> DataFrame:
    """Every row of ``adjudicate``'s three tables by ``stage``, ``id`` and ``n``, with ``reason`` and what a charge came to.

    The reason is ``upheld`` for a charge that is a finding, null for a defence or ruling that counts, else why the row is
    in no finding. All rows about a charge meet once, in one shuffle and one sort, whatever becomes of them.
    """
    said = F.trim(F.coalesce("defence", F.lit("")))
    none = F.lower(said).isin(*NO_DEFENCE)
    grave = F.upper(F.trim("severity"))
    sure = lambda c: ev.clamp(F.coalesce(c, F.lit(0.0)))
    row = lambda df, stage, n, *rest: df.select(F.lit(stage).alias("stage"), F.col("charge").alias("id"), n.cast("long").alias("n"), *rest)
    judged = row(judged_charges(charges, allowed, windows), "charge", F.lit(None), "window", "clause", "evidence", "s", "e", F.col("reason").alias("_bad"))
    defended = F.struct(F.when(~none, said).alias("defence"), F.when(none, 0.0).otherwise(sure("strength")).alias("strength"))
    ruled = F.struct(
        _verdict(F.col("verdict")).alias("verdict"), F.when(grave.isin(*ev.SEVERITIES), grave).otherwise(DEFAULT_SEVERITY).alias("severity"), sure("confidence").alias("confidence")
    )
    every = judged.unionByName(row(defences, "defence", F.col("n"), defended.alias("_defence")), allowMissingColumns=True)
    every = every.unionByName(row(rulings, "ruling", F.col("n"), ruled.alias("_ruling")), allowMissingColumns=True)
    # As many partitions as the session's: few bytes here are many rows, and a task sorts its own.
    dealt = every.repartition(int(charges.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    nth = F.row_number().over(Window.partitionBy("id", "stage").orderBy(F.desc("n"), "_defence", "_ruling"))
    counts = (nth == 1) & F.col("id").isNotNull()
    of_charge = Window.partitionBy("id")
    stands = (F.col("stage") == "charge") & F.col("_bad").isNull() & F.col("id").isNotNull()
    told = lambda c: F.first(F.when(F.col("_counts"), F.col(c)), ignorenulls=True).over(of_charge)
    met = dealt.withColumn("_counts", counts).select(
        "stage", "id", "n", "window", "clause", "evidence", "s", "e", "_bad", "_counts", F.bool_or(stands).over(of_charge).alias("_known"), told("_defence").alias("_d"), told("_ruling").alias("_r")
    )
    verdict = F.col("_r.verdict")
    fate = F.when(F.col("_bad").isNotNull(), F.col("_bad")).when(verdict.isNull(), "not ruled").when(verdict == "DISMISSED", "dismissed").otherwise("upheld")
    unused = F.when(~F.col("_known"), "no such charge").when(~F.col("_counts"), "answered again")
    strength = F.coalesce("_d.strength", F.lit(0.0))
    return met.select(
        "stage", "id", "n", F.when(F.col("stage") == "charge", fate).otherwise(unused).alias("reason"), "window", "clause", "evidence", "s", "e",
        F.col("_d.defence").alias("defence"), strength.alias("strength"), F.col("_r.severity").alias("severity"), F.col("_r.confidence").alias("confidence"),
    )


def adjudicate(charges: DataFrame, allowed: DataFrame, windows: DataFrame, defences: DataFrame, rulings: DataFrame) -> Outcome:
    """Findings (charge, window, clause, evidence, s, e, defence, strength, severity, confidence) and rejects.

    ``defences(charge, n, defence, strength)``, ``rulings(charge, n, verdict, severity, confidence)``: of several about one
    charge the last by ``n`` counts.
    """
    every = answers(charges, allowed, windows, defences, rulings)
    findings = every.filter("reason = 'upheld'").select(F.col("id").alias("charge"), "window", "clause", "evidence", "s", "e", "defence", "strength", "severity", "confidence")
    return Outcome(findings, every.filter("reason <> 'upheld'").select("stage", "id", "n", "reason"))
