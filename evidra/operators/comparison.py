"""What changed between two runs, how a run reads as claims, and how much work a file is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions import evidence as ev

MIN_COVERAGE = 0.5
SILENCE_FLOOR = 0.5


def verdicts(changes: DataFrame, coverage: DataFrame) -> DataFrame:
    """One verdict an entity from ``changes(entity, status, severity)`` and ``coverage(entity, seen)``, the gravest that holds.

    What was not looked at well enough is inconclusive, whatever seems resolved.
    """
    n = lambda c: F.count_if(c)
    new = F.col("status") == "NEW"
    c = changes.groupBy("entity").agg(
        n(F.col("status") == "RESOLVED").alias("resolved"), n(F.col("status") == "PERSISTS").alias("persisting"), n(new).alias("new"), n(new & F.col("severity").isin("CRITICAL", "HIGH")).alias("grave")
    )
    c = c.join(coverage, "entity", "left")
    blind = F.coalesce(F.col("seen"), F.lit(1.0)) < MIN_COVERAGE
    verdict = (
        F.when(F.col("grave") > 0, "NEW_RISK_DETECTED").when(blind, "INCONCLUSIVE").when((F.col("persisting") == 0) & (F.col("new") == 0), "VERIFIED_SAFE")
        .when(F.col("resolved") > 0, "PARTIALLY_REMEDIATED").when(F.col("new") > 0, "NEW_RISK_DETECTED").otherwise("NO_CHANGE")
    )
    return c.select("entity", "resolved", "persisting", "new", verdict.alias("verdict"))


def incident_changes(before: DataFrame, after: DataFrame, matches: DataFrame) -> DataFrame:
    """Incidents of the first run (entity, incident, ord) with the one of the second that most of their findings went to, ties to the least."""
    # ``before`` is read once: what it is made from may be costly. A finding that went nowhere has no counterpart and no vote.
    m = matches.filter("before is not null and after is not null").select("entity", F.col("before").alias("ord"), "after")
    b = after.select("entity", F.col("ord").alias("after"), F.col("incident").alias("counterpart"))
    went = before.select("entity", "ord", "incident").join(m, ["entity", "ord"], "left").join(b, ["entity", "after"], "left")
    votes = went.groupBy("entity", "incident", "counterpart").agg(F.count("*").alias("n"))
    vote = F.when(F.col("counterpart").isNotNull(), F.struct("n", -F.col("counterpart")))
    every = votes.groupBy("entity", "incident").agg(F.max_by("counterpart", vote).alias("counterpart"))
    return every.withColumn("status", F.when(F.col("counterpart").isNull(), "RESOLVED").otherwise("PERSISTS"))


def claims(findings: DataFrame) -> DataFrame:
    """entity, ord, step and text: each finding as sourced claims in a fixed order; empty claims are none."""
    steps = F.array(
        F.struct(F.lit(1).alias("n"), F.lit("OBSERVATION").alias("step"), F.concat("category", F.lit(" between "), F.col("start_ms").cast("string"), F.lit(" and "), F.col("end_ms").cast("string")).alias("text")),
        F.struct(F.lit(2).alias("n"), F.lit("EVIDENCE").alias("step"), F.array_join(F.array_sort(ev.active(F.col("modalities"))), ", ").alias("text")),
        F.struct(F.lit(3).alias("n"), F.lit("POLICY").alias("step"), F.col("clause").alias("text")),
        F.struct(F.lit(4).alias("n"), F.lit("SEVERITY").alias("step"), F.col("severity").alias("text")),
    )
    return findings.select("entity", "ord", F.inline(steps)).filter("text <> ''")


STEPS = ("OBSERVATION", "EVIDENCE", "POLICY", "SEVERITY", "DECISION")


def unsourced(claims: DataFrame) -> DataFrame:
    """``claims(step, text, ref)`` that must be refused, with the reason: empty, citing nothing, or of no known step."""
    blank = lambda c: F.coalesce(F.btrim(F.col(c), F.lit(" \t\n\r")), F.lit("")) == ""
    reason = F.when(blank("text"), "empty").when(blank("ref"), "cites nothing").when(~F.coalesce(F.col("step").isin(*STEPS), F.lit(False)), "unknown step")
    return claims.withColumn("reason", reason).filter("reason is not null")


def upheld(members: DataFrame) -> DataFrame:
    """Members (entity, incident, ord, verdict) of each incident that were not dismissed; all of one whose all were."""
    stands = ~F.coalesce(F.col("verdict") == "DISMISSED", F.lit(False))
    any_ = F.bool_or(stands).over(Window.partitionBy("entity", "incident"))
    return members.withColumn("_stands", stands).withColumn("_any", any_).filter(F.col("_stands") | ~F.col("_any")).drop("_stands", "_any")


def silent_agents(findings: DataFrame, agents: DataFrame) -> DataFrame:
    """Agents that saw nothing of an entity, by how much they covered: ``agents(entity, agent, coverage)``; none known is not run."""
    seen = findings.select("entity", F.explode(ev.active(F.col("modalities"))).alias("agent")).distinct()
    state = F.when(F.coalesce(F.col("coverage"), F.lit(0.0)) == 0, "NOT_RUN").when(F.col("coverage") < SILENCE_FLOOR, "TOO_LITTLE").otherwise("SILENT")
    return agents.join(seen, ["entity", "agent"], "left_anti").select("entity", "agent", state.alias("state"))


def predicted_outcome(predicted: DataFrame) -> DataFrame:
    """``predicted(entity, expected, actual)`` score changes as MATCHED within 2, CLOSE within 10, else BETTER or WORSE."""
    d = F.col("actual") - F.col("expected")
    return predicted.withColumn("outcome", F.when(F.abs(d) <= 2, "MATCHED").when(F.abs(d) <= 10, "CLOSE").when(d > 0, "BETTER").otherwise("WORSE"))


def work_plan(files: DataFrame, window_ms: int = 30_000, overlap_ms: int = 5_000, batch: int = 8) -> DataFrame:
    """Tier, windows and model calls of files (entity, duration_ms)."""
    step = window_ms - overlap_ms
    windows = F.when(F.col("duration_ms") <= 0, 0).otherwise(F.greatest(F.ceil((F.col("duration_ms") - window_ms) / step), F.lit(0)) + 1)
    return files.select("entity", ev.duration_tier(F.col("duration_ms")).alias("tier"), windows.cast("long").alias("windows"), F.ceil(windows / batch).cast("long").alias("calls"))
