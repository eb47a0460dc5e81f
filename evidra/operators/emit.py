"""Results as documents: reports, static-analysis results, certificates, captions and render programs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.functions import evidence as ev
from evidra.functions import text as tx


def sarif_rules(findings: DataFrame, entity: str) -> DataFrame:
    """One rule for each clause of an entity, named after its first finding."""
    return findings.groupBy(entity, "clause").agg(F.min_by("category", "ord").alias("name"), F.min("ord").alias("first"))


def sarif(findings: DataFrame, entity: str) -> DataFrame:
    """One SARIF 2.1.0 document an entity; an entity's findings become one array, so it must be of an entity's size."""
    level = F.when(F.col("severity").isin("CRITICAL", "HIGH"), "error").when(F.col("severity") == "MEDIUM", "warning").otherwise("note")
    line = F.greatest(F.lit(1), F.floor(F.col("start_ms") / 1000))
    result = F.struct("ord", F.struct(F.col("clause").alias("ruleId"), level.alias("level"), F.struct(F.concat("category", F.lit(" at "), tx.timecode(F.col("start_ms"))).alias("text")).alias("message"), F.struct(line.alias("startLine")).alias("region")).alias("result"))
    results = findings.groupBy(entity).agg(F.transform(F.sort_array(F.collect_list(result)), lambda x: x["result"]).alias("results"))
    rule = F.struct("first", F.struct(F.col("clause").alias("id"), tx.rule_name(F.col("name")).alias("name")).alias("rule"))
    rules = sarif_rules(findings, entity).groupBy(entity).agg(F.transform(F.sort_array(F.collect_list(rule)), lambda x: x["rule"]).alias("rules"))
    run = F.struct(F.struct(F.struct(F.lit("evidra").alias("name"), F.col("rules")).alias("driver")).alias("tool"), F.col("results"))
    return results.join(rules, entity).select(entity, F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("sarif"))


def report(findings: DataFrame, entity: str, duration_ms: int) -> DataFrame:
    """One JSON report an entity: counts by severity, clauses, and its gravest findings first."""
    item = F.struct((-ev.rank_of(F.col("severity"))).alias("_r"), F.col("start_ms"), "ord", "end_ms", "clause", "category", "severity", "confidence")
    counts = [F.count_if(F.col("severity") == s).alias(s.lower()) for s in reversed(ev.SEVERITIES)]
    out = findings.groupBy(entity).agg(F.sort_array(F.collect_list(item)).alias("items"), F.array_sort(F.collect_set("clause")).alias("clauses"), *counts)
    found = F.transform("items", lambda x: x.dropFields("_r"))
    body = F.struct(F.array(F.lit("clauses")).alias("order"), "clauses", F.struct(*(s.lower() for s in reversed(ev.SEVERITIES))).alias("counts"), F.lit(duration_ms).alias("durationMs"), found.alias("findings"))
    return out.select(entity, F.to_json(body).alias("body"))


def release_certificate(findings: DataFrame, coverage: DataFrame, entity: str = "entity") -> DataFrame:
    """entity, body and hash: findings by severity, distinct clauses, what each agent covered, and the weights of the score.

    Keys stand in alphabetical order, so equal contents have equal hashes. Entities of ``coverage(entity, agent, coverage)``
    without findings have a certificate too.
    """
    counts = F.struct(*(F.count_if(F.col("severity") == s).alias(s) for s in sorted(ev.SEVERITIES)))
    found = findings.groupBy(entity).agg(F.array_sort(F.collect_set("clause")).alias("clauses"), counts.alias("severities"))
    covered = coverage.groupBy(entity).agg(F.array_sort(F.collect_list(F.struct("agent", "coverage"))).alias("covered"))
    none = F.struct(*(F.lit(0).cast("long").alias(s) for s in sorted(ev.SEVERITIES)))
    weights = F.struct(*(F.lit(w).alias(d) for d, w in sorted(ev.DIMENSION_WEIGHT.items())))
    every = covered.join(found, entity, "full")
    body = F.struct(
        F.coalesce("clauses", F.array().cast("array<string>")).alias("clauses"), F.coalesce("covered", F.array().cast(covered.schema["covered"].dataType)).alias("coverage"),
        F.coalesce("severities", none).alias("severities"), weights.alias("weights"),
    )
    return seal(every.select(entity, F.to_json(body).alias("body")))


def exit_code(verdict: Column) -> Column:
    """0 for a verdict that lets a file be published, else 1."""
    return F.when(F.coalesce(verdict.isin("READY_TO_PUBLISH", "PUBLISH_WITH_FIXES", "SAFE", "REVIEW"), F.lit(False)), 0).otherwise(1)


def seal(documents: DataFrame) -> DataFrame:
    """With the hash of the body, which ``broken_seals`` recomputes."""
    return documents.withColumn("hash", F.sha2("body", 256))


def broken_seals(sealed: DataFrame) -> DataFrame:
    return sealed.filter(F.sha2("body", 256) != F.col("hash"))


def captions(cues: DataFrame, keys: list[str], comma: bool = False) -> DataFrame:
    """SubRip (comma) or WebVTT text of each key's cues (n, start_ms, end_ms, text)."""
    sep = "," if comma else "."
    times = F.concat(tx.stamp(F.col("start_ms"), sep), F.lit(" --> "), tx.stamp(F.col("end_ms"), sep))
    cue = F.concat_ws("\n", F.col("n").cast("string"), times, "text")
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", cue.alias("c")))), lambda x: x["c"]), "\n\n")
    return cues.groupBy(*keys).agg((body if comma else F.concat(F.lit("WEBVTT\n\n"), body)).alias("captions"))


def render_program(ops: DataFrame, entity: str) -> DataFrame:
    """One filter expression an entity, operations in order of time; the picture is copied if no operation changes it."""
    t = lambda c: F.format_string("%.3f", F.col(c) / 1000)
    during = F.concat(F.lit("between(t,"), t("s"), F.lit(","), t("e"), F.lit(")"))
    step = F.when(F.col("op").isin("MUTE", "BLEEP", "REPLACE_AUDIO"), F.concat(F.lit("volume=0:enable='"), during, F.lit("'"))).when(F.col("op") == "BLUR_REGION", F.concat(F.lit("boxblur=20:enable='"), during, F.lit("'"))).otherwise(F.concat(F.lit("select='not("), during, F.lit(")'")))
    steps = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("s", "id", step.alias("f")))), lambda x: x["f"]), ",")
    return ops.groupBy(entity).agg(steps.alias("filters"), (~F.bool_or(F.col("op").isin("BLUR_REGION", "CUT"))).alias("copies_video"))
