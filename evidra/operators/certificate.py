"""Certificates of verified remediations: their body from tables, and a seal over its content.

The body is one JSON object an entity. What was not measured says so in words instead of a number, so a reader never
takes a missing re-analysis for a score of zero. ``canonical`` writes any JSON object with its keys sorted at every depth
and without white space, so the digest doesn't depend on the order of columns, of keys or of a writer's spaces; fields
about the certificate itself (its id, its own digest, where it is stored) are no part of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields of a sealed certificate that its digest doesn't cover.
UNHASHED = ("certificateId", "certificateHash", "storedAt")
#: What stands for a number that nobody measured, and the coverage from which on absence means something.
NOT_MEASURED, LEAST_COVERAGE = "NOT MEASURED", 0.60
VERSION = "1.0"
STATUSES = ("NEW", "PERSISTS", "RESOLVED")


def canonical(body: Column, unhashed: tuple[str, ...] = UNHASHED) -> Column:
    """A JSON object's canonical text without the fields named; null where it isn't a JSON object, or repeats a key."""
    fields = F.when(F.try_parse_json(body).isNotNull(), F.from_json(body, "map<string, variant>"))
    kept = F.map_filter(fields, lambda k, _: ~k.isin(*unhashed))
    # A variant keeps an object's keys in order at every depth; a key's own quotes come from an array of it alone.
    quoted = lambda k: F.regexp_extract(F.to_json(F.array(k)), r"^\[(.*)\]$", 1)
    entry = lambda k: F.concat(quoted(k), F.lit(":"), F.coalesce(F.to_json(F.try_element_at(kept, k)), F.lit("null")))
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_keys(kept)), entry), ","), F.lit("}"))


def digest(body: Column, unhashed: tuple[str, ...] = UNHASHED) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(canonical(body, unhashed), 256))


def sealed(documents: DataFrame, number: Column) -> DataFrame:
    """``documents(…, body)`` with the certificate's id and digest put into the body, in front of its other fields."""
    own = F.to_json(F.struct(number.cast("string").alias("certificateId"), digest(F.col("body")).alias("certificateHash")))
    joined = F.concat(F.regexp_replace(own, r"\}$", ","), F.regexp_replace("body", r"^\s*\{", ""))
    return documents.withColumn("body", F.when(canonical(F.col("body")) == "{}", own).otherwise(joined))


def intact(body: Column) -> Column:
    """Whether a sealed certificate still is what was sealed; false for anything that has no digest or can't be read."""
    claimed = F.get_json_object(body, "$.certificateHash")
    return F.coalesce(claimed == digest(body), F.lit(False))


def _measured(value: Column, when: Column) -> Column:
    """A number as it is where it was measured, else the words for that; a variant holds either."""
    text = F.when(F.coalesce(when, F.lit(False)) & value.isNotNull(), value.cast("string"))
    return F.parse_json(F.coalesce(text, F.lit(f'"{NOT_MEASURED}"')))


def bodies(runs: DataFrame, changes: DataFrame, coverage: DataFrame, operations: DataFrame, key: str = "entity") -> DataFrame:
    """``key`` and body of each of ``runs``.

    * ``runs(key, issued_at, policy_version, lineage, original, predicted, actual, reanalysis_ok, structural_ok)``, one row
      a key; ``lineage`` is a struct of ids, scores may be null;
    * ``changes(key, clause, status)``: findings of both runs that were matched;
    * ``coverage(key, agent, coverage)`` of the second run, ``operations(key, op, start_ms, end_ms)`` that were rendered.

    Scores of the second run, and what was resolved, count only if the re-analysis succeeded. An agent that saw too little
    can't tell that anything is gone; such agents are listed, and stand in the limitations.
    """
    of = lambda status: F.array_sort(F.coalesce(F.filter(F.collect_list(F.when(F.col("status") == status, F.col("clause"))), lambda c: c.isNotNull())))
    matched = changes.groupBy(key).agg(F.struct(*(of(s).alias(s.lower()) for s in STATUSES)).alias("findings"))
    seen = coverage.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("agent", "coverage"))).alias("agents"))
    ops = operations.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("start_ms"), F.col("end_ms"), F.col("op")))).alias("ops"))
    every = runs.join(matched, key, "left").join(seen, key, "left").join(ops, key, "left")
    empty = F.array().cast("array<string>")
    found = {s.lower(): F.coalesce(F.col(f"findings.{s.lower()}"), empty) for s in STATUSES}
    agents = F.coalesce("agents", F.array().cast(seen.schema["agents"].dataType))
    gated = F.transform(F.filter(agents, lambda a: a["coverage"] < LEAST_COVERAGE), lambda a: a["agent"])
    ok, structural = F.coalesce("reanalysis_ok", F.lit(False)), F.coalesce("structural_ok", F.lit(False))
    limits = F.array_compact(
        F.array(
            F.when(~ok, "The remediated file was not analysed again: no score or removal was measured."),
            F.when(~structural, "The remediated file's structure was not verified."),
            F.when(F.size(gated) > 0, F.concat(F.lit("Too little was seen to tell absence: "), F.array_join(gated, ", "), F.lit("."))),
            F.when(F.col("predicted").isNull(), "No score was predicted."),
        )
    )
    body = F.struct(
        F.struct(agents.alias("byAgent"), gated.alias("gated")).alias("coverage"),
        F.struct(*(v.alias(k) for k, v in sorted(found.items()))).alias("findings"),
        F.col("issued_at").cast("string").alias("issuedAt"),
        limits.alias("limitations"),
        F.col("lineage"),
        F.coalesce("ops", F.array().cast(ops.schema["ops"].dataType)).alias("operations"),
        F.col("policy_version").alias("policyVersion"),
        F.struct(
            _measured(F.col("actual"), ok).alias("actual"),
            _measured(F.col("actual") - F.col("original"), ok).alias("delta"),
            F.col("original").alias("original"),
            F.col("predicted").alias("predicted"),
        ).alias("scores"),
        F.struct(ok.alias("reanalysis"), structural.alias("structural")).alias("verification"),
        F.lit(VERSION).alias("version"),
    )
    return every.select(key, F.to_json(body, {"ignoreNullFields": "false"}).alias("body"))
