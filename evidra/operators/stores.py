"""Append-only tables: latest per key, set differences, snapshots' diffs, state machines and trees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.session import discard, materialise

# The states that a remediation may go to from each state; FAILED is open from any that isn't final.
TRANSITIONS = {
    "ANALYSIS_COMPLETE": ("SIMULATION_READY", "REMEDIATION_REQUESTED"),
    "SIMULATION_READY": ("SIMULATING", "REMEDIATION_REQUESTED"),
    "SIMULATING": ("SIMULATED",),
    "SIMULATED": ("SIMULATING", "REMEDIATION_REQUESTED"),
    "REMEDIATION_REQUESTED": ("RENDERING",),
    "RENDERING": ("RENDERED",),
    "RENDERED": ("STRUCTURAL_VERIFYING",),
    "STRUCTURAL_VERIFYING": ("STRUCTURALLY_VALID",),
    "STRUCTURALLY_VALID": ("REANALYSIS_QUEUED",),
    "REANALYSIS_QUEUED": ("REANALYSING",),
    "REANALYSING": ("REANALYSIS_COMPLETE", "INCONCLUSIVE"),
    "REANALYSIS_COMPLETE": ("COMPARING",),
    "COMPARING": ("VERIFIED", "PARTIALLY_REMEDIATED", "NEW_RISK_DETECTED", "NO_CHANGE", "INCONCLUSIVE"),
}
FINAL = ("VERIFIED", "PARTIALLY_REMEDIATED", "NEW_RISK_DETECTED", "NO_CHANGE", "INCONCLUSIVE", "FAILED")


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of greatest ``order`` of each key; only one aggregate, so partial maxima meet, not rows."""
    last = rows.groupBy(key).agg(F.max(F.struct(order, *(c for c in rows.columns if c not in (key, order)))).alias("last"))
    return last.select(key, "last.*")


def affected(rows: DataFrame, links: DataFrame, changed: DataFrame, key: str, on: str) -> DataFrame:
    """Rows that a link ties to something that changed."""
    return rows.join(links.join(changed, on, "left_semi").select(key), key, "left_semi")


def near_misses(considered: DataFrame, fired: DataFrame, keys: list[str]) -> DataFrame:
    """What was considered and did not fire, once each."""
    return considered.select(*keys).distinct().join(fired, keys, "left_anti")


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    """ADDED, REMOVED and MODIFIED keys of two snapshots; equal digests are no change."""
    joined = before.select(key, F.col(digest).alias("old")).join(after.select(key, F.col(digest).alias("new")), key, "full")
    kind = F.when(F.col("old").isNull(), "ADDED").when(F.col("new").isNull(), "REMOVED").when(F.col("old") != F.col("new"), "MODIFIED")
    return joined.select(key, kind.alias("kind")).filter("kind is not null")


def clause_drift(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """``key``, kind, delta and n of the clauses (key, text, vector) whose texts differ between two snapshots.

    ``delta`` is one less the cosine of the vectors, 1 where only one snapshot has the clause or a vector has no length;
    ``n`` is its place by kind, then by delta from the largest. Only changes are ordered, and those are few.
    """
    old = before.select(key, F.col("text").alias("old"), F.col("vector").alias("v"))
    joined = old.join(after.select(key, F.col("text").alias("new"), F.col("vector").alias("w")), key, "full").filter(~F.col("old").eqNullSafe(F.col("new")))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    cosine = F.try_divide(dot("v", "w"), F.sqrt(dot("v", "v")) * F.sqrt(dot("w", "w")))
    kind = F.when(F.col("old").isNull(), "ADDED").when(F.col("new").isNull(), "REMOVED").otherwise("MODIFIED")
    out = joined.select(key, kind.alias("kind"), F.greatest(F.coalesce(1 - cosine, F.lit(1.0)), F.lit(0.0)).alias("delta"))
    place = F.when(F.col("kind") == "ADDED", 0).when(F.col("kind") == "MODIFIED", 1).otherwise(2)
    return numbered(out, "n", place, F.desc("delta"), key)


def numbered(rows: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """Rows with their place in a total order, from 1: sorted by ranges over all tasks, each task numbers its own rows.

    What is added to a task's numbers is the rows of the ranges before it, one sum for each range.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    own = dealt.withColumn("_range", F.spark_partition_id()).withColumn("_own", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    written = materialise(own, "numbered")  # ranges are drawn anew each time a plan runs
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = written.groupBy("_range").agg(F.count("*").alias("_size")).withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    return written.join(sizes.select("_range", "_before"), "_range").withColumn(name, F.col("_before") + F.col("_own") + 1).drop("_range", "_own", "_before")


def routes(start: str) -> dict[str, list[str]]:
    """The shortest legal route from a state to each that it can reach, of equal ones the first by name; the graph is fixed."""
    found, level = {start: [start]}, [start]
    while level:
        level = [found.setdefault(t, [*found[s], t])[-1] for s in level for t in sorted({*TRANSITIONS.get(s, ()), *(() if s in FINAL else ("FAILED",))}) if t not in found]
    return found


def roster_problems(agents: DataFrame) -> DataFrame:
    """agent, parent and problem of the declared ``agents(agent, tier, kind, prompt, capability, parents)``.

    A parent must be declared and of a lower tier; agents driven by a model need a prompt, deterministic ones no capability.
    """
    each = agents.select("agent", "tier", F.explode("parents").alias("parent"))
    known = each.join(agents.select(F.col("agent").alias("parent"), F.col("tier").alias("above")), "parent", "left")
    edge = F.when(F.col("above").isNull(), "unknown parent").when(F.col("above") >= F.col("tier"), "parent not of a lower tier")
    own = F.when((F.col("kind") != "deterministic") & (F.coalesce("prompt", F.lit("")) == ""), "no prompt").when((F.col("kind") == "deterministic") & (F.col("capability") != "none"), "deterministic with a capability")
    found = known.select("agent", "parent", edge.alias("problem")).union(agents.select("agent", F.lit(None).cast("string"), own))
    return found.filter("problem is not null")


def changed_sections(before: Column, after: Column) -> Column:
    """Names in either map whose values differ; a name that only one has differs."""
    names = F.array_union(F.map_keys(before), F.map_keys(after))
    return F.array_sort(F.filter(names, lambda k: ~F.try_element_at(before, k).eqNullSafe(F.try_element_at(after, k))))


def legal(from_state: Column, to_state: Column) -> Column:
    """Whether the graph of states has the step; nulls have none."""
    ok = F.lit(False)
    for state, targets in TRANSITIONS.items():
        ok = ok | ((from_state == state) & to_state.isin("FAILED", *targets))
    return F.coalesce(ok, F.lit(False))


def accepted_transitions(history: DataFrame, requests: DataFrame, key: str, order: str) -> DataFrame:
    """The rows (key, from_state, to_state) to append for ``requests(key, to_state)``: those legal from the key's latest state."""
    now = latest(history.select(key, order, F.col("to_state").alias("from_state")), key, order)
    return requests.join(now.select(key, "from_state"), key).filter(legal(F.col("from_state"), F.col("to_state"))).select(key, "from_state", "to_state")


def new_artifacts(stored: DataFrame, offered: DataFrame, digest: str) -> DataFrame:
    """The offered rows to append to a store by content: one, the least by all columns, for each digest that it doesn't have."""
    rest = [c for c in offered.columns if c != digest]
    first = offered.groupBy(digest).agg(F.min(F.struct(*rest)).alias("row")).select(digest, "row.*").select(*offered.columns)
    return first.join(stored.select(digest), digest, "left_anti").select(*offered.columns)


def illegal_transitions(history: DataFrame) -> DataFrame:
    """Rows whose (from_state, to_state) the graph doesn't have."""
    return history.filter(~legal(F.col("from_state"), F.col("to_state")))


def tree(edges: DataFrame, roots: DataFrame, depth: int | None = None) -> DataFrame:
    """node, root and level of all descendants of the roots, level by level; each level joins only the last one.

    Levels are written as they are found, until one is empty or ``depth`` is reached; every ``LEVELS`` of them are written
    as one table again, so what a level is compared with stays few tables. A node that a root reaches again is not followed,
    so cycles end.
    """
    level = materialise(roots.select(F.col("node"), F.col("node").alias("root"), F.lit(0).alias("level")), "tree")
    parts, k = [level], 0
    while (depth is None or k < depth) and level.head(1):
        k += 1
        below = level.select(F.col("node").alias("parent"), "root").join(edges, "parent").select("node", "root", F.lit(k).alias("level")).distinct()
        level = materialise(below.join(_union(parts).select("node", "root"), ["node", "root"], "left_anti"), "tree")
        parts.append(level)
        if len(parts) > LEVELS + 1:
            # The last level stays by itself, as the next one is made from it.
            whole = materialise(_union(parts[:-1]), "tree")
            for part in parts[:-1]:
                discard(part)
            parts = [whole, level]
    return _union(parts)


#: Levels of a tree that are kept as tables of their own.
LEVELS = 8


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)


def interrupted(history: DataFrame, key: str, order: str) -> DataFrame:
    """Keys whose latest state isn't final."""
    return latest(history, key, order).filter(~F.col("to_state").isin(*FINAL))


def next_id(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    """One row: the prefix with the greatest number after it plus one, of four digits at least."""
    number = F.regexp_extract(column, f"^{prefix}-([0-9]+)$", 1).try_cast("int")
    following = (F.coalesce(F.max(number), F.lit(0)) + 1).cast("string")
    padded = F.lpad(following, 4, "0")
    return rows.agg(F.concat(F.lit(f"{prefix}-"), F.when(F.length(following) < 4, padded).otherwise(following)).alias("next_id"))
