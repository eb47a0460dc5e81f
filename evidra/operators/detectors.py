"""Findings from metric rows: sound, access and metadata rules, and simulated scenarios."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions import evidence as ev
from evidra.operators import remediation
from evidra.operators.sessions import merge_spans

# Loudness target and tolerance, and the limits of metadata.
TARGET_LUFS, TOLERANCE = -14.0, 2.0
MAX_TITLE, MIN_DESCRIPTION, MAX_TAGS = 70, 200, 15
SPONSORED = r"(?i)\b(sponsor(ed|ship)?|paid partnership|affiliate|promo code|use (my|the) code)\b"
# Hosts of links that earn a commission; a shop's product pages count too.
AFFILIATE_HOSTS = ("amzn.to", "awin1.com", "bit.ly", "geni.us", "impact.com", "ltk.app", "rstyle.me", "shareasale.com")
SHOP, PRODUCT = "amazon.", "dp"
DISCLOSED = r"(?i)(#ad\b|#sponsored\b|\bpaid promotion\b|\bincludes paid\b|\bdisclosure\b)"


def _rows(df: DataFrame, *rules: tuple[str, Column, Column]) -> DataFrame:
    """A row for each rule (clause, condition, severity) that holds."""
    found = F.array(*(F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(clause).alias("clause"), s.alias("severity"))) for clause, c, s in rules))
    return df.select(df.columns[0], F.inline(F.array_compact(found)))


def sound_findings(metrics: DataFrame) -> DataFrame:
    """``metrics(clip, lufs, clipped, spread_db, phase)``: loudness off target, clipping, uneven channels, cancelling phase."""
    off = F.abs(F.col("lufs") - TARGET_LUFS)
    return _rows(
        metrics,
        ("AUD-01", off > TOLERANCE, F.when(off >= 6, "MEDIUM").otherwise("LOW")),
        ("AUD-02", F.col("clipped") > 0.0001, F.lit("MEDIUM")),
        ("AUD-04", F.col("spread_db") >= 12, F.lit("MEDIUM")),
        ("AUD-05", F.col("phase") < 0.20, F.when(F.col("phase") < -0.10, "HIGH").otherwise("MEDIUM")),
    )


def access_findings(metrics: DataFrame) -> DataFrame:
    """``metrics(clip, duration_ms, captions, chapters, wpm, flashes, black_ms, frozen_ms)``"""
    return _rows(
        metrics,
        ("ACC-01", ~F.col("captions"), F.lit("MEDIUM")),
        ("ACC-02", F.col("wpm") > 180, F.lit("LOW")),
        ("ACC-03", (F.col("duration_ms") > 480_000) & ~F.col("chapters"), F.lit("LOW")),
        ("ACC-04", F.col("flashes") >= 2, F.when(F.col("flashes") >= 3, "HIGH").otherwise("MEDIUM")),
        ("VID-01", F.col("black_ms") >= 1_500, F.lit("LOW")),
        ("VID-02", F.col("frozen_ms") >= 6_000, F.lit("MEDIUM")),
    )


def capital_share(text: Column) -> Column:
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return F.when(letters >= 12, F.length(F.regexp_replace(text, r"[^\p{Lu}]", "")) / letters)


def affiliate_links(text: Column) -> Column:
    """Hosts in a text that pay for what is bought through them, and hosts of a shop before the path of a product."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\s/\"'<>()]+")
    of = lambda w, host: (w == host) | F.endswith(w, F.lit("." + host))
    known = lambda w: reduce(or_, (of(w, h) for h in AFFILIATE_HOSTS))
    shop = lambda w, i: w.rlike(rf"(^|\.){SHOP[:-1]}\.[a-z.]+$") & F.coalesce(F.get(parts, i + 1) == PRODUCT, F.lit(False))
    return F.filter(parts, lambda w, i: known(w) | shop(w, i))


def metadata_findings(items: DataFrame, most_tags: int = MAX_TAGS) -> DataFrame:
    """``items(clip, title, description, tags, spoken)``: shouting or long titles, thin descriptions, too many tags, undisclosed sponsors.

    Sponsors show by what is said, or by links in the description that earn a commission.
    """
    said = F.concat_ws(" ", "spoken", "description")
    return _rows(
        items,
        ("META-01", capital_share(F.col("title")) > 0.7, F.lit("LOW")),
        ("META-02", F.length("title") > MAX_TITLE, F.lit("LOW")),
        ("META-03", F.length(F.coalesce("description", F.lit(""))) < MIN_DESCRIPTION, F.lit("LOW")),
        ("META-04", F.size("tags") > most_tags, F.lit("LOW")),
        ("META-05", (said.rlike(SPONSORED) | (F.size(affiliate_links(F.col("description"))) > 0)) & ~said.rlike(DISCLOSED), F.lit("HIGH")),
    )


def event_summary(events: DataFrame, *keys: str) -> DataFrame:
    """``keys``, n and summary: how many events of each kind, by name, as ``kind n, kind n``."""
    kinds = events.groupBy(*keys, F.lower("kind").alias("kind")).agg(F.count("*").alias("n"))
    entry = F.concat("kind", F.lit(" "), F.col("n").cast("string"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("kind", entry.alias("entry")))), lambda x: x["entry"])
    return kinds.groupBy(*keys).agg(F.sum("n").alias("n"), F.array_join(listed, ", ").alias("summary"))


def merged_disclosures(hits: DataFrame, keys: list[str], gap_ms: int = 2_000) -> DataFrame:
    """Sensitive strings (keys, kind, redacted, start_ms, end_ms) that stay in sight: sightings at most ``gap_ms`` apart are one."""
    return merge_spans(hits, [*keys, "kind", "redacted"], gap_ms, ["start_ms", "end_ms"])


# Clause, title, severity and confidence of what is legible on screen; links are evidence and no finding.
LEGIBLE = {
    "credential": ("DISC-01", "Credential visible on screen", "CRITICAL", 0.95),
    "card": ("DISC-02", "Payment card visible on screen", "CRITICAL", 0.95),
    "email": ("DISC-02", "Email address visible on screen", "MEDIUM", 0.85),
    "phone": ("DISC-02", "Phone number visible on screen", "MEDIUM", 0.85),
}
SEEN_AS_TEXT = 0.95


def disclosure_findings(disclosures: DataFrame, *keys: str) -> DataFrame:
    """Findings (keys, clause, category, title, description, span, severity, confidence, modalities, suggested_fix) of disclosures.

    ``disclosures(keys, kind, label, redacted, start_ms, end_ms)``, each as long as it stays in sight; kinds that aren't
    reportable, such as links, give none.
    """
    reportable = disclosures.filter(F.col("kind").isin(*LEGIBLE))
    part = lambda i: ev.lookup({k: v[i] for k, v in LEGIBLE.items()}, F.col("kind"))
    return reportable.select(
        *keys, part(0).alias("clause"), F.lit("Metadata").alias("category"), part(1).alias("title"), F.concat("label", F.lit(" legible on screen ("), "redacted", F.lit(").")).alias("description"),
        "start_ms", "end_ms", part(2).alias("severity"), part(3).alias("confidence"), F.create_map(F.lit("ocr"), F.lit(SEEN_AS_TEXT)).alias("modalities"), F.lit("BLUR_REGION").alias("suggested_fix"),
    )


#: The scenarios that make a finding's fix: by itself, with all others, and with all as mutes or blurs.
USES = lambda: F.array(*(
    remediation.use(name, op) for name, op in (
        (F.concat(F.lit("fix "), F.col("id").cast("string")), F.col("op")), (F.lit("all fixes"), F.col("op")),
        (F.lit("all muted"), F.lit("MUTE")), (F.lit("all blurred"), F.lit("BLUR_REGION")),
    )
))


def _fixes(findings: DataFrame) -> DataFrame:
    return remediation.lower(findings).select("entity", "id", "op", F.col("s").alias("rs"), F.col("e").alias("re"))


def scenarios(findings: DataFrame) -> DataFrame:
    """Edits (scenario, entity, op, rs, re): each finding's own fix, all of them, and all as mutes or blurs."""
    return _fixes(findings).select("entity", "rs", "re", F.inline(USES())).select("scenario", "entity", "op", "rs", "re")


def explore(findings: DataFrame) -> DataFrame:
    """``simulate`` of all ``scenarios``, which share their spans: each is looked up once."""
    return simulate(findings, _fixes(findings), USES())


def simulate(findings: DataFrame, edits: DataFrame, uses: Column | None = None) -> DataFrame:
    """scenario, entity, overall after the edits, delta against none, impact, value and number of edits of each scenario.

    ``edits`` and ``uses`` as for ``remediation.weakened``.
    """
    # A dimension's score is a product over findings, so a scenario changes it by the quotients of the findings it touches:
    # the work grows with those, not with scenarios times findings.
    uses = F.array(remediation.use(F.col("scenario"), F.col("op"))) if uses is None else uses
    kept = lambda sure, severity="severity": F.log1p(-ev.finding_risk(F.col(severity), F.col("confidence"), F.col("start_ms"), F.col("end_ms"), sure))
    per_dimension = lambda value: [F.coalesce(F.sum(F.when(F.col("dimension") == d, F.col(value))), F.lit(0.0)).alias(f"{value} {d}") for d in ev.DIMENSION_WEIGHT]
    none = F.lit(None).cast("double")
    # What a finding counts without edits is worked out once, before it is repeated for each scenario.
    judged = findings.select("entity", "ord", "start_ms", "end_ms", "severity", "confidence", "modalities", ev.dimension_of(F.col("clause")).alias("dimension"), kept(none).alias("before"))
    base = judged.groupBy("entity").agg(*per_dimension("before"))
    change = F.when(F.col("survives"), kept(F.col("fused"), "new_severity")).otherwise(0.0) - F.col("before")
    changed = remediation.weakened(judged, edits, uses).select("scenario", "entity", "dimension", change.alias("change"), none.alias("cost"))
    cost = ev.lookup({k: v[0] for k, v in remediation.COST.items()}, F.col("op"), 0.05)
    made = edits.select("entity", F.inline(uses)).select("scenario", "entity", F.lit(None).cast("string").alias("dimension"), none.alias("change"), cost.alias("cost"))
    # Changes and costs of a scenario in one aggregate; one whose edits reach nothing has costs alone.
    sums = changed.union(made).groupBy("scenario", "entity").agg(*per_dimension("change"), F.sum("cost").alias("impact"), F.count("cost").alias("edits"))
    score = lambda logs: F.least(100 * F.exp(logs), F.lit(100.0))
    overall = lambda logs: ev.readiness({d: score(logs(d)) for d in ev.DIMENSION_WEIGHT})["overall"]
    before = base.select("*", overall(lambda d: F.col(f"before {d}")).alias("baseline"))
    out = sums.filter("scenario is not null").join(before, "entity").withColumn("overall", overall(lambda d: F.col(f"before {d}") + F.col(f"change {d}")))
    delta = F.col("overall") - F.col("baseline")
    value = F.when(delta > 0, delta / F.greatest("impact", F.lit(0.01))).otherwise(0.0)
    return out.select("scenario", "entity", "overall", delta.alias("delta"), "impact", value.alias("value"), "edits")


def best_within(simulated: DataFrame, ceiling: float = 0.45) -> DataFrame:
    """The scenario of most value that helps within the ceiling, of equal ones that of fewest edits; none where none helps."""
    fits = simulated.filter((F.col("delta") > 0) & (F.col("impact") <= ceiling))
    best = F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("value"), "edits", "scenario"))
    return fits.withColumn("n", best).filter("n = 1").drop("n")
