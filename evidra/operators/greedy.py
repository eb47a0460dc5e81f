"""Scans whose state depends on what came before: one entity's rows in order, handed over one group at a time.

None of these can be combined in parts, so the rows that can meet must fit a task: an entity's, or those of them that
agree in a clause or kind as well. Spark deals them out. Inputs carry an ``ord`` column, which makes their order total.
What can be a join, a window or an aggregate is one elsewhere. ``OpenIncidents`` and ``OpenSightings`` are the state of
two of the scans, which their streaming twins keep between batches.
"""

from __future__ import annotations

import bisect
import functools

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.functions.evidence import SEVERITY_SCORE
from evidra.functions.text import plain_text
from evidra.operators.intervals import map_span
from evidra.operators.remediation import AUDIO, CEILING, COST
from evidra.operators.scans import scan_groups

# Categories that may be one incident with each category, and the bounds of an incident's confidence.
COMPATIBLE = {
    "Language": {"Language", "Violence", "Controversial", "Sensitive"},
    "Violence": {"Violence", "Language", "Sensitive"},
    "Controversial": {"Controversial", "Language", "Sensitive"},
    "Sensitive": {"Sensitive", "Language", "Violence", "Controversial"},
    "Substances": {"Substances", "Language", "Metadata"},
    "Metadata": {"Metadata", "Substances"},
    "Accessibility": {"Accessibility"},
    "Audio Delivery": {"Audio Delivery"},
    "Copyright": {"Copyright", "Audio Delivery"},
}
NEAR_MS, RECENT, STEP, MOST = 2_500, 4, 0.05, 0.97


def _per_entity(df: DataFrame, f, schema: str, order: list[str], *also: str) -> DataFrame:
    """``f`` of each entity's rows in order; of the rows that also agree in other columns, where only such rows meet."""
    return scan_groups(df, f, schema, ["entity", *also], order)


class OpenIncidents:
    """The latest incidents that a finding may still join, in order of span: [number, first finding, earliest end, latest start, kinds]."""

    def __init__(self, duration_ms: int = 0, share: float = 0.9, latest: list[list] | None = None):
        self.alone_ms = share * duration_ms if duration_ms > 0 else None
        self.latest = latest or []

    def take(self, ord_: int, start_ms: int, end_ms: int, clause: str, category: str) -> int:
        """The first finding of the incident that this one belongs to."""
        if self.alone_ms is not None and end_ms - start_ms >= self.alone_ms:
            return ord_

        def fits(incident: list) -> bool:
            _, _, ends, starts, kinds = incident
            near = max(start_ms - ends, starts - end_ms) <= NEAR_MS
            # A category that the table lacks goes with itself alone.
            return near and all(c == clause or category in COMPATIBLE.get(k, (k,)) for c, k in kinds)

        home = next((i for i in reversed(self.latest) if fits(i)), None)
        if home is None:
            made = self.latest[-1][0] + 1 if self.latest else 0
            home = [made, ord_, end_ms, start_ms, []]
            self.latest = [*self.latest, home][-RECENT:]
        home[2], home[3] = min(home[2], end_ms), max(home[3], start_ms)
        if [clause, category] not in home[4]:
            home[4].append([clause, category])
        return home[1]

    def closed_from(self) -> int:
        """The time from which on no finding that begins later can join any of them."""
        return max((i[2] + NEAR_MS for i in self.latest), default=0)


def incidents(findings: DataFrame, duration_ms: int, share: float = 0.9) -> DataFrame:
    """Findings with the number of their incident.

    In order of span each joins the latest of the last four incidents all of whose members are near and compatible;
    findings that span the file stand alone. Numbers follow the incidents' spans.
    """

    def scan(rows: list[tuple]) -> list[tuple]:
        latest = OpenIncidents(duration_ms, share)
        first = [latest.take(r.ord, r.start_ms, r.end_ms, r.clause, r.category) for r in rows]
        spans: dict[int, list] = {}
        for r, f in zip(rows, first, strict=True):  # in order of start, so an incident starts with its first row
            span = spans.setdefault(f, [r.start_ms, r.end_ms])
            if r.end_ms > span[1] or pd.isna(span[1]):
                span[1] = r.end_ms
        last = lambda x: (pd.isna(x), 0 if pd.isna(x) else x)
        number = {f: i for i, f in enumerate(sorted(spans, key=lambda f: (*map(last, spans[f]), f)), 1)}
        return [(r.entity, r.ord, number[f]) for r, f in zip(rows, first, strict=True)]

    return _per_entity(findings.select("entity", "ord", "start_ms", "end_ms", "clause", "category"), scan, "entity long, ord long, incident long", ["start_ms", "end_ms", "ord"])


def incident_summary(numbered: DataFrame) -> DataFrame:
    """entity, incident, its span, gravest severity, confidence, clauses and findings, from findings with their incident."""
    from evidra.functions.evidence import active, rank_of

    agents = F.array_sort(F.array_distinct(F.flatten(F.collect_set(active(F.col("modalities"))))))
    out = numbered.groupBy("entity", "incident").agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.max_by("severity", F.struct(rank_of(F.col("severity")), "confidence", -F.col("ord"))).alias("severity"),
        F.max("confidence").alias("peak"), agents.alias("agents"), F.array_sort(F.collect_set("clause")).alias("clauses"), F.array_sort(F.collect_list("ord")).alias("findings"),
    )
    sure = F.least(F.col("peak") + STEP * F.greatest(F.size("agents") - 1, F.lit(0)), F.greatest(F.lit(MOST), F.col("peak")))
    return out.withColumn("confidence", sure).drop("peak")


def dedupe_by_iou(candidates: DataFrame, floor: float = 0.5) -> DataFrame:
    """The surest first: one of the same clause that covers most of a kept one is absorbed, and the kept one's span grows."""

    def scan(rows: list[tuple]) -> list[list]:
        kept: list[list] = []
        for r in rows:
            for k in kept:
                both = min(k[3], r.end_ms) - max(k[2], r.start_ms)
                if both > 0 and both / (k[3] - k[2] + r.end_ms - r.start_ms - both) > floor:
                    k[2], k[3] = min(k[2], r.start_ms), max(k[3], r.end_ms)
                    break
            else:
                kept.append([r.entity, r.ord, r.start_ms, r.end_ms, r.clause])
        return kept

    ranked = candidates.selectExpr("entity", "ord", "start_ms", "end_ms", "clause", "-confidence as _c")
    return _per_entity(ranked, scan, "entity long, ord long, start_ms long, end_ms long, clause string", ["_c", "start_ms", "ord"], "clause")


def match_runs(before: DataFrame, after: DataFrame, floor: float = 0.3, tolerance_ms: int = 1_500, cuts: DataFrame | None = None) -> DataFrame:
    """Each finding of the first run with the first of the other that is the same problem and not yet taken.

    Same clause, and spans that overlap enough or both ends near. Leftovers of the second run are NEW. Where ``cuts(entity,
    cs, ce)`` were taken out between the runs, the first run's spans are mapped through them; one whose end was cut out
    matches nothing, so it is RESOLVED. Only findings within reach in time are looked at, by binary search.
    """
    if cuts is not None:
        spans = before.select(F.col("ord").alias("id"), "entity", F.col("start_ms").alias("s"), F.col("end_ms").alias("e"))
        mapped = map_span(spans, cuts, ["entity"]).select(F.col("id").alias("ord"), F.col("s").alias("start_ms"), F.col("e").alias("end_ms"))
        before = before.drop("start_ms", "end_ms").join(mapped, "ord", "left")
    both = before.withColumn("run", F.lit(0)).unionByName(after.withColumn("run", F.lit(1)), allowMissingColumns=True)

    def scan(rows: list[tuple]) -> list[tuple]:
        old, new, out = [r for r in rows if r.run == 0], [r for r in rows if r.run == 1], []
        entity = rows[0].entity
        by_start = sorted(range(len(new)), key=lambda i: new[i].start_ms)
        starts = [new[i].start_ms for i in by_start]
        longest = max((b.end_ms - b.start_ms for b in new), default=0)
        taken: set[int] = set()

        def same(a, b) -> bool:
            cut = max(0, min(a.end_ms, b.end_ms) - max(a.start_ms, b.start_ms))
            union = a.end_ms - a.start_ms + b.end_ms - b.start_ms - cut
            near = abs(a.start_ms - b.start_ms) <= tolerance_ms and abs(a.end_ms - b.end_ms) <= tolerance_ms
            return near or (union > 0 and cut / union >= floor)

        for a in old:
            hit = None
            if not pd.isna(a.start_ms) and not pd.isna(a.end_ms):
                low = bisect.bisect_left(starts, a.start_ms - max(longest, tolerance_ms))
                high = bisect.bisect_right(starts, max(a.end_ms, a.start_ms + tolerance_ms))
                hit = min((i for i in by_start[low:high] if i not in taken and same(a, new[i])), default=None)
            if hit is not None:
                taken.add(hit)
            out.append((entity, a.ord, None if hit is None else new[hit].ord, "RESOLVED" if hit is None else "PERSISTS"))
        return out + [(entity, None, b.ord, "NEW") for i, b in enumerate(new) if i not in taken]

    return _per_entity(both.select("entity", "ord", "start_ms", "end_ms", "clause", "run"), scan, "entity long, before long, after long, status string", ["run", "ord"], "clause")


def choose_fixes(findings: DataFrame, strategy: str = "balanced") -> DataFrame:
    """The gravest first: the best operation for each that still fits the file's budget of viewer impact, or none.

    What is seen at least as surely as it is heard or read can only be blurred or cut, all else only silenced or cut.
    """

    def gravest(r: tuple) -> tuple:
        sure = not pd.isna(r.confidence)
        return not sure, -SEVERITY_SCORE.get(r.severity, 0.0) * r.confidence if sure else 0.0, r.ord

    def scan(rows: list[tuple]) -> list[tuple]:
        spent, out = 0.0, []
        for r in sorted(rows, key=gravest):
            able = ("BLUR_REGION", "CUT") if r.seen else (*AUDIO, "CUT")
            fits = [(red - 0.6 * cost - 0.25 * video, op, cost) for op, (cost, video, red) in COST.items() if op in able and spent + cost <= CEILING[strategy]]
            best = max(fits, default=None)
            spent += best[2] if best else 0
            out.append((r.entity, r.ord, best[1] if best else None))
        return out

    others = F.map_values(F.map_filter("modalities", lambda k, _: k != "vision"))
    seen = F.coalesce(F.col("modalities")["vision"], F.lit(0.0)) >= F.coalesce(F.array_max(others), F.lit(0.0))
    return _per_entity(findings.select("entity", "ord", "severity", "confidence", seen.alias("seen")), scan, "entity long, ord long, op string", ["ord"])


def caption_cues(words: DataFrame, gap_ms: int = 700, most_ms: int = 6_000, most_words: int = 14, line: int = 42) -> DataFrame:
    """Words as cues of two lines at most: a new one after a gap, or where time, words or characters are full."""
    import textwrap

    def scan(rows: list[tuple]) -> list[tuple]:
        cues, cue = [], []
        for r in rows:
            full = cue and (r.start_ms - cue[-1].end_ms > gap_ms or r.end_ms - cue[0].start_ms > most_ms or len(cue) >= most_words or sum(len(c.w) + 1 for c in cue) + len(r.w) > 2 * line)
            if full:
                cues.append(cue)
                cue = []
            cue.append(r)
        cues += [cue] if cue else []
        ends = [min(c[-1].end_ms, n[0].start_ms) for c, n in zip(cues, cues[1:])] + [c[-1].end_ms for c in cues[-1:]]
        text = ["\n".join(textwrap.wrap(" ".join(x.w for x in c), line)) for c in cues]
        return [(rows[0].entity, rows[0].turn, n, c[0].start_ms, end, lines) for n, (c, end, lines) in enumerate(zip(cues, ends, text, strict=True), 1)]

    timed = words.select("entity", "turn", "pos", "w", "start_ms", "end_ms")
    return _per_entity(timed, scan, "entity long, turn long, n long, start_ms long, end_ms long, text string", ["pos"], "turn")


def _overlap(a: tuple, b: tuple) -> float:
    """Intersection over union of two boxes (x, y, w, h); 0 where either has no area."""
    w, h = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    both = max(w, 0.0) * max(h, 0.0)
    union = a[2] * a[3] + b[2] * b[3] - both
    return both / union if union > 0 else 0.0


def _around(a: tuple, b: tuple) -> tuple:
    x, y = min(a[0], b[0]), min(a[1], b[1])
    return x, y, max(a[0] + a[2], b[0] + b[2]) - x, max(a[1] + a[3], b[1] + b[3]) - y


@functools.lru_cache(1 << 16)
def _alike(a: str, b: str, floor: float) -> bool:
    """Similar by share of the longer, or within two edits if both have eight characters or more."""
    longest, shortest = max(len(a), len(b)), min(len(a), len(b))
    most = max(int((1 - floor) * longest + 1e-9), 2 if shortest >= 8 else 0)
    if longest - shortest > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return False
    return row[-1] <= most


class OpenSightings:
    """Clusters of sightings that were seen lately, in order of creation: [first sighting, text, its confidence, box, last seen]."""

    def __init__(self, floor: float = 0.85, overlap: float = 0.6, gap_ms: int = 5_000, active: list[list] | None = None):
        self.floor, self.overlap, self.gap_ms, self.active = floor, overlap, gap_ms, active or []

    def take(self, ord_: int, ts_ms: int, key: str, confidence: float, box: tuple) -> int:
        """The first sighting of the cluster that this one belongs to."""
        self.active = [c for c in self.active if ts_ms - c[4] <= self.gap_ms]
        home = next((c for c in self.active if _overlap(c[3], box) >= self.overlap and _alike(c[1], key, self.floor)), None)
        if home is None:
            home = [ord_, key, confidence, box, ts_ms]
            self.active.append(home)
        else:
            home[3] = _around(home[3], box)
            if confidence > home[2]:
                home[1], home[2] = key, confidence
        home[4] = ts_ms
        return home[0]


def cluster_sightings(sightings: DataFrame, floor: float = 0.85, overlap: float = 0.6, gap_ms: int = 5_000) -> DataFrame:
    """entity, ord and cluster of sightings (entity, ord, ts_ms, text, confidence, x, y, w, h) of texts on screen.

    In order of time and text each joins the first cluster, in order of creation, that was seen within ``gap_ms``, whose
    text is alike in normal form, and whose box overlaps its own. A cluster's box is around all its members', its text
    that of its surest one. Clusters out of reach in time are let go, so the work grows with what is on screen at once.
    """

    def scan(rows: list[tuple]) -> list[tuple]:
        seen, number = OpenSightings(floor, overlap, gap_ms), {}
        first = [seen.take(r.ord, r.ts_ms, r.key, r.confidence, (r.x, r.y, r.w, r.h)) for r in rows]
        return [(r.entity, r.ord, number.setdefault(f, len(number))) for r, f in zip(rows, first, strict=True)]

    keyed = sightings.select("entity", "ord", "ts_ms", "text", plain_text(F.col("text")).alias("key"), "confidence", "x", "y", "w", "h")
    return _per_entity(keyed, scan, "entity long, ord long, cluster long", ["ts_ms", "text", "ord"])


def accepted_after_gap(events: DataFrame, gap_ms: int) -> DataFrame:
    """Events at least ``gap_ms`` after the last one accepted."""

    def scan(rows: list[tuple]) -> list[tuple]:
        last, keep = None, []
        for r in rows:
            if last is None or r.ts_ms - last >= gap_ms:
                keep.append((r.entity, r.ord, r.ts_ms))
                last = r.ts_ms
        return keep

    return _per_entity(events.select("entity", "ord", "ts_ms"), scan, "entity long, ord long, ts_ms long", ["ts_ms", "ord"])


def nearest_unique(targets: DataFrame, frames: DataFrame) -> DataFrame:
    """Each target in order takes the nearest frame that none took before, the earlier of two as near."""
    both = targets.select("entity", F.col("ord"), "ts_ms", F.lit(0).alias("kind")).union(frames.select("entity", F.col("ord"), "ts_ms", F.lit(1).alias("kind")))

    def scan(rows: list[tuple]) -> list[tuple]:
        free = [(r.ts_ms, r.ord) for r in rows if r.kind == 1]  # in order
        out = []
        for t in (r for r in rows if r.kind == 0):
            after = bisect.bisect_left(free, (t.ts_ms,))
            # Of several frames at one time the first is taken, so the one before is the first of its time.
            beside = [bisect.bisect_left(free, (free[after - 1][0],))] if after else []
            beside += [after] if after < len(free) else []
            if beside:
                best = min(beside, key=lambda i: (abs(free[i][0] - t.ts_ms), free[i]))
                out.append((t.entity, t.ord, free.pop(best)[1]))
        return out

    return _per_entity(both, scan, "entity long, ord long, frame long", ["kind", "ts_ms", "ord"])


def spaced_samples(candidates: DataFrame, spacing_ms: int, budget: int, duration_ms: int) -> DataFrame:
    """Times of greatest priority first, kept apart; then the widest gaps are filled up to the budget."""

    def scan(rows: list[tuple]) -> list[tuple]:
        kept: list[int] = []
        for t in (r.ts_ms for r in rows):
            if len(kept) < budget and all(abs(t - k) >= spacing_ms for k in kept):
                kept.append(int(t))
        while len(kept) < budget:
            edges = [0, *sorted(kept), duration_ms]
            wide, at = max((b - a, -a) for a, b in zip(edges, edges[1:]))
            if wide < 2 * spacing_ms:
                break
            kept.append(-at + wide // 2)
        return [(rows[0].entity, t) for t in sorted(kept)]

    return _per_entity(candidates.select("entity", "ord", "ts_ms", "priority"), scan, "entity long, ts_ms long", ["priority", "ts_ms", "ord"])
