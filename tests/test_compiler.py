"""Compiled edit lists, scenes and speech contexts against plain models."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidra.operators import compiler, detectors, pictures, remediation, vocabulary

AUDIO = ("MUTE", "BLEEP", "REPLACE_AUDIO")
DURATION = 60_000


def snap(ops, words):
    for o in ops:
        inside = [w for w in words if w[0] < o["e"] and w[1] > o["s"]]
        if o["op"] in AUDIO and inside:
            o["s"], o["e"] = min(o["s"], min(w[0] for w in inside)), max(o["e"], max(w[1] for w in inside))
    return ops


def pad(ops, _):
    for o in ops:
        if o["op"] in AUDIO:
            o["s"], o["e"] = max(0, o["s"] - 60), min(DURATION, o["e"] + 80)
    return ops


def coalesce(ops, _):
    out = []
    for o in sorted(ops, key=lambda o: (o["op"], o["s"], o["id"])):
        if out and out[-1]["op"] == o["op"] and o["s"] - out[-1]["e"] < 400:
            out[-1]["e"] = max(out[-1]["e"], o["e"])
            out[-1]["findings"] = sorted(out[-1]["findings"] + o["findings"])
            out[-1]["id"] = out[-1]["findings"][0]
        else:
            out.append(o)
    return out


def without(ops, outer, inner):
    around = [o for o in ops if o["op"] == outer]
    return [o for o in ops if not (inner(o["op"]) and any(a["s"] <= o["s"] and o["e"] <= a["e"] for a in around))]


def dominance(ops, _):
    return without(ops, "CUT", lambda op: op != "CUT")


def conflicts(ops, _):
    return without(ops, "REPLACE_AUDIO", lambda op: op == "MUTE")


def budget(ops, _):
    cuts = [o for o in ops if o["op"] == "CUT"]
    total = sum(o["e"] - o["s"] for o in cuts)
    for o in sorted(cuts, key=lambda o: (-(o["e"] - o["s"]), o["s"], o["id"])):
        if total <= 0.08 * DURATION:
            break
        o["op"] = "MUTE"
        total -= o["e"] - o["s"]
    return ops


PASSES = [snap, pad, coalesce, dominance, conflicts, budget]


def model(rows, words, passes=PASSES):
    out = set()
    for entity in {r[0] for r in rows}:
        ops = [dict(id=r[1], op=r[4], s=r[2], e=r[3], findings=[r[1]]) for r in rows if r[0] == entity and r[4] in remediation.COST]
        for step in passes:
            ops = step(ops, [w[1:] for w in words if w[0] == entity])
        for n, o in enumerate(sorted(ops, key=lambda o: (o["s"], o["e"], o["id"])), 1):
            reason = "not positive" if o["e"] <= o["s"] else "too short" if o["e"] - o["s"] < 120 else "outside the file" if o["s"] < 0 or o["e"] > DURATION else None
            out.add((entity, n, o["id"], o["op"], o["s"], o["e"], tuple(o["findings"]), reason))
    return out


def some(seed):
    pick = random.Random(seed)
    rows = []
    for k in range(80):
        s = pick.randrange(0, DURATION - 500)
        rows.append((k % 3, k, s, s + pick.choice([0, 100, 119, 120, 500, 2_000, 4_000]), pick.choice([*remediation.COST, "CUT", "NONE", "ADD_CAPTIONS"])))
    words = [(e, t, t + 300) for e in range(2) for t in range(0, DURATION, 700)]
    return rows, words


def frames_of(spark, rows, words):
    f = spark.createDataFrame(rows, "entity long, ord long, start_ms long, end_ms long, suggested_fix string")
    return f, spark.createDataFrame(words, "entity long, start_ms long, end_ms long")


@pytest.mark.parametrize("seed", range(3))
def test_compiled_edits(spark, seed):
    rows, words = some(seed)
    f, w = frames_of(spark, rows, words)
    out = compiler.compile_edits(f, DURATION, w).collect()
    assert {(r.entity, r.n, r.id, r.op, r.s, r.e, tuple(r.findings), r.reason) for r in out} == model(rows, words)
    assert all((r.box is not None) == (r.op == "BLUR_REGION") and (r.asset is not None) == (r.op == "REPLACE_AUDIO") for r in out)


def test_the_order_of_passes_counts():
    rows, words = [], []
    for seed in range(6):
        more = some(seed)
        rows += [(r[0] + 3 * seed, r[1] + 100 * seed, *r[2:]) for r in more[0]]
        words += [(w[0] + 3 * seed, *w[1:]) for w in more[1]]
    right = model(rows, words)
    for a in range(len(PASSES) - 1):
        order = list(PASSES)
        order[a], order[a + 1] = order[a + 1], order[a]
        same = model(rows, words, order) == right
        assert same == (PASSES[a] in (dominance,)), PASSES[a].__name__  # only those two pass over other kinds


def test_strategies(spark):
    rows, _ = some(1)
    f = frames_of(spark, rows, [(0, 0, 1)])[0].select("*", F.lit("HIGH").alias("severity"), F.lit(0.9).alias("confidence"), F.create_map(F.lit("speech"), F.lit(0.9)).alias("modalities"))
    from evidra.operators import greedy

    chosen = {(r.entity, r.ord): r.op for r in greedy.choose_fixes(f.filter("suggested_fix <> 'NONE'"), "balanced").collect() if r.op}
    assert {(r.entity, r.id): r.op for r in compiler.lower(f, "balanced").collect()} == chosen
    assert {r.op for r in compiler.lower(f).collect()} <= set(remediation.COST)


def test_scenes_and_posters(spark):
    pick = random.Random(8)
    rows, clips, frames = [], [], []
    for clip in range(4):
        n = [1, 2, 30, 90][clip]
        clips.append((clip, n, n * 333 + 7))
        cuts = {pick.randrange(n) for _ in range(n // 12)}
        rows += [(clip, k, 90.0 if k in cuts else pick.choice([1.0, 2.0, 3.0])) for k in range(n - 1)]
        frames += [(clip, k, k * 333, float(pick.randrange(5)), float(pick.randrange(4))) for k in range(n)]
    d = spark.createDataFrame(rows, "clip long, n long, diff double")
    c = spark.createDataFrame(clips, "clip long, frames long, duration_ms long")
    f = spark.createDataFrame(frames, "clip long, n long, at_ms long, sharpness double, colourfulness double")
    found = pictures.scenes(d, c)
    lengths = {r.clip: (r.scenes, r.mean_ms, r.longest_ms, r.shortest_ms) for r in pictures.scene_lengths(found).collect()}
    posters = {(r.clip, r.scene): (r.most_colourful, r.sharpest, r.best) for r in pictures.scene_posters(f, found).collect()}
    for clip, n, duration in clips:
        diffs = [x[2] for x in rows if x[0] == clip]
        median = float(np.median(diffs)) if diffs else 0
        edges = sorted({0, duration, *(int(k * duration / n) for k, x in enumerate(diffs) if x > 4 * median and x > 8)})
        spans = list(zip(edges, edges[1:]))
        sizes = [b - a for a, b in spans]
        assert lengths[clip] == (len(sizes), sum(sizes) // len(sizes), max(sizes), min(sizes))
        for scene, (a, b) in enumerate(spans):
            own = [x for x in frames if x[0] == clip and a <= x[2] and (x[2] < b or scene == len(spans) - 1)]
            if not own:
                continue
            scale = lambda i, own=own: [(x[i] - min(y[i] for y in own)) / ((max(y[i] for y in own) - min(y[i] for y in own)) or 1) for x in own]
            sharp, colour = scale(3), scale(4)
            top = lambda values, own=own: own[int(np.argmax(values))][1]
            assert posters[clip, scene] == (top(colour), top(sharp), top([x * y for x, y in zip(sharp, colour)]))


def test_markers_and_condemnation(spark):
    def said(text, markers=("unquote", "in his words"), condemnations=("we condemn", "is wrong")):
        words = text.split()
        rows = [(1, k, w, 400 * k) for k, w in enumerate(words)]
        t = spark.createDataFrame(rows, "entity int, pos int, form string, start_ms long")
        out = vocabulary.event_context(t, ["entity"], ["said"], ["not"], ["danger"], markers=list(markers), condemnations=list(condemnations))
        (r,) = out.filter("form = 'X'").collect()
        return r.quoted, r.quoted_by, r.condemned_by

    filler = " ".join("abcdefgh")
    assert said("he said X") == (True, "said", None)
    assert said("in his words X") == (True, "in his words", None)
    assert said("X and so on unquote") == (True, "unquote", None)  # a marker after the event closes a quotation
    assert said("his words X in") == (False, None, None)
    assert said(f"in his words {filler} X") == (False, None, None)
    assert said(f"in his words {' '.join('abcde')} X") == (True, "in his words", None)
    assert said(f"X {filler} unquote") == (False, None, None)
    assert said(f"we condemn {filler} X") == (False, None, "we condemn")
    assert said("this is X wrong we say") == (False, None, "is wrong")  # both sides are read as one
    assert said(f"X {filler} {' '.join('ijklmn')} we condemn") == (False, None, None)
    assert said("said in his words X we condemn") == (True, "said", "we condemn")
    assert said("X") == (False, None, None)


def test_sentence_around(spark):
    pick = random.Random(2)
    rows = [(d, k, pick.choice(["a", "b", "c.", "d"] + ["e"] * 20) if d else "w") for d in range(3) for k in range(130)]
    out = {(r.d, r.pos): r.sentence for r in vocabulary.sentence_around(spark.createDataFrame(rows, "d int, pos int, w string"), ["d"]).collect()}
    for d in range(3):
        words = [w for x, _, w in rows if x == d]
        for index in range(len(words)):
            low = high = index
            while low > 0 and not words[low - 1].endswith((".", "?", "!")) and index - low <= 40:
                low -= 1
            while high < len(words) - 1 and not words[high].endswith((".", "?", "!")) and high - index <= 40:
                high += 1
            assert out[d, index] == " ".join(words[low : high + 1])


def test_disclosure_findings(spark):
    rows = [(1, k, "label", "abcd****", 0, 100) for k in ("credential", "card", "email", "phone", "url", "other")]
    out = {r.clause + r.title.split()[0]: r for r in detectors.disclosure_findings(spark.createDataFrame(rows, "entity int, kind string, label string, redacted string, start_ms long, end_ms long"), "entity").collect()}
    assert set(out) == {"DISC-01Credential", "DISC-02Payment", "DISC-02Email", "DISC-02Phone"}
    assert out["DISC-01Credential"].severity == "CRITICAL" and out["DISC-02Phone"].confidence == 0.85
    assert out["DISC-02Email"].description == "label legible on screen (abcd****)." and out["DISC-02Email"].modalities == {"ocr": 0.95}


def test_every_answer_is_used_or_rejected(spark):
    from evidra.operators import adjudication

    pick = random.Random(3)
    charges = [(k, pick.randrange(6), f"C{pick.randrange(4)}", pick.choice(["said so", "", None, "  "] + ["words"] * 6), pick.randrange(-500, 7_000), pick.choice([None, pick.randrange(0, 9_000)])) for k in range(120)]
    windows = [(w, w * 1_000, w * 1_000 + 1_500) for w in range(5)]
    allowed = [(w, f"C{c}") for w in range(6) for c in range(3)]
    defences = [(pick.randrange(140), n, pick.choice(["it is art", "None", " n/a ", None, "context"]), pick.choice([None, -1.0, 0.4, 3.0])) for n in range(90)]
    rulings = [(pick.randrange(140), n, pick.choice(["UPHELD", "dismissed", "Dis", None, "?"]), pick.choice(["high", "LOW", "odd", None]), pick.choice([None, 0.5, 7.0])) for n in range(130)]
    out = adjudication.adjudicate(
        spark.createDataFrame(charges, "charge long, window long, clause string, evidence string, s long, e long"), spark.createDataFrame(allowed, "window long, clause string"),
        spark.createDataFrame(windows, "window long, ws long, we long"), spark.createDataFrame(defences, "charge long, n long, defence string, strength double"),
        spark.createDataFrame(rulings, "charge long, n long, verdict string, severity string, confidence double"),
    )
    reasons, standing = {}, {}
    for charge, window, clause, evidence, s, e in charges:
        if window > 4:
            reasons["charge", charge, None] = "no such window"
        elif clause == "C3":
            reasons["charge", charge, None] = "clause not shown"
        elif not (evidence or "").strip():
            reasons["charge", charge, None] = "no evidence"
        else:
            ws, we = windows[window][1:]
            s = min(max(s, ws), we)
            standing[charge] = (window, clause, evidence, s, max(min(we if e is None else e, we), s + 200))
    used = {}
    for stage, rows in (("defence", defences), ("ruling", rulings)):
        used[stage] = {}
        for row in rows:
            last = max(r[1] for r in rows if r[0] == row[0])
            if row[0] not in standing:
                reasons[stage, row[0], row[1]] = "no such charge"
            elif row[1] < last:
                reasons[stage, row[0], row[1]] = "answered again"
            else:
                used[stage][row[0]] = row[2:]
    wanted = set()
    for charge, (window, clause, evidence, s, e) in standing.items():
        verdict, severity, sure = used["ruling"].get(charge, (0, 0, 0))
        if verdict == 0:
            reasons["charge", charge, None] = "not ruled"
        elif (verdict or "").upper().startswith("DIS"):
            reasons["charge", charge, None] = "dismissed"
        else:
            text, strength = used["defence"].get(charge, ("", 0))
            text = (text or "").strip()
            text = None if text.lower() in adjudication.NO_DEFENCE else text
            grave = (severity or "").upper()
            wanted.add((charge, window, clause, evidence, s, e, text, min(max(strength or 0.0, 0.0), 1.0) if text else 0.0, grave if grave in ("HIGH", "LOW") else "MEDIUM", min(max(sure or 0.0, 0.0), 1.0)))
    assert {tuple(r) for r in out.findings.collect()} == wanted and wanted
    rejects = out.rejects.collect()
    assert {(r.stage, r.id, r.n): r.reason for r in rejects} == reasons and len(rejects) == len(reasons)
    assert len(wanted) + sum(r.stage == "charge" for r in rejects) == len(charges)


def test_equal_and_nameless_answers_are_accounted_for(spark):
    """Of two answers of one number one counts and the other is rejected; one that names no charge is too, in one pass over the rows."""
    from evidra.operators import adjudication

    charges = spark.createDataFrame([(1, 1, "A-1", "x", 0, 500)], "charge long, window long, clause string, evidence string, s long, e long")
    allowed, windows = spark.createDataFrame([(1, "A-1")], "window long, clause string"), spark.createDataFrame([(1, 0, 1000)], "window long, ws long, we long")
    defences = spark.createDataFrame([(1, 1, "a", 0.5), (1, 1, "b", 0.5), (None, 1, "c", 0.5)], "charge long, n int, defence string, strength double")
    rulings = spark.createDataFrame([(1, 1, "uphold", "HIGH", 0.9)], "charge long, n int, verdict string, severity string, confidence double")
    out = adjudication.adjudicate(charges, allowed, windows, defences, rulings)
    assert out.findings.count() == 1
    assert sorted((r.stage, r.id or 0, r.reason) for r in out.rejects.collect()) == [("defence", 0, "no such charge"), ("defence", 1, "answered again")]


def test_numbers_over_ranges(spark):
    from evidra.operators import stores

    rows = spark.range(5000).select("id", (F.col("id") * 7919 % 13).alias("a")).repartition(6)
    out = [(r.n, r.a, r.id) for r in stores.numbered(rows, "n", F.desc("a"), "id").collect()]
    assert [x[1:] for x in sorted(out)] == sorted(((r.a, r.id) for r in rows.collect()), key=lambda r: (-r[0], r[1]))
    assert [x[0] for x in sorted(out)] == list(range(1, 5001))
    assert stores.numbered(rows.limit(0), "n", "id").count() == 0


@pytest.mark.parametrize("duration", [1, 29_999, 30_000, 30_001, 55_000, 62_000, 200_000])
def test_table_function_equals_bounds(spark, duration):
    from evidra.functions import windows
    from evidra.operators import intervals

    windows.register(spark)
    pick = random.Random(duration)
    rows = [(e, 0, s, min(duration, s + pick.randrange(1, 70_000))) for e in range(3) for s in [0, *(pick.randrange(duration) for _ in range(20))]]
    rows += [(e, 0, duration - 1, duration) for e in range(3)]
    spark.createDataFrame(rows, "entity long, turn long, start_ms long, end_ms long").createOrReplaceTempView("some_rows")
    out = {(r.entity, r.idx): (r.s, r.e, r.n) for r in spark.sql("SELECT * FROM sliding_windows(TABLE(some_rows) PARTITION BY (entity, turn) ORDER BY (start_ms), 30000, 5000)").collect()}
    bounds = intervals.window_bounds(spark.createDataFrame([(duration,)], "duration long"), 30_000, 5_000).collect()
    wanted = {(e, b.idx): (b.s, b.e, sum(r[0] == e and r[2] < b.e and r[3] > b.s for r in rows)) for e in range(3) for b in bounds}
    assert out == wanted


def test_affiliate_links(spark):
    cases = [("see https://amzn.to/abc", True), ("https://www.amazon.co.uk/dp/B01", True), ("amazon.com/gp/help", False), ("amazon.com dpx", False), ("http://shop.awin1.com/x", True), ("notbit.ly is none", False), ("BIT.LY/x", True), (None, False), ("dp amazon.de", False)]
    out = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "k int, t string").select("k", (F.size(detectors.affiliate_links(F.col("t"))) > 0).alias("hit")).orderBy("k").collect()
    assert [(cases[r.k][0], r.hit) for r in out] == cases
    items = spark.createDataFrame([(1, "T", "x" * 300 + " https://bit.ly/a", []), (2, "T", "x" * 300 + " https://bit.ly/a #ad", []), (3, "T", "x" * 300, [])], "clip int, title string, description string, tags array<string>").withColumn("spoken", F.lit(""))
    assert [(r.clip, r.clause) for r in detectors.metadata_findings(items).collect()] == [(1, "META-05")]


def test_alike_words_give_the_same_windows(spark):
    """Words drawn together where they touch the same windows, of any length and order of ends."""
    from evidra.functions import windows

    pick = random.Random(4)
    rows = [(e, 0, s, s + pick.choice([1, 40, 900])) for e in range(5) for s in (pick.randrange(4000) for _ in range(60))]
    words = spark.createDataFrame(rows, "entity long, turn long, start_ms long, end_ms long")
    windows.register(spark)
    alike = windows.alike_words(words, ["entity", "turn"], 300, 100)
    found = []
    for table in (words, alike):
        table.createOrReplaceTempView("drawn_words")
        found.append(sorted(map(tuple, spark.sql("SELECT * FROM sliding_windows(TABLE(drawn_words) PARTITION BY (entity, turn) ORDER BY (start_ms), 300, 100)").collect())))
    assert found[0] == found[1] and found[0] and alike.count() < len(rows)
