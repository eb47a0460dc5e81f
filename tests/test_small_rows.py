"""Expressions and joins that no query stands for, against plain models or by example."""

import json
import random

import pytest
from pyspark.sql import functions as F

from evidra.functions import evidence as ev
from evidra.functions import text as tx
from evidra.operators import context, detectors, retrieval, stores
from evidra.sources.readers import repair_json

ANSWERS = [
    ('{"a": 1}', {"a": 1}),
    ('Sure! Here it is:\n```json\n{"a": [1, 2,], "b": {"c": null,},}\n```\nAnything else?', {"a": [1, 2], "b": {"c": None}}),
    ("[1, 2, 3]", [1, 2, 3]),
    ("no json here", None),
    ("", None),
    ('{"a": 1', None),
]


@pytest.mark.parametrize("text, wanted", ANSWERS)
def test_json_of_chatty_answers(spark, text, wanted):
    found = spark.createDataFrame([(text,)], "t string").select(repair_json("t").alias("j")).first().j
    assert (None if found is None else json.loads(found)) == wanted


def values(spark, schema, rows, **columns):
    out = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, " + schema).select("k", *(c.alias(n) for n, c in columns.items())).orderBy("k").collect()
    return [tuple(r)[1:] for r in out]


def test_bands_and_tiers(spark):
    rows = [(c,) for c in (0.0, 0.74, 0.75, 0.8, 0.89, 0.9, 0.95, 0.951, 0.98, 1.0)]
    found = values(spark, "c double", rows, band=ev.confidence_band(F.col("c")), track=ev.track_band(F.col("c")))
    band = lambda c: "VERY_HIGH" if c >= 0.98 else "HIGH" if c >= 0.9 else "MEDIUM" if c >= 0.8 else "LOW"
    track = lambda c: "VERY_HIGH" if c > 0.95 else "HIGH" if c >= 0.9 else "MEDIUM" if c >= 0.75 else "LOW"
    assert found == [(band(c), track(c)) for (c,) in rows]
    minutes = [(m,) for m in (0, 1, 2, 9, 10, 29, 30, 59, 60, 500)]
    tiers = values(spark, "m long", minutes, tier=ev.duration_tier(F.col("m") * 60_000))
    assert [t for (t,) in tiers] == ["short"] * 2 + ["standard"] * 2 + ["long"] * 2 + ["feature"] * 2 + ["archive"] * 2


def test_scopes_agents_and_clamps(spark):
    spans = [(0, 90, 100), (0, 89, 100), (10, 100, 100), (0, 0, 0), (0, 10, -5)]
    found = values(spark, "s long, e long, d long", spans, whole=ev.is_file_scoped(F.col("s"), F.col("e"), F.col("d")))
    assert [w for (w,) in found] == [True, False, True, False, False]
    assert values(spark, "m map<string,double>", [({"speech": 0.5, "ocr": 0.0, "vision": 0.1},), ({},)], a=F.array_sort(ev.active(F.col("m")))) == [(["speech", "vision"],), ([],)]
    assert values(spark, "x double", [(-1.0,), (0.3,), (7.0,)], c=ev.clamp(F.col("x"))) == [(0.0,), (0.3,), (1.0,)]


def test_plain_forms(spark):
    rows = [("  “Don't—STOP!”  ",), ("a.b,c",), ("...",), (None,)]
    assert values(spark, "t string", rows[1:], p=tx.plain_token(F.col("t"))) == [("abc",), ("",), (None,)]
    assert values(spark, "t string", [("  Many \t\n spaces  HERE ",), ("",)], p=tx.plain_text(F.col("t"))) == [("many spaces here",), ("",)]


def test_rerank(spark):
    hits = spark.createDataFrame([(1, 10, 0), (1, 11, 1), (1, 12, 2), (2, 10, 0), (2, 13, 1)], "qid int, id int, rank int")
    scores = spark.createDataFrame([(1, 12, 0.9), (1, 11, 0.1), (2, 10, 0.5), (3, 10, 1.0)], "qid int, id int, external double")
    found = {(r.qid, r.id): r["rank"] for r in retrieval.rerank(hits, scores).collect()}
    assert found == {(1, 12): 0, (1, 11): 1, (1, 10): 2, (2, 10): 0, (2, 13): 1}


def test_ranked_keeps_the_best(spark):
    pick = random.Random(1)
    rows = [(q, i, pick.choice([0.0, 1.0, 2.0, 5.0])) for q in range(4) for i in range(30)] + [(9, 1, 0.0)]
    df = spark.createDataFrame(rows, "qid int, id int, score double").repartition(5)
    for floor in (None, 0.35):
        found = {(r.qid, r.id): r["rank"] for r in retrieval.ranked(df, 7, floor).collect()}
        wanted = {}
        for q in {r[0] for r in rows}:
            order = sorted((-s, i) for x, i, s in rows if x == q)
            best = -order[0][0]
            wanted |= {(q, i): n for n, (s, i) in enumerate(order[:7]) if floor is None or (best > 0 and -s > best * floor)}
        assert found == wanted


def test_access_findings(spark):
    rows = [("ok", 60_000, True, True, 150.0, 0, 0, 0), ("all", 500_000, False, False, 200.0, 3, 1_500, 6_000), ("edge", 480_000, True, False, 180.0, 2, 1_499, 5_999)]
    df = spark.createDataFrame(rows, "clip string, duration_ms long, captions boolean, chapters boolean, wpm double, flashes int, black_ms long, frozen_ms long")
    found = {(r.clip, r.clause): r.severity for r in detectors.access_findings(df).collect()}
    assert found == {("all", "ACC-01"): "MEDIUM", ("all", "ACC-02"): "LOW", ("all", "ACC-03"): "LOW", ("all", "ACC-04"): "HIGH", ("all", "VID-01"): "LOW", ("all", "VID-02"): "MEDIUM", ("edge", "ACC-04"): "MEDIUM"}


def test_sane_charges(spark):
    charges = spark.createDataFrame([(1, "A", "said", -50, 5_000), (1, "B", "said", 0, 10), (1, "A", "  ", 0, 10), (2, "A", "said", 1_400, 1_450), (7, "A", "said", 0, 1)], "window int, clause string, evidence string, s long, e long")
    allowed = spark.createDataFrame([(1, "A"), (1, "A"), (2, "A"), (7, "A")], "window int, clause string")
    windows = spark.createDataFrame([(1, 0, 1_000), (2, 500, 1_500)], "id int, s long, e long")
    found = {(r.window, r.clause): (r.s, r.e) for r in context.sane_charges(charges, allowed, windows).collect()}
    assert found == {(1, "A"): (0, 1_000), (2, "A"): (1_400, 1_600)}


@pytest.mark.parametrize("baseline, batch", [(1, 3), (5, 4), (100, 7)])
def test_select_frames(spark, baseline, batch):
    pick = random.Random(baseline)
    frames = [(v, k, k * 100) for v in range(2) for k in range(40 + v)]
    flagged = [(v, s, s + pick.randrange(0, 500)) for v in range(2) for s in (pick.randrange(4_000) for _ in range(4))]
    out = context.select_frames(spark.createDataFrame(frames, "video int, frame int, ts long"), spark.createDataFrame(flagged, "video int, s long, e long"), ["video"], baseline, batch)
    wanted = {}
    for v in range(2):
        own = [f for f in frames if f[0] == v]
        step = max(1, len(own) // baseline)
        chosen = [f[1] for n, f in enumerate(own) if n % step == 0 or any(x == v and s <= f[2] <= e for x, s, e in flagged)]
        wanted |= {(v, f): n // batch for n, f in enumerate(chosen)}
    assert {(r.video, r.frame): r.batch for r in out.collect()} == wanted


@pytest.mark.parametrize("merged", [1, 2, 50])
def test_deep_trees_merge_their_levels(spark, monkeypatch, merged):
    monkeypatch.setattr(stores, "LEVELS", merged)
    pick = random.Random(merged)
    edges = {(k, k + 1) for k in range(9)} | {(pick.randrange(10), pick.randrange(10)) for _ in range(6)}
    found = {(r.node, r.root): r.level for r in stores.tree(spark.createDataFrame(sorted(edges), "parent long, node long"), spark.createDataFrame([(0,), (5,)], "node long")).collect()}
    wanted = {}
    for root in (0, 5):
        level, seen = [root], {root: 0}
        while level:
            level = sorted({b for a, b in edges if a in level and b not in seen})
            seen |= dict.fromkeys(level, max(seen.values()) + 1)
        wanted |= {(n, root): k for n, k in seen.items()}
    assert found == wanted


def test_cue_files(spark, tmp_path):
    from evidra.sources import readers

    cues = {"_note": "x", "verbs": ["Said", " in  HIS words ", ""], "limit_ms": 20000, "on": True, "groups": {"teach": ["In this lesson"], "warn": ["never do this", "danger"]}, "empty": [], "odd": None, "share": 0.5}
    (tmp_path / "cues.json").write_text(json.dumps(cues, indent=1))
    found = [(r.file, r["list"], r.place, r.phrase, r.n) for r in readers.cue_lists(spark, f"{tmp_path}/cues.json").orderBy("list", "place").collect()]
    assert found == [("cues.json", "groups.teach", 0, "in this lesson", 3), ("cues.json", "groups.warn", 0, "never do this", 3), ("cues.json", "groups.warn", 1, "danger", 1), ("cues.json", "verbs", 0, "said", 1), ("cues.json", "verbs", 1, "in his words", 3)]
    assert {r.name: r.value for r in readers.cue_settings(spark, f"{tmp_path}/cues.json").collect()} == {"limit_ms": "20000", "on": "true", "share": "0.5"}
    (tmp_path / "roles.json").write_text(json.dumps({"roles": {"caption": {"min_y": 0.7, "max_frames": 3, "note": "x"}, "none": {}}, "other": 1}))
    assert {(r.role, r.rule): r.value for r in readers.role_rules(spark, f"{tmp_path}/roles.json").collect()} == {("caption", "min_y"): 0.7, ("caption", "max_frames"): 3.0}
    (tmp_path / "roles.json").write_text("{}")
    assert readers.role_rules(spark, f"{tmp_path}/roles.json").count() == 0


def test_declared_context(spark):
    charges = spark.createDataFrame([(1, 10), (1, 11), (2, 12), (3, 13), (4, 14)], "entity int, charge int")
    declared = spark.createDataFrame([(1, "Gaming", "teens"), (2, None, "kids"), (3, " ", None)], "entity int, category string, audience string")
    found = {r.charge: r.video_context for r in context.declared_context(charges, declared).collect()}
    assert found == {10: 'video metadata: declared category "Gaming", declared audience "teens"', 11: 'video metadata: declared category "Gaming", declared audience "teens"', 12: 'video metadata: declared audience "kids"', 13: None, 14: None}
