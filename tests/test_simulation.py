"""Scenarios of edits: those that share their spans give what the flat list of their edits gives, and each span is looked up once."""

import random

import pytest
from pyspark.sql import functions as F

from evidra.functions import evidence as ev
from evidra.operators import detectors, remediation
from evidra.plans import catalog
from evidra.sources.logical import findings

SF = "/root/testdata/sf0.001"
FINDING = "entity long, ord long, start_ms long, end_ms long, clause string, category string, severity string, confidence double, modalities map<string,double>"


def rounded(df):
    return sorted((r.scenario, r.entity, r.overall, r.delta, round(r.impact, 9), round(r.value, 9), r.edits) for r in df.collect())


def test_shared_spans_equal_the_flat_list(spark):
    f = findings(spark, SF)
    found = rounded(detectors.explore(f))
    assert found == rounded(detectors.simulate(f, detectors.scenarios(f))) and len(found) > f.count()


def test_table_is_read_a_few_times_only(spark):
    """Once each for the spans, the edits, what findings count, their costs and the base; it was once for each scenario and step."""
    plan = catalog.QUERIES["scenario_simulation"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("Relation [") <= 5


def test_findings_of_two_entities_with_one_number(spark):
    """An edit takes nothing from the finding of another entity that has the same number."""
    rows = [(entity, 7, 40_000 * entity, 40_000 * entity + 500, "AF-01", "Language", "HIGH", 0.9, {"speech": 0.9}) for entity in (1, 2)]
    f = spark.createDataFrame(rows, FINDING)
    edits = spark.createDataFrame([("one", 1, "MUTE", 40_000, 40_500), ("one", 2, "MUTE", 0, 10)], "scenario string, entity long, op string, rs long, re long")
    assert [(r.entity, r.ord, r.survives) for r in remediation.apply_edits(f, edits).collect()] == [(1, 7, False)]
    out = {r.entity: r for r in detectors.simulate(f, edits).collect()}
    assert out[1].overall == 100 and out[1].delta > 0 and out[2].delta == 0 and out[2].edits == 1 and out[2].impact == 0.25


def test_edits_without_effect_or_name(spark):
    """Unknown operations cost 0.05 and take nothing, edits of no scenario are left out, an entity without findings too."""
    f = spark.createDataFrame([(1, 0, 0, 60_000, "AF-01", "Language", "HIGH", 0.9, {"speech": 0.9, "odd": None})], FINDING)
    edits = [("a", 1, "UNKNOWN", 0, 10), ("b", 1, None, 0, 10), (None, 1, "MUTE", 0, 10), ("c", 9, "MUTE", 0, 10), ("d", 1, "MUTE", 60_250, 60_300), ("e", 1, "MUTE", 60_251, 60_300)]
    out = {r.scenario: r for r in detectors.simulate(f, spark.createDataFrame(edits, "scenario string, entity long, op string, rs long, re long")).collect()}
    assert sorted(out) == ["a", "b", "d", "e"]
    assert {k: r.delta > 0 for k, r in out.items()} == {"a": False, "b": False, "d": True, "e": False}
    assert out["a"].impact == out["b"].impact == 0.05 and all(r.edits == 1 for r in out.values())


def test_seen_without_what_is_lost(spark):
    pick, rows = random.Random(4), []
    for k in range(200):
        rows.append((k, {m: pick.choice([None, -0.5, 0.0, 0.2, 0.7, 1.0, 1.5]) for m in ("speech", "vision", "ocr", "other") if pick.random() < 0.8}, pick.choice([0, 1, 2, 3])))
    bit = lambda k: ev.lookup({"speech": 1, "ocr": 2}, k, 0)
    df = spark.createDataFrame(rows, "id long, m map<string,double>, lost int")
    out = {r.id: r.x for r in df.select("id", ev.seen(ev.parts(F.col("m"), bit=bit), F.col("lost")).alias("x")).collect()}
    weight = {"speech": 1.0, "vision": 0.85, "ocr": 0.8, "other": 0.5}
    for id_, m, lost in rows:
        left = {k: v for k, v in m.items() if v is not None and v > 0 and not {"speech": 1, "ocr": 2}.get(k, 0) & lost}
        miss = 1.0
        for k, v in left.items():
            miss *= 1 - weight[k] * min(v, 1.0)
        x = out[id_]
        assert (x.n, x.low, x.high, x.more) == (len(left), min(left.values(), default=None), max(left.values(), default=None), bool(left.keys() - {"vision"}))
        assert x.miss == pytest.approx(miss)
