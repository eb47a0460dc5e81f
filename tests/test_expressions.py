"""Golden values of single expressions."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evidra.functions import evidence as ev
from evidra.functions import text as tx


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def finding(**m):
    return F.create_map(*(F.lit(x) for kv in m.items() for x in kv))


def test_noisy_or(spark):
    assert round(one(spark, ev.noisy_or(finding(speech=0.8, vision=0.5))), 4) == 0.8850
    assert round(one(spark, ev.noisy_or(finding(speech=0.9, vision=0.9), finding(vision=0.42))), 4) == 0.9321
    assert one(spark, ev.noisy_or(finding(speech=1.0, vision=0.5))) == 1.0


@pytest.mark.parametrize("modalities, severity, rule, after", [
    (dict(speech=0.9, vision=0.3), "HIGH", "CONTRADICTION", "HIGH"), (dict(vision=0.7), "HIGH", "DEMOTE", "LOW"), (dict(speech=0.0), "HIGH", "DEMOTE", "LOW"),
    (dict(speech=0.8, vision=0.9), "MEDIUM", "PROMOTE", "HIGH"), (dict(speech=0.8, vision=0.9), "CRITICAL", None, "CRITICAL"), (dict(vision=0.9), "HIGH", None, "HIGH"),
])
def test_corroborate(spark, modalities, severity, rule, after):
    c = one(spark, ev.corroborate(finding(**modalities), F.lit(severity)))
    assert (c.rule, c.severity) == (rule, after)


@pytest.mark.parametrize("severity, confidence, start, end, risk", [("HIGH", 0.9, 12000, 15000, 0.364), ("MEDIUM", 0.8, 60000, 70000, 0.224), ("CRITICAL", 0.95, 5000, 5000, 0.99)])
def test_finding_risk(spark, severity, confidence, start, end, risk):
    found = one(spark, ev.finding_risk(F.lit(severity), F.lit(confidence), F.lit(start), F.lit(end)))
    assert abs(found - risk) < 5e-4
    assert one(spark, ev.finding_risk(F.lit("LOW"), F.lit(0.5), F.lit(40000), F.lit(40000), F.lit(0.0))) == 0.05


def test_readiness(spark):
    r = one(spark, ev.readiness({d: F.lit(float(v)) for d, v in zip(ev.DIMENSION_WEIGHT, (31, 19, 78, 62, 88))}))
    assert (r.overall, r.verdict, r.weakest, r.capped) == (34, "DO_NOT_PUBLISH", "copyright", True)
    r = one(spark, ev.readiness({d: F.lit(100.0) for d in ev.DIMENSION_WEIGHT}))
    assert (r.overall, r.verdict, r.weakest, r.capped) == (100, "SAFE", "policy", False)


def test_text(spark):
    assert one(spark, tx.normal_token(F.lit(" H3ll000o!! "))) == "helloo"
    assert one(spark, tx.similarity(F.lit("subscribe now"), F.lit("subscnbe now"))) == pytest.approx(1 - 2 / 13)
    assert one(spark, tx.similar_enough(F.lit("subscribe now"), F.lit("subscnbe now")))
    assert one(spark, tx.luhn_valid(F.lit("4111 1111 1111 1111"))) and not one(spark, tx.luhn_valid(F.lit("4111111111111112")))
    assert one(spark, tx.redact(F.lit("abcd"))) == "****" and one(spark, tx.redact(F.lit("abcdefgh"))) == "abcd****"
    assert one(spark, tx.tokens(F.lit("The cat's in a HAT x 42"))) == ["cat's", "hat", "42"]
    assert one(spark, tx.stamp(F.lit(3_723_004), ",")) == "01:02:03,004" and one(spark, tx.timecode(F.lit(61_250))) == "01:01.2"
    assert one(spark, tx.rule_name(F.lit("graphic violence & harm"))) == "GraphicViolenceHarm"
    assert one(spark, tx.safe_name(F.lit("../a b/c d?.mp4"))) == "c_d_.mp4"
    assert one(spark, tx.fraction(F.lit("30000/1001"), 1.0)) == pytest.approx(29.97, abs=1e-2) and one(spark, tx.fraction(F.lit("0/0"), 7.0)) == 7.0
    assert one(spark, tx.mark(F.lit("one two"), F.lit("two"))).asDict() == {"s": 4, "e": 7}
    assert one(spark, tx.join_spaced_letters(F.lit("buy s p a m now"))) == "buy spam now"


def test_scan(spark):
    text = "mail a.b@c.org or call +49 (30) 1234-5678, DB_PASSWORD=hunter22 4111 1111 1111 1111 see https://x.org/abc and Bearer abcdefghijklmnop"
    hits = {(h.kind, h.label) for h in one(spark, tx.scan(F.lit(text)))}
    assert hits == {("email", "email"), ("phone", "phone"), ("credential", "labelled secret"), ("card", "card"), ("url", "url"), ("credential", "bearer")}
    assert all("hunter22" not in h.redacted for h in one(spark, tx.scan(F.lit(text))))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 50)), min_size=1, max_size=6))
def test_iou(spark, spans):
    for s, n in spans:
        found = one(spark, ev.temporal_iou(F.lit(10), F.lit(30), F.lit(s), F.lit(s + n)))
        both = max(0, min(30, s + n) - max(10, s))
        union = 20 + n - both
        assert found == pytest.approx(both / union if union else 0)


def test_long_times_keep_their_digits(spark):
    assert one(spark, tx.timecode(F.lit(6_000_052))) == "100:00.0" and one(spark, tx.timecode(F.lit(59_950))) == "00:59.9"
    assert one(spark, tx.stamp(F.lit(822_000_123))) == "228:20:00.123" and one(spark, tx.stamp(F.lit(None).cast("long"))) is None
