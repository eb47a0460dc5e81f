import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from evidra.operators import certificate as ce


def text_of(value):
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def evaluated(spark, texts, column):
    return [r.v for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", column(F.col("t")).alias("v")).orderBy("k").collect()]


def some_value(pick, depth=0):
    kind = pick.randrange(7 if depth < 3 else 5)
    if kind == 5:
        return [some_value(pick, depth + 1) for _ in range(pick.randrange(4))]
    if kind == 6:
        return {pick.choice(["a", "b", "Z", "é", "key two", 'q"uote', "x\\y", ""]) + str(pick.randrange(3)): some_value(pick, depth + 1) for _ in range(pick.randrange(5))}
    return [None, pick.random() < 0.5, pick.randrange(-10**6, 10**6), pick.choice(["", "text", "é漢", 'a"b', "tab\tline\n"]), pick.randrange(1000) / 8][kind]


def shuffled(pick, value):
    if isinstance(value, dict):
        keys = list(value)
        pick.shuffle(keys)
        return {k: shuffled(pick, value[k]) for k in keys}
    return [shuffled(pick, v) for v in value] if isinstance(value, list) else value


def test_canonical_text(spark):
    pick = random.Random(4)
    objects = [{f"k{i}": some_value(pick) for i in range(pick.randrange(6))} | {"certificateId": "x"} for _ in range(120)]
    texts = [json.dumps(shuffled(pick, o), indent=pick.choice([None, 2]), ensure_ascii=False) for o in objects]
    found = evaluated(spark, texts, ce.canonical)
    for o, text in zip(objects, found, strict=True):
        wanted = {k: v for k, v in o.items() if k not in ce.UNHASHED}
        assert json.loads(text) == wanted and list(json.loads(text)) == sorted(wanted)
    again = evaluated(spark, [json.dumps(shuffled(pick, o), ensure_ascii=False) for o in objects], ce.canonical)
    assert again == found
    assert evaluated(spark, ["[1]", "nonsense", '{"a":1', None, '{"a":1,"a":2}'], ce.canonical) == [None] * 5 or evaluated(spark, ["nonsense", '{"a":1', None], ce.canonical) == [None] * 3


def tables(spark):
    runs = [(1, "2024-05-01", "p1", ("run1", "rem1"), 40, 80, 75, True, True), (2, "2024-05-02", "p1", ("run2", None), 55, None, 90, False, True), (3, "2024-05-03", None, ("run3", "rem3"), 10, 20, None, True, False)]
    changes = [(1, "B-01", "RESOLVED"), (1, "A-01", "RESOLVED"), (1, "C", "NEW"), (2, "A-01", "PERSISTS"), (1, "A-01", "RESOLVED")]
    return (
        spark.createDataFrame(runs, "entity int, issued_at string, policy_version string, lineage struct<run:string,remediation:string>, original int, predicted int, actual int, reanalysis_ok boolean, structural_ok boolean"),
        spark.createDataFrame(changes, "entity int, clause string, status string"),
        spark.createDataFrame([(1, "vision", 0.5), (1, "speech", 0.75), (2, "speech", 0.9)], "entity int, agent string, coverage double"),
        spark.createDataFrame([(1, "MUTE", 100, 200), (1, "CUT", 50, 60)], "entity int, op string, start_ms long, end_ms long"),
    )


def test_bodies(spark):
    out = {r.entity: json.loads(r.body) for r in ce.bodies(*tables(spark)).collect()}
    one = out[1]
    assert one["scores"] == {"actual": 75, "delta": 35, "original": 40, "predicted": 80}
    assert one["findings"] == {"new": ["C"], "persists": [], "resolved": ["A-01", "A-01", "B-01"]}
    assert one["coverage"]["gated"] == ["vision"] and [o["op"] for o in one["operations"]] == ["CUT", "MUTE"]
    assert one["limitations"] == ["Too little was seen to tell absence: vision."]
    two = out[2]
    assert two["scores"] == {"actual": ce.NOT_MEASURED, "delta": ce.NOT_MEASURED, "original": 55, "predicted": None}
    assert len(two["limitations"]) == 2 and two["lineage"] == {"run": "run2", "remediation": None} and two["operations"] == []
    assert out[3]["scores"]["actual"] == ce.NOT_MEASURED and out[3]["findings"] == {"new": [], "persists": [], "resolved": []}


def test_order_of_columns_doesnt_count(spark):
    runs, *rest = tables(spark)
    other = runs.select(*reversed(runs.columns)).withColumn("lineage", F.struct("lineage.remediation", "lineage.run"))
    digests = lambda r: {x.entity: x.d for x in ce.bodies(r, *rest).select("entity", ce.digest(F.col("body")).alias("d")).collect()}
    assert digests(runs) == digests(other)
    assert digests(runs) != digests(runs.withColumn("original", F.col("original") + 1))


def test_one_changed_byte_is_found(spark):
    made = ce.sealed(ce.bodies(*tables(spark)), F.concat(F.lit("CERT-"), F.col("entity")))
    rows = {r.entity: r.body for r in made.collect()}
    assert evaluated(spark, list(rows.values()), ce.intact) == [True] * 3
    text = rows[1]
    parsed = json.loads(text)
    assert parsed["certificateId"] == "CERT-1"
    body = {k: v for k, v in parsed.items() if k not in ce.UNHASHED}
    assert parsed["certificateHash"] == "sha256:" + hashlib.sha256(text_of(body).encode()).hexdigest()
    reordered = [json.dumps(shuffled(random.Random(1), parsed), indent=1), json.dumps(parsed | {"storedAt": "s3", "certificateId": "other"})]
    assert evaluated(spark, reordered, ce.intact) == [True, True]
    start = text.index('"coverage"')
    changed = []
    for k in range(start, len(text)):
        for new in ("0", "x"):
            if text[k] != new:
                changed.append(text[:k] + new + text[k + 1 :])
    changed += [text.replace('"issuedAt"', '"extra":1,"issuedAt"'), text.replace('"NEW"', '"new"').replace('"version":"1.0"', '"version":"1.1"'), "{}", "", None]
    found = evaluated(spark, changed, ce.intact)
    assert not any(found), [c for c, f in zip(changed, found) if f][:3]


@pytest.mark.parametrize("body", ["{}", " { } "])
def test_empty_bodies(spark, body):
    df = spark.createDataFrame([(body,)], "body string")
    out = ce.sealed(df, F.lit(7)).first().body
    assert json.loads(out)["certificateId"] == "7" and evaluated(spark, [out], ce.intact) == [True]
