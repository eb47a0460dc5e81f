import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidra.operators import vector_store as vs


def some(spark, n=300, width=6, seed=1):
    pick = random.Random(seed)
    rows = [(k, f"name {k} é", [float(pick.choice([-1, 0, 0.5, 1, 2])) for _ in range(width)], k % 4) for k in range(n)]
    return rows, spark.createDataFrame(rows, "id long, name string, vector array<double>, label int")


def brute(rows, questions, k, admitted=lambda r: True):
    out = {}
    for q, v in questions:
        scored = sorted((-float(np.dot(v, r[2])), r[0]) for r in rows if admitted(r) and r[2] is not None)
        out |= {(q, i): (-s, place) for place, (s, i) in enumerate(scored[:k])}
    return out


def test_ids_are_of_names(spark):
    names = ["a", "", "name é 漢字", "x" * 500]
    space = uuid.uuid5(uuid.NAMESPACE_URL, "evidra")
    found = spark.createDataFrame([(n,) for n in names], "n string").select("n", vs.name_id(space, F.col("n")).alias("i")).collect()
    assert {r.n: r.i for r in found} == {n: str(uuid.uuid5(space, n)) for n in names}


@pytest.mark.parametrize("k, questions, scores", [(5, 4_000_000, 4_000_000), (1, 20, 50), (400, 40, 7)])
def test_nearest_equals_brute_force(spark, monkeypatch, k, questions, scores):
    monkeypatch.setattr(vs, "QUESTIONS", questions)
    rows, df = some(spark)
    asked = [(k, r[2]) for k, r in enumerate(rows[:23])]
    q = spark.createDataFrame([*asked, (99, None)], "qid long, vector array<double>")
    odd = df.select("id", "vector").union(spark.createDataFrame([(1000, None)], "id long, vector array<double>")).repartition(5)
    found = {(r.qid, r.id): (r.score, r["rank"]) for r in vs.nearest(odd, q, k).collect()}
    assert found == brute(rows, asked, k)
    assert vs.nearest(odd.limit(0), q, k).count() == 0 == vs.nearest(odd, q.limit(0), k).count()


def test_tasks_return_few_rows_and_filters_prune(spark, tmp_path):
    rows, df = some(spark)
    store = vs.VectorStore(spark, f"file://{tmp_path}/v", ["label"])
    with pytest.raises(LookupError):
        store.read()
    store.upsert(df.select("name", "vector", "label"))
    q = spark.createDataFrame([(1, rows[0][2])], "qid long, vector array<double>")
    found = store.search(q, 3, F.col("label") == 2)
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(label" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "WindowGroupLimit" in plan
    out, label = found.collect(), {r[1]: r[3] for r in rows}
    assert sorted(r.score for r in out) == sorted(s for s, _ in brute(rows, [(1, rows[0][2])], 3, lambda r: r[3] == 2).values())
    assert {label[r.name] for r in out} == {2}


def test_upserts_replace_and_move(spark, tmp_path):
    rows, df = some(spark, 40)
    store = vs.VectorStore(spark, f"file://{tmp_path}/v", ["label"])
    store.upsert(df.select("name", "vector", "label"))
    change = df.filter("id < 10").select("name", F.transform("vector", lambda x: x * 2).alias("vector"), F.lit(9).alias("label"))
    store.upsert(change.union(change).union(spark.createDataFrame([("new", [1.0] * 6, 9), (None, [1.0] * 6, 9)], "name string, vector array<double>, label int")))
    out = {r.name: (r.label, r.vector) for r in store.read().collect()}
    assert len(out) == 41 == store.read().count() and "new" in out
    assert all(out[n] == ((9, [2 * x for x in v]) if i < 10 else (label, v)) for i, n, v, label in rows)
    before = store.read().count()
    store.upsert(change)  # again: nothing changes
    assert store.read().count() == before and {r.name: (r.label, r.vector) for r in store.read().collect()} == out
    assert [r.name for r in store.search(spark.createDataFrame([(1, [1.0] * 6)], "qid long, vector array<double>"), 1, F.col("name") == "new").collect()] == ["new"]
