import json
import os

import pytest
from pyspark.sql import functions as F

from evidra.sources.content_store import ContentStore, content_digest, key_of


@pytest.fixture
def store(spark, tmp_path):
    return ContentStore(spark, f"file://{tmp_path}/store")


def some(spark, n=200):
    return spark.range(n).select("id", (F.col("id") % 7).cast("string").alias("kind"), F.when(F.col("id") % 5 == 0, None).otherwise(F.col("id") / 3).alias("x"), F.array("id", F.lit(None)).alias("list"))


def test_digest_is_of_the_rows(spark):
    df = some(spark)
    same = content_digest(df)
    assert content_digest(df.repartition(7).orderBy(F.desc("kind"))) == same
    changed = [df.limit(199), df.union(df.limit(1)), df.withColumn("x", F.col("x") + (F.col("id") == 3).cast("int")), df.withColumn("x", F.coalesce("x", F.lit(0.0)))]
    changed += [df.withColumnRenamed("x", "y"), df.withColumn("id", F.col("id").cast("int")), df.select("kind", "id", "x", "list")]
    assert len({same, *map(content_digest, changed)}) == 1 + len(changed)
    assert content_digest(df.limit(0)) == content_digest(df.filter("id < 0")) != same


def test_put_and_get(spark, store):
    digest = store.put(some(spark))
    assert sorted(store.get(digest, verify=True).collect()) == sorted(some(spark).collect())
    before = store.markers("tables", digest)
    assert store.put(some(spark).repartition(5)) == digest and store.markers("tables", digest) == before
    assert store.stats() == {"tables": 1}
    with pytest.raises(KeyError):
        store.get("0" * 64)


def test_an_interrupted_writer_is_never_read(spark, store):
    df = some(spark)
    digest = content_digest(df)
    bad = df.withColumn("x", F.when(F.col("id") == 150, F.raise_error(F.lit("lost"))).otherwise(F.col("x")))
    with pytest.raises(Exception, match="lost"):
        store.write_attempt(bad, "tables", digest)
    half = store.write_attempt(df.limit(3), "tables", digest)  # dies after some files, before its marker
    assert not store.exists("tables", digest)
    with pytest.raises(KeyError):
        store.get(digest)
    folder = f"{store.base}/tables/{digest}"
    with open(f"{folder}/_marker-{half}", "w") as f:
        f.write('{"att')  # dies while it writes the marker
    assert not store.exists("tables", digest)
    store.put(df)
    assert store.get(digest, verify=True).count() == 200
    assert store.sweep(older_than_s=3600) == 0
    assert store.sweep(older_than_s=-1) == 2 and store.get(digest, verify=True).count() == 200
    assert [x for x in os.listdir(folder) if os.path.isdir(f"{folder}/{x}")] == store.markers("tables", digest)


def test_two_writers(spark, store):
    df = some(spark)
    digest = content_digest(df)
    first, second = store.write_attempt(df, "tables", digest), store.write_attempt(df.repartition(3), "tables", digest)
    store.commit("tables", digest, second)
    early = store.get(digest)
    store.commit("tables", digest, first)
    assert store.markers("tables", digest) == sorted([first, second])
    assert store.get(digest, verify=True).count() == early.count() == 200
    assert store.sweep() == 1 and store.markers("tables", digest) == [min(first, second)]
    assert store.get(digest, verify=True).count() == 200


def test_damage_is_found(spark, store):
    df = some(spark)
    digest = content_digest(df)
    store.commit("tables", digest, store.write_attempt(df.limit(10), "tables", digest))
    with pytest.raises(ValueError):
        store.get(digest, verify=True)


def test_results_are_computed_once(spark, store):
    calls = []

    def compute():
        calls.append(1)
        return some(spark).groupBy("kind").count()

    source = store.put(some(spark))
    key = key_of(source=source, version=3)
    assert key == key_of(version=3, source=source) != key_of(source=source, version=4)
    assert sorted(store.cached(key, compute).collect()) == sorted(store.cached(key, compute).collect())
    assert len(calls) == 1
    with open(f"{store.base}/results/{key}/ready-{store.markers('results', key)[0]}") as f:
        assert json.load(f)["attempt"] == store.markers("results", key)[0]
