"""Streams against their batch twins: shuffled and late input, restarts, and state that ends."""

import random

import pytest
from pyspark.sql import functions as F

from evidra.operators import greedy
from evidra.streaming import stateful

LATE = "10 minutes"


def write_in_parts(df, order, path, parts):
    """Files in the order that a stream is to read them."""
    rows = df.orderBy(order).collect()
    size = -(-len(rows) // parts)
    for k in range(0, len(rows), size):
        df.sparkSession.createDataFrame(rows[k : k + size], df.schema).coalesce(1).write.mode("append").parquet(path)


def run(spark, frame, path, f, name, tmp_path):
    stateful.use_rocksdb(spark)
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = f(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).collect(), query


def jittered(spark, rows, schema, seed):
    """Rows in an order that is late by up to five minutes, then an end that moves the watermark past all."""
    pick = random.Random(seed)
    at = [r[2] / 1000 + pick.uniform(0, 300) for r in rows]
    df = spark.createDataFrame([(*r, a) for r, a in zip(rows, at, strict=True)], schema + ", arrives double")
    return df.withColumn("ts", F.timestamp_millis("start_ms"))


@pytest.mark.parametrize("seed", range(2))
def test_incidents_equal_batch(spark, tmp_path, seed):
    pick = random.Random(seed)
    names = [*greedy.COMPATIBLE, "Unlisted", "Other"]
    rows = []
    for k in range(400):
        s = pick.randrange(0, 3_600_000)
        rows.append((pick.randrange(3), k, s, s + pick.choice([0, 500, 4_000, 60_000]), f"C{pick.randrange(4)}", pick.choice(names)))
    rows += [(9, 1000 + k, 20_000_000 + k, 20_000_001 + k, "C", "Language") for k in range(2)]
    df = jittered(spark, rows, "entity long, ord long, start_ms long, end_ms long, clause string, category string", seed).withColumn("end_ts", F.timestamp_millis("end_ms"))
    write_in_parts(df, "arrives", f"{tmp_path}/in", 8)
    found, query = run(spark, df, f"{tmp_path}/in", lambda s: stateful.incidents(s, LATE), f"incidents{seed}", tmp_path)
    batch = greedy.incidents(df.filter("entity <> 9"), 0).join(df, ["entity", "ord"])
    first = batch.groupBy("entity", "incident").agg(F.min_by("ord", F.struct("start_ms", "end_ms", "ord")).alias("first"))
    wanted = {(r.entity, r.ord): r["first"] for r in batch.join(first, ["entity", "incident"]).collect()}
    assert {(r.entity, r.ord): r["first"] for r in found if r.entity != 9} == wanted
    assert len(found) >= len(wanted)
    assert len({v for k, v in wanted.items()}) < len(wanted)


@pytest.mark.parametrize("seed", range(2))
def test_clusters_equal_batch(spark, tmp_path, seed):
    pick = random.Random(10 + seed)
    texts = ["Subscribe now", "subscnbe now", "SALE", "sale", "Breaking news", "breaking  news!"]
    rows = []
    for k in range(300):
        x, y = pick.choice([0.0, 0.1, 0.5]), pick.choice([0.0, 0.6])
        rows.append((pick.randrange(2), k, pick.randrange(0, 1_800_000), pick.choice(texts), pick.random(), x, y, 0.4, 0.2))
    rows += [(9, 1000, 20_000_000, "end", 1.0, 0.0, 0.0, 0.1, 0.1)]
    df = jittered(spark, rows, "entity long, ord long, start_ms long, text string, confidence double, x double, y double, w double, h double", seed)
    write_in_parts(df, "arrives", f"{tmp_path}/in", 6)
    gap = 60_000
    found, query = run(spark, df, f"{tmp_path}/in", lambda s: stateful.sighting_clusters(s, LATE, gap_ms=gap), f"clusters{seed}", tmp_path)
    batch = greedy.cluster_sightings(df.filter("entity <> 9").withColumn("ts_ms", F.col("start_ms")), gap_ms=gap).join(df, ["entity", "ord"])
    first = batch.groupBy("entity", "cluster").agg(F.min_by("ord", F.struct("start_ms", "text", "ord")).alias("first"))
    wanted = {(r.entity, r.ord): r["first"] for r in batch.join(first, ["entity", "cluster"]).collect()}
    assert {(r.entity, r.ord): r["first"] for r in found if r.entity != 9} == wanted
    # All that is left in the state is the end's: what waits, its timers.
    sizes = spark.read.format("statestore").option("stateVarName", "state").load(f"{tmp_path}/clusters{seed}").select("key.entity").distinct().collect()
    assert {r.entity for r in sizes} <= {9}
    waiting = spark.read.format("statestore").option("stateVarName", "waiting").load(f"{tmp_path}/clusters{seed}").select("key.entity").distinct().collect()
    assert {r.entity for r in waiting} <= {9}


def test_rows_past_the_watermark_are_left_out(spark, tmp_path):
    rows = [(1, 1, 1_000, 2_000, "A", "Language"), (1, 2, 5_000_000, 5_001_000, "A", "Language"), (1, 3, 9_000_000, 9_001_000, "A", "Language")]
    df = jittered(spark, rows, "entity long, ord long, start_ms long, end_ms long, clause string, category string", 0).withColumn("end_ts", F.timestamp_millis("end_ms"))
    late = df.filter("ord = 1").withColumn("ord", F.lit(4).cast("long"))
    for part in (df.filter("ord = 1"), df.filter("ord = 2"), df.filter("ord = 3"), late):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    found, _ = run(spark, df, f"{tmp_path}/in", lambda s: stateful.incidents(s, LATE), "late", tmp_path)
    assert sorted((r.ord, r["first"]) for r in found)[:2] == [(1, 1), (2, 2)] and 4 not in {r.ord for r in found}


def log_of(spark, tmp_path, n=600, parts=6):
    from evidra.streaming.event_log import EventLog

    df = spark.range(n).select(F.col("id").alias("event_id"), F.timestamp_millis(F.col("id") * 977 % 10_007 * 1000).alias("ts"), (F.col("id") % 13).alias("user_id"))
    write_in_parts(df, F.col("event_id") * 7919 % 601, f"{tmp_path}/in", parts)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    return df, stream, EventLog(spark, f"file://{tmp_path}/log", ["ts", "event_id"])


def test_log_over_restarts(spark, tmp_path):
    """A stream that dies before a batch's commit, and one that dies after it, lose no event and double none."""
    df, stream, log = log_of(spark, tmp_path)
    deaths, inner = {2: "before", 4: "after"}, log.commit

    def commit(batch, entry):
        when = deaths.pop(batch, None)
        if when != "before":
            inner(batch, entry)
        if when:
            raise RuntimeError(f"killed {when} the commit")

    log.commit = commit
    for when, known in (("before", 2), ("after", 5)):
        query = log.follow(stream, f"{tmp_path}/cp", availableNow=True)
        with pytest.raises(Exception, match=f"killed {when}"):
            query.awaitTermination()
        assert len(log.entries()) == known and log.replay().count() == 100 * known
    log.follow(stream, f"{tmp_path}/cp", availableNow=True).awaitTermination()
    assert sorted(log.entries()) == [0, 1, 2, 3, 4, 5]
    out = log.replay()
    assert out.count() == 600 == out.select("event_id").distinct().count()
    assert out.select("batch", "place").distinct().count() == 600
    assert log.sweep() == 1 and log.replay().count() == 600


def test_log_commits_once(spark, tmp_path):
    df, stream, log = log_of(spark, tmp_path, 50, 1)
    log.append(df, 0)
    log.append(df, 0)  # the batch again, after its commit
    assert not log.commit(0, log.write_attempt(df, 0))
    assert log.replay().count() == 50


def test_log_replays_from_any_cursor(spark, tmp_path):
    from evidra.streaming.event_log import Cursor

    df, stream, log = log_of(spark, tmp_path, 90, 3)
    with pytest.raises(LookupError):
        log.replay()
    assert log.last() == Cursor()
    log.append(df.filter("event_id < 40"), 0)
    log.append(df.limit(0), 1)
    log.append(df.filter("event_id >= 40"), 2)
    every = [(r.batch, r.place, r.event_id) for r in log.replay().orderBy("batch", "place").collect()]
    assert len(every) == 90 and [r[2] for r in every] == [r.event_id for b in ("event_id < 40", "event_id >= 40") for r in df.filter(b).orderBy("ts", "event_id").collect()]
    for k in (0, 1, 39, 40, 88):
        after = Cursor.parse(str(Cursor(*every[k][:2])))
        assert [(r.batch, r.place, r.event_id) for r in log.replay(after).orderBy("batch", "place").collect()] == every[k + 1 :]
        assert log.replay(upto=after).count() == k + 1
    assert log.last() == every[-1][:2] and log.replay(log.last()).count() == 0
    files = log.replay(Cursor(0, every[39][1])).inputFiles()
    assert log.replay(Cursor(2, -1)).inputFiles() and len(files) >= 1
    assert all("/000000000002-" in f for f in log.replay(Cursor(1, 0)).inputFiles())
