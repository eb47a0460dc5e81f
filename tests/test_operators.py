"""Joins on time against nested loops, scans against small models, readers and streams against files."""

import json
import random
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidra.operators import emit, greedy, intervals, remediation, sessions, signal, stores
from evidra.sources import readers
from evidra.streaming import windows


def spans(seed, n=80):
    pick = random.Random(seed)
    return [(pick.randint(0, 2), i, s := pick.randint(0, 90_000), s + pick.choice([0, 1, 500, 10_000, 35_000])) for i in range(n)]


@pytest.mark.parametrize("closed", [(False, False), (True, True), (True, False)])
def test_overlap_join_equals_nested_loops(spark, closed):
    a, b = spans(1), spans(2)
    left, right = spark.createDataFrame(a, "entity long, id long, s long, e long"), spark.createDataFrame(b, "entity long, rid long, rs long, re long")
    found = sorted((r.id, r.rid) for r in intervals.overlap_join(left, right, ["entity"], closed).collect())
    meets = lambda x, y: (y[3] >= x[2] if closed[0] else y[3] > x[2]) and (y[2] <= x[3] if closed[1] else y[2] < x[3])
    assert found == sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and meets(x, y))


@pytest.mark.parametrize("duration, wanted", [(62_000, [(0, 30_000), (25_000, 55_000), (50_000, 62_000)]), (55_000, [(0, 30_000), (25_000, 55_000)]), (20_000, [(0, 20_000)]), (0, [])])
def test_window_bounds(spark, duration, wanted):
    out = intervals.window_bounds(spark.createDataFrame([(duration,)], "duration long"), 30_000, 5_000)
    assert sorted((r.s, r.e) for r in out.collect()) == wanted


def test_time_map(spark):
    cuts = spark.createDataFrame([(1, 10_000, 20_000)], "entity long, cs long, ce long")
    points = spark.createDataFrame([(0, 1, 45_000, 47_000), (1, 1, 10_000, 25_000), (2, 1, 5_000, 10_000)], "id long, entity long, s long, e long")
    out = {r.id: (r.s, r.e) for r in intervals.map_span(points, cuts, ["entity"]).collect()}
    assert out == {0: (35_000, 37_000), 1: (None, None), 2: (5_000, 10_000)}


def test_sessions(spark):
    o = spark.createDataFrame([(1, "a", t, i, 0.5) for i, t in enumerate((0, 4_000, 8_001))], "entity long, label string, ts_ms long, ord long, confidence double")
    assert sorted((r.start_ms, r.end_ms) for r in sessions.tracks(o, ["entity"]).collect()) == [(0, 4_000), (8_001, 8_001)]
    ops = lambda gap: spark.createDataFrame([(1, 0, 100, 0), (1, 100 + gap, 900, 1)], "entity long, start_ms long, end_ms long, ord long")
    merged = lambda gap: sessions.merge_spans(ops(gap), ["entity"], 400, ["start_ms", "ord"], strict=True).count()
    assert (merged(399), merged(400)) == (1, 2)


def test_incidents(spark):
    rows = [(1, 0, 0, 1_000, "AF-1", "Language"), (1, 1, 3_400, 4_000, "AF-2", "Violence"), (1, 2, 6_501, 7_000, "AF-3", "Language"), (1, 3, 3_500, 3_600, "META-1", "Metadata"), (1, 4, 0, 100_000, "AF-1", "Language")]
    out = {r.ord: r.incident for r in greedy.incidents(spark.createDataFrame(rows, "entity long, ord long, start_ms long, end_ms long, clause string, category string"), 100_000).collect()}
    assert out[0] == out[1] and out[2] != out[1] and len({out[k] for k in (0, 2, 3, 4)}) == 4


def test_runs_and_gaps(spark):
    schema = "entity long, ord long, start_ms long, end_ms long, clause string"
    a = spark.createDataFrame([(1, 0, 0, 1_000, "A"), (1, 1, 500, 1_500, "A"), (1, 2, 9_000, 9_500, "B")], schema)
    b = spark.createDataFrame([(1, 10, 400, 1_400, "A"), (1, 11, 9_000, 9_500, "C")], schema)
    out = sorted(((r.before, r.after, r.status) for r in greedy.match_runs(a, b).collect()), key=repr)
    assert out == sorted([(0, 10, "PERSISTS"), (1, None, "RESOLVED"), (2, None, "RESOLVED"), (None, 11, "NEW")], key=repr)
    e = spark.createDataFrame([(1, i, t) for i, t in enumerate((0, 50, 120, 130, 260))], "entity long, ord long, ts_ms long")
    assert sorted(r.ts_ms for r in greedy.accepted_after_gap(e, 120).collect()) == [0, 120, 260]


def test_captions(spark):
    words = [(1, 0, i, f"word{i}", 1000 + 400 * i + (2000 if i > 4 else 0), 1300 + 400 * i + (2000 if i > 4 else 0)) for i in range(25)]
    cues = greedy.caption_cues(spark.createDataFrame(words, "entity long, turn long, pos long, w string, start_ms long, end_ms long"))
    rows = cues.orderBy("n").collect()
    assert " ".join(r.text.replace("\n", " ") for r in rows) == " ".join(w[3] for w in words)
    assert rows[0].end_ms == 2900 and all(r.end_ms - r.start_ms <= 6_000 and max(map(len, r.text.split("\n"))) <= 42 for r in rows)
    assert all(a.end_ms <= b.start_ms for a, b in zip(rows, rows[1:]))
    text = emit.captions(cues, ["entity"], comma=True).first().captions
    assert text.startswith("1\n00:00:01,000 --> 00:00:02,900\n")


def test_cut_budget(spark):
    ops = spark.createDataFrame([(1, i, "CUT", 0, n) for i, n in enumerate((500, 300, 200))], "entity long, id long, op string, s long, e long")
    assert {r.id: r.op for r in remediation.cut_budget(ops, 10_000, 0.05).collect()} == {0: "MUTE", 1: "CUT", 2: "CUT"}


def test_stores(spark):
    old, new = spark.createDataFrame([({"a": "1", "b": "2"},)], "m map<string,string>"), spark.createDataFrame([({"a": "1", "b": "3", "c": "4"},)], "n map<string,string>")
    assert old.join(new).select(stores.changed_sections(F.col("m"), F.col("n")).alias("x")).first().x == ["b", "c"]
    assert stores.next_id(spark.createDataFrame([("RUN-0009",), ("RUN-0012",), ("X",)], "id string"), "id", "RUN").first().next_id == "RUN-0013"


def test_signal(spark):
    t = np.arange(16_000) / 8_000
    clips = spark.createDataFrame([(1, 8_000, (0.5 * np.sin(2 * np.pi * 50 * t)).tolist()), (2, 8_000, np.random.default_rng(1).normal(0, 0.2, 16_000).tolist())], "clip long, rate int, samples array<double>")
    out = {r.clip: r for r in signal.clip_features(clips).collect()}
    assert out[1].hum50 > 30 and out[2].hum50 < 20 and out[1].clipped == 0
    flat = signal.stft_features(clips).groupBy("clip").agg(F.avg("flatness").alias("f"), F.avg("rms").alias("r")).orderBy("clip").collect()
    assert flat[0].f < 0.2 < flat[1].f and flat[0].r == pytest.approx(0.5 / 2**0.5, abs=0.02)


def test_probe_profiles(spark):
    probe = {"format": {"format_name": "mov,mp4", "duration": "12.5"}, "streams": [{"codec_type": "audio", "codec_name": "aac", "sample_rate": "48000", "channels": 2}, {"codec_type": "video", "codec_name": "hevc", "width": 1920, "height": 1080, "pix_fmt": "yuv420p10le", "avg_frame_rate": "30000/1001", "r_frame_rate": "60/1", "color_transfer": "smpte2084"}]}
    r = readers.probe_profiles(spark.createDataFrame([("a", json.dumps(probe)), ("b", "{}")], "path string, json string")).orderBy("path").collect()
    assert (r[0].duration_ms, r[0].codec, r[0].width, r[0].bit_depth, r[0].chroma, r[0].hdr, r[0].variable_rate) == (12_500, "hevc", 1920, 10, "4:2:0", "PQ", True)
    assert r[0].audio[0].rate == 48_000 and r[1].codec is None and r[1].variable_rate is None


def test_corpus_and_lexicon(spark, tmp_path):
    (tmp_path / "AF-01.md").write_text("---\nclause_id: AF-01\ntitle: Strong: language\n---\nintro\n## Rule (short)\nNo shouting.\n\n## Advisory\nnote\n## Empty\n")
    c = readers.clause_corpus(spark, f"{tmp_path}/*.md")
    row = c.first()
    assert row.clause_id == "AF-01" and row.title == "Strong: language" and row.sections == {"Rule": "No shouting.", "Advisory": "note"}
    assert [r.id for r in readers.chunks(c).collect()] == ["AF-01#Rule"]
    (tmp_path / "lex.json").write_text(json.dumps({"event": "profanity", "terms": [{"term": "Darn", "severity": "LOW", "forms": ["darned", "darn it"]}]}))
    assert sorted((r.form, r.n) for r in readers.lexicon(spark, f"{tmp_path}/lex.json").collect()) == [("darn", 1), ("darn it", 2), ("darned", 1)]


def test_files(spark, tmp_path):
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(8000)
        w.writeframes(np.array([[16384, -32768], [0, 32767]] * 400, "<i2").tobytes())
    (tmp_path / "b.txt").write_bytes(b"hello")
    (tmp_path / "c.html").write_bytes(b"<html>" + b" " * 2000)
    good, bad = readers.sniff(spark, str(tmp_path))
    assert [r.container for r in good.collect()] == ["riff"]
    assert sorted(r.reason for r in bad.collect()) == ["not media: html", "too small"]
    x = {r.channel: r.samples[:2] for r in readers.wav_samples(spark, str(tmp_path)).collect()}
    assert x == {0: [0.5, 0.0], 1: [-1.0, 32767 / 32768]}


def test_sidecars(spark, tmp_path):
    (tmp_path / "one.mp4.meta.json").write_text(json.dumps({"title": "T", "tags": ["x"]}))
    (tmp_path / "two.mp4.meta.json").write_text("{broken")
    clips = spark.createDataFrame([("one",), ("two",), ("three",)], "clip string")
    assert {r.clip: r.title for r in readers.with_sidecars(clips, spark, f"{tmp_path}/*.meta.json").collect()} == {"one": "T", "two": None, "three": None}


def test_parse_observations(spark):
    answers = [(0, 'Sure!\n```json\n{"objects": [{"label": "Gun ", "confidence": 0.9},]}\n```'), (1, '[{"label": "cat", "confidence": 2}, {"label": "ufo", "confidence": 0.5}]'), (2, '{"label": "cat", "confidence": 0.4}'), (3, "no idea"), (4, None)]
    good, bad = readers.parse_observations(spark.createDataFrame(answers, "frame long, text string"), ["gun", "cat"])
    assert sorted((r.frame, r.label) for r in good.collect()) == [(0, "gun"), (2, "cat")]
    assert sorted((r.frame, r.reason) for r in bad.collect()) == [(1, "bad confidence"), (1, "unknown label"), (3, "unreadable"), (4, "unreadable")]


def test_streams_equal_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    source = f"{tmp_path}/in"
    events.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)
    for name, f in (("t", lambda e: windows.tumbling_counts(e, "6 hours", "40 days").drop("mean")), ("s", lambda e: windows.sessions(e, "5 hours", "40 days"))):
        f(stream).writeStream.format("memory").queryName(name).outputMode("complete" if name == "t" else "append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination()
        got = spark.table(name)
        if name == "t":
            assert sorted(got.collect()) == sorted(f(events).collect())
    out = windows.refractory(stream.select("user_id", "event_id", "ts"), 7_200_000)
    out.writeStream.format("memory").queryName("r").outputMode("append").option("checkpointLocation", f"{tmp_path}/r").trigger(availableNow=True).start().awaitTermination()
    batch = greedy.accepted_after_gap(events.select(F.col("user_id").alias("entity"), F.col("event_id").alias("ord"), F.unix_millis("ts").alias("ts_ms")), 7_200_000)
    assert sorted(r.event_id for r in spark.table("r").collect()) == sorted(r.ord for r in batch.collect())


def test_optional_parts():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    if entry.HAS_LLM:
        assert {int(n[2:].split("_")[0]) for n in entry.queries() if n.startswith("op")} >= set(range(1, 11))


def test_pattern_words(spark):
    from evidra.operators import context

    text = "see the red fox of old and the big of it".split()
    tokens = spark.createDataFrame([(1, i, w) for i, w in enumerate(text)], "entity long, pos int, w string")
    out = sorted((r.hit, r.first, r.last) for r in context.pattern_words(tokens, ["entity"], r"\bthe \w+ (?:fox )?of\b").collect())
    assert out == [("the big of", 7, 9), ("the red fox of", 1, 4)]


def test_windows_take_what_they_touch(spark):
    from evidra.operators import context

    w = spark.createDataFrame([(1, 0, 0, 100), (1, 1, 100, 200)], "entity long, id long, s long, e long")
    frames = spark.createDataFrame([(1, 0, 7), (1, 100, 8), (1, 199, 9)], "entity long, ts long, frame long")
    items = spark.createDataFrame([(1, 50, 100, "a"), (1, 200, 300, "b")], "entity long, rs long, re long, text string")
    out = {r.id: (r.frames, r.texts) for r in context.window_evidence(w, frames, items, ["entity"]).collect()}
    assert out == {0: ([7], ["a"]), 1: ([8, 9], ["a"])}


def test_clauses_in_order(spark):
    from evidra.operators import context

    hits = [(0, 0, r, f"c{r}") for r in range(3)] + [(0, 1, 0, "c0"), (0, 1, 1, "d1"), (0, 2, 0, "d2"), (0, 2, 1, "d3"), (0, 3, 0, "d4")]
    out = context.clauses_in_order(spark.createDataFrame(hits, "window int, source int, rank int, clause string"))
    assert sorted(r.clause for r in out.collect()) == ["c0", "c1", "c2", "d1", "d2", "d3"]


def test_segments_motion_and_ducking(spark):
    kinds = spark.createDataFrame([(1, i, k) for i, k in enumerate("aabaccca")], "clip long, n long, kind string")
    assert [(r.kind, r.start_ms, r.end_ms) for r in signal.segments(kinds).orderBy("start_ms").collect()] == [("a", 0, 4000), ("c", 4000, 7000), ("a", 7000, 8000)]
    d = spark.createDataFrame([(1, i, v) for i, v in enumerate((1.0, 1.0, 30.0, 1.0, 20.0, 25.0, 1.0, 1.0))], "clip long, n long, diff double")
    assert sorted((r.n, r.kind) for r in signal.motion(d).collect()) == [(2, "CUT"), (4, "GRADUAL"), (5, "GRADUAL")]
    levels = [(1, 0.1, "speech")] * 12 + [(1, 0.4, "music")] * 12 + [(2, 0.1, "speech")]
    out = {r.clip: r for r in signal.ducking(spark.createDataFrame(levels, "clip long, rms double, kind string")).collect()}
    assert out[1].db == pytest.approx(12.04, abs=0.01) and out[1].deliberate and out[2].db is None


def test_channel_metrics(spark):
    x = np.random.default_rng(2).normal(0, 0.3, 8192)
    clips = spark.createDataFrame([(1, x.tolist(), x.tolist()), (2, x.tolist(), (-x / 10).tolist())], "clip long, left array<double>, right array<double>")
    out = {r.clip: r for r in signal.channel_metrics(clips).collect()}
    assert out[1].phase == pytest.approx(1) and out[2].phase == pytest.approx(-1) and out[2].spread_db == pytest.approx(20)


def test_simulation_prefers_what_helps(spark):
    from evidra.operators import detectors

    f = spark.createDataFrame([(1, 0, 40_000, 50_000, "AF-01", "Language", "HIGH", 0.9, {"speech": 0.9}), (1, 1, 60_000, 61_000, "COPY-01", "Violence", "CRITICAL", 0.9, {"vision": 0.9})], "entity long, ord long, start_ms long, end_ms long, clause string, category string, severity string, confidence double, modalities map<string,double>")
    out = {r.scenario: r for r in detectors.simulate(f, detectors.scenarios(f)).collect()}
    assert out["all fixes"].overall == 100 and out["fix 1"].delta > 0 and out["all muted"].delta <= out["all fixes"].delta
    assert detectors.best_within(detectors.simulate(f, detectors.scenarios(f)), 1.0).count() == 1


def test_sinks(spark, tmp_path):
    from evidra.sources import sinks

    df = spark.createDataFrame([("a", "x"), ("b", "key=sk-1")], "id string, body string")
    with pytest.raises(ValueError):
        sinks.publish(df, "body", f"{tmp_path}/out", ["sk-1"])
    sinks.publish(df, "body", f"{tmp_path}/out", ["other"])
    assert spark.read.json(f"{tmp_path}/out").count() == 2
    for v in ("1", "2", "1"):
        sinks.write_snapshot(df, f"{tmp_path}/snap", v)
    assert sinks.read_snapshot(spark, f"{tmp_path}/snap", "1").count() == 2
    out = sinks.upsert(df, spark.createDataFrame([("b", "new"), ("c", "new")], "id string, body string"), "id")
    assert sorted((r.id, r.body) for r in out.collect()) == [("a", "x"), ("b", "new"), ("c", "new")]


def test_lines_and_boxes(spark):
    from evidra.operators import context

    w = spark.createDataFrame([(0, 1, 1, "lo", 0.5, 0.1, 0.2, 0.1, 0.9), (0, 1, 0, "hel", 0.1, 0.1, 0.3, 0.2, 0.7)], "frame long, line long, n long, text string, x double, y double, w double, h double, conf double")
    r = context.group_lines(w).first()
    assert (r.text, r.x, r.y, round(r.w, 6), round(r.h, 6), r.conf) == ("hel lo", 0.1, 0.1, 0.6, 0.2, 0.7)
    box = lambda *v: F.struct(*(F.lit(float(x)).alias(n) for x, n in zip(v, "xywh")))
    assert spark.range(1).select(context.box_iou(box(0, 0, 2, 2), box(1, 0, 2, 2)).alias("x")).first().x == pytest.approx(1 / 3)


def test_scratch_deletes_what_it_made(spark):
    import os

    from pyarrow.fs import FileSystem

    from evidra import session

    at = lambda df: FileSystem.from_uri(session.WRITTEN[df])[1]
    before = session.materialise(spark.range(3), "before")
    with session.scratch() as kept:
        first = session.materialise(spark.range(5), "first")
        with session.scratch() as inner:
            second = session.materialise(first.select("id"), "second")
            inner.append(second)
            third, path = session.materialise(first, "third"), None
            path = at(third)
        assert not os.path.exists(path) and os.path.exists(at(second)) and second.count() == 5
        kept.append(second)
        gone = at(first)
    assert not os.path.exists(gone) and second.count() == 5 and before.count() == 3
    session.discard(second)
    session.discard(before)
    assert not session.MADE
    with pytest.raises(ZeroDivisionError), session.scratch():
        bad = session.materialise(spark.range(2), "bad")
        path = at(bad)
        raise ZeroDivisionError
    assert not os.path.exists(path)
    assert f"/evidra-{spark.sparkContext.applicationId}/" in session.shared_path(spark, "x")


def test_pairs_of_a_frequent_name_are_many_tasks(spark):
    """All pairs of alike rows, of which no partition lists more than its share."""
    from evidra.operators import vocabulary

    rows = [("b", "red bolt", k) for k in range(60)] + [("b", "red bold", k) for k in range(60, 70)] + [("c", "red bolt", 99), ("b", None, 100)]
    table = spark.createDataFrame(rows, "brand string, name string, key long")
    alike = vocabulary.similar_names(table, ["brand"]).withColumn("edits", F.levenshtein("a", "b"))
    out = vocabulary.listed_pairs(table, alike, ["brand"], block=10, task=200).withColumn("p", F.spark_partition_id()).collect()
    assert sorted((r.left_key, r.right_key, r.edits) for r in out) == [(i, j, int((i < 60) != (j < 60))) for i in range(70) for j in range(i + 1, 70)]
    assert max(sum(r.p == p for r in out) for p in {r.p for r in out}) < len(out) / 4
