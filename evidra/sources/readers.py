"""Readers: probe results, corpora of clauses, lexicons, labels, sidecars, waveforms and media headers as tables."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.functions.text import plain_text
from pyspark.sql import types as T

from evidra.functions.text import fraction

_STREAM = "struct<codec_type:string,codec_name:string,profile:string,width:string,height:string,pix_fmt:string,bits_per_raw_sample:string,avg_frame_rate:string,r_frame_rate:string,color_transfer:string,sample_rate:string,channels:string,tags:map<string,string>,side_data_list:array<map<string,string>>>"
PROBE = f"struct<format:struct<format_name:string,duration:string,bit_rate:string,size:string>,streams:array<{_STREAM}>>"
#: How containers begin, as (offset, bytes in hexadecimal, name).
MAGIC = ((4, "66747970", "mp4"), (0, "1a45dfa3", "matroska"), (0, "52494646", "riff"), (0, "4f676753", "ogg"), (0, "fffb", "mp3"), (0, "494433", "mp3"), (0, "89504e47", "png"), (0, "ffd8ff", "jpeg"), (0, "3c68746d6c", "html"))
MIN_BYTES = 1024


def bit_depth(pix_fmt: Column, raw: Column) -> Column:
    named = F.regexp_extract(pix_fmt, r"p(9|10|12|14|16)(?:le|be)?$", 1).try_cast("int")
    return F.coalesce(raw.try_cast("int"), named, F.when(pix_fmt.isNotNull(), 8))


def chroma(pix_fmt: Column) -> Column:
    return F.when(pix_fmt.rlike("444"), "4:4:4").when(pix_fmt.rlike("422"), "4:2:2").when(pix_fmt.rlike("420|nv12"), "4:2:0").when(pix_fmt.rlike("gray"), "4:0:0")


def hdr_class(transfer: Column) -> Column:
    return F.when(transfer == "smpte2084", "PQ").when(transfer == "arib-std-b67", "HLG").when(transfer.isNotNull(), "SDR")


def variable_rate(average: Column, real: Column) -> Column:
    """Whether the two rates differ by more than a hundredth; null where either is unknown."""
    a, b = fraction(average, 0.0), fraction(real, 0.0)
    return F.when((a > 0) & (b > 0), F.abs(a - b) / F.greatest(a, b) > 0.01)


def probe_profiles(raw: DataFrame) -> DataFrame:
    """One row for each probe result ``raw(path, json)``: container, first picture, sound and subtitle tracks. What is absent is null."""
    p = raw.select("path", F.from_json("json", PROBE).alias("p"))
    kind = lambda k: F.filter("p.streams", lambda s: s["codec_type"] == k)
    v = F.get(kind("video"), 0)
    return p.select(
        "path", F.col("p.format.format_name").alias("container"), (F.col("p.format.duration").try_cast("double") * 1000).cast("long").alias("duration_ms"),
        v["codec_name"].alias("codec"), v["width"].try_cast("int").alias("width"), v["height"].try_cast("int").alias("height"), bit_depth(v["pix_fmt"], v["bits_per_raw_sample"]).alias("bit_depth"),
        chroma(v["pix_fmt"]).alias("chroma"), hdr_class(v["color_transfer"]).alias("hdr"), fraction(v["avg_frame_rate"], 0.0).alias("fps"), variable_rate(v["avg_frame_rate"], v["r_frame_rate"]).alias("variable_rate"),
        F.transform(kind("audio"), lambda s: F.struct(s["codec_name"].alias("codec"), s["sample_rate"].try_cast("int").alias("rate"), s["channels"].try_cast("int").alias("channels"))).alias("audio"),
        F.transform(kind("subtitle"), lambda s: F.try_element_at(s["tags"], F.lit("language"))).alias("subtitles"),
    )


def sniff(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Files by what they begin with: (accepted with their container, rejected with the reason)."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", F.hex(F.substring("content", 1, 16)).alias("head"))
    known = F.coalesce(*(F.when(F.lower(F.substring("head", 2 * at + 1, len(magic))) == magic, name) for at, magic, name in MAGIC))
    seen = files.withColumn("container", known)
    media = seen["container"].isin("mp4", "matroska", "riff", "ogg", "mp3") & (F.col("length") >= MIN_BYTES)
    good = F.coalesce(media, F.lit(False))
    reason = F.when(F.col("length") < MIN_BYTES, "too small").when(F.col("container").isNull(), "unknown header").otherwise(F.concat(F.lit("not media: "), "container"))
    return seen.filter(good).drop("head"), seen.filter(~good).select("path", reason.alias("reason"))


def clause_corpus(spark: SparkSession, path: str) -> DataFrame:
    """clause_id, title, fields, sections and sha256 of markdown files with ``key: value`` lines between ``---`` and ``## `` sections."""
    t = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "\r\n", "\n").alias("text"), F.sha2("value", 256).alias("sha256"))
    head = F.regexp_extract("text", r"(?s)\A---\n(.*?)\n---\n", 1)
    pairs = F.filter(F.split(head, "\n"), lambda x: x.contains(":"))
    keys, values = F.transform(pairs, lambda x: F.trim(F.substring_index(x, ":", 1))), F.transform(pairs, lambda x: F.trim(F.regexp_replace(x, "^[^:]*:", "")))
    body = F.regexp_replace("text", r"(?s)\A---\n.*?\n---\n", "")
    parts = F.filter(F.array_compact(F.array_except(F.split(F.concat(F.lit("\n"), body), "\n## "), F.slice(F.split(F.concat(F.lit("\n"), body), "\n## "), 1, 1))), lambda x: F.btrim(F.regexp_replace(x, r"\A[^\n]*\n?", ""), F.lit(" \n\t")) != "")
    name = F.transform(parts, lambda x: F.trim(F.substring_index(F.substring_index(x, "\n", 1), "(", 1)))
    text = F.transform(parts, lambda x: F.btrim(F.regexp_replace(x, r"\A[^\n]*\n?", ""), F.lit(" \n\t")))
    fields = F.map_from_arrays(keys, values)
    return t.select(F.try_element_at(fields, F.lit("clause_id")).alias("clause_id"), F.try_element_at(fields, F.lit("title")).alias("title"), fields.alias("fields"), F.map_from_arrays(name, text).alias("sections"), "sha256")


def chunks(corpus: DataFrame, advisory: str = "advisory") -> DataFrame:
    """id, clause_id, section and text of every section that isn't advisory."""
    s = corpus.select("clause_id", F.explode("sections").alias("section", "text")).filter(~F.lower("section").contains(advisory))
    return s.select(F.concat_ws("#", "clause_id", "section").alias("id"), "clause_id", "section", "text")


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """event, term, severity and form (lower case) of JSON lines {event, terms: [{term, severity, forms}]}; phrases have more words."""
    schema = "event string, terms array<struct<term:string,severity:string,forms:array<string>>>"
    t = spark.read.schema(schema).json(path, multiLine=True).select("event", F.explode("terms").alias("t"))
    forms = F.array_distinct(F.transform(F.concat(F.array("t.term"), F.coalesce("t.forms", F.array().cast("array<string>"))), F.lower))
    return t.select("event", "t.term", "t.severity", F.explode(forms).alias("form")).withColumn("n", F.size(F.split("form", " ")))


def cue_lists(spark: SparkSession, path: str) -> DataFrame:
    """file, list, place, phrase and n (words) of JSON files whose fields are lists of phrases, or objects of such lists.

    A list within an object is named ``field.name``; phrases are in lower case with single spaces, and fields that are
    neither are left out, as are blank phrases.
    """
    fields = F.explode(F.from_json("value", "map<string, variant>")).alias("field", "v")
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), fields)
    plain = t.select("file", F.col("field").alias("list"), F.try_variant_get("v", "$", "array<string>").alias("phrases"))
    inner = t.select("file", "field", F.explode(F.try_variant_get("v", "$", "map<string, array<string>>")).alias("name", "phrases"))
    both = plain.filter("phrases is not null").unionByName(inner.select("file", F.concat_ws(".", "field", "name").alias("list"), "phrases").filter("phrases is not null"))
    each = both.select("file", "list", F.posexplode("phrases").alias("place", "phrase")).withColumn("phrase", plain_text(F.col("phrase")))
    return each.filter("phrase <> ''").withColumn("n", F.size(F.split("phrase", " ")))


def cue_settings(spark: SparkSession, path: str) -> DataFrame:
    """file, name and value (as text) of the fields of JSON files that are single numbers, texts or truths; notes (``_name``) are none."""
    fields = F.explode(F.from_json("value", "map<string, variant>")).alias("name", "v")
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), fields).filter(~F.col("name").startswith("_"))
    single = ~F.schema_of_variant("v").rlike("^(ARRAY|OBJECT|VOID)")
    return t.filter(single).select("file", "name", F.try_variant_get("v", "$", "string").alias("value"))


def role_rules(spark: SparkSession, path: str) -> DataFrame:
    """role, rule and value of a JSON file {roles: {role: {rule: number}}}; a file without roles has no rows."""
    roles = F.from_json(F.get_json_object("value", "$.roles"), "map<string, map<string, string>>")
    t = spark.read.text(path, wholetext=True).select(F.explode(roles).alias("role", "rules"))
    return t.select("role", F.explode("rules").alias("rule", "value")).withColumn("value", F.col("value").try_cast("double")).filter("value is not null")


def labels(spark: SparkSession, path: str) -> DataFrame:
    schema = "clip string, label string, clause string, span_ms array<bigint>, expect_findings string, twin_of string, note string"
    return spark.read.schema(schema).json(path).withColumn("twin_of", F.regexp_replace("twin_of", r"\.mp4$", "")).withColumn("clip", F.regexp_replace("clip", r"\.mp4$", ""))


def with_sidecars(clips: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """Clips with the title, description and tags of their ``*.meta.json``; a malformed file is as good as none."""
    schema = "title string, description string, tags array<string>, _bad string"
    s = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_bad").json(path, multiLine=True).withColumn("clip", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.mp4)?\.meta\.json$", 1))
    return clips.join(s.filter("_bad is null").drop("_bad"), "clip", "left")


def wav_samples(spark: SparkSession, path: str) -> DataFrame:
    """path, rate, channel and samples (-1 to 1) of PCM files of 8 (unsigned), 16 or 32 bits; a row for each channel."""
    import io
    import wave

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for r in part.itertuples():
                with wave.open(io.BytesIO(r.content)) as w:
                    data, width, n, rate = w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels(), w.getframerate()
                if width == 1:
                    x = (np.frombuffer(data, np.uint8).astype(np.float64) - 128) / 128
                else:
                    x = np.frombuffer(data, {2: "<i2", 4: "<i4"}[width]).astype(np.float64) / float(1 << (8 * width - 1))
                rows += [(r.path, rate, c, x[c::n].tolist()) for c in range(n)]
            yield pd.DataFrame(rows, columns=["path", "rate", "channel", "samples"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, rate int, channel int, samples array<double>")


def _balanced(text: str) -> str | None:
    """The outermost JSON value that a text holds; brackets inside its strings don't count."""
    start = next((i for i, c in enumerate(text) if c in "{["), None)
    if start is None:
        return None
    depth, quoted, escaped = 0, False, False
    for i in range(start, len(text)):
        c = text[i]
        if quoted:
            escaped, quoted = (not escaped and c == "\\"), escaped or c != '"'
        elif c == '"':
            quoted = True
        else:
            depth += (c in "{[") - (c in "}]")
            if depth == 0:
                return text[start : i + 1]
    return None


def _repaired(text: str | None) -> str | None:
    if text is None:
        return None
    bare = re.sub(r"^\s*```\w*\s*|\s*```\s*$", "", text)
    for candidate in (bare, _balanced(bare) or "", re.sub(r",\s*([}\]])", r"\1", _balanced(bare) or "")):
        try:
            return json.dumps(json.loads(candidate))
        except ValueError:
            continue
    return None


@F.pandas_udf(T.StringType())
def repair_json(text: pd.Series) -> pd.Series:
    """JSON from a chatty answer: fences off, the outermost value, trailing commas out; null if there is none."""
    return text.map(_repaired)


_ITEM = "struct<label:string,category:string,confidence:string,bbox:array<double>>"


def parse_observations(answers: DataFrame, vocabulary: list[str]) -> tuple[DataFrame, DataFrame]:
    """``answers(frame, text)`` as (observations, rejects with their reason); bare lists, single records and four wrapper keys are read."""
    j = answers.select("frame", repair_json("text").alias("j"))
    lists = [F.from_json(F.get_json_object("j", f"$.{k}"), f"array<{_ITEM}>") for k in ("observations", "objects", "detections", "items")]
    bare = F.when(F.col("j").startswith("["), F.from_json("j", f"array<{_ITEM}>"))
    single = F.when(F.get_json_object("j", "$.label").isNotNull(), F.array(F.from_json("j", _ITEM)))
    items = j.select("frame", "j", F.coalesce(*lists, bare, single).alias("items"))
    each = items.select("frame", F.explode("items").alias("o")).select("frame", F.lower(F.trim("o.label")).alias("label"), F.col("o.category").alias("category"), F.col("o.confidence").try_cast("double").alias("confidence"), F.col("o.bbox").alias("bbox"))
    reason = F.when(~F.coalesce(F.col("label").isin(vocabulary), F.lit(False)), "unknown label").when(F.col("confidence").isNull() | ~F.col("confidence").between(0, 1), "bad confidence")
    judged = each.withColumn("reason", reason)
    unread = items.filter("items is null").select("frame", F.lit(None).cast("string").alias("label"), F.lit("unreadable").alias("reason"))
    return judged.filter("reason is null").drop("reason"), judged.filter("reason is not null").select("frame", "label", "reason").union(unread)
