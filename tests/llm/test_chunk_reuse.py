"""Content-defined chunks against the tokenizers library itself, with its own treatment of special tokens' strings."""

import functools
import hashlib
import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evidra.llm import chunk_reuse, queries

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path(queries.RECORD_TOKENIZER)


@functools.cache
def library():
    return Tokenizer.from_file(PATH)


def ids_of(text):
    return library().encode(text or "", add_special_tokens=False).ids


def odd_texts(n=400):
    pick = random.Random(5)
    bits = ["a", "b", " ", "  ", "\n", "'", "'re", "'s", "<|endoftext|>", "<|endof", "text|>", "12", "é", "漢字", "😀", " ", "!!", "word", " the", "\t"]
    texts = ["".join(pick.choice(bits) for _ in range(pick.randint(0, 600))) for _ in range(n)]
    long = ["a" * 50_000, "ab" * 9_000, " " * 20_000 + "x", "'s" * 5_000, "<|endoftext|>" * 2_000, "é" * 9_000, "x<" * 5_000, "".join(pick.choice("abcdefgh") for _ in range(40_000))]
    return [*texts, *long, "", "a", None, "<|endoftext|>", "a <|endoftext|> b", "  <|endoftext|>  ", texts[0], texts[0] + texts[1]]


@pytest.mark.parametrize("bits, least, first", [(9, 64, 48), (4, 4, 0), (1, 1, 0)])
def test_equals_the_library(monkeypatch, bits, least, first):
    """Also with chunks of a few bytes, and with windows that begin too narrow to agree."""
    for name, value in (("BITS", bits), ("LEAST", least), ("FIRST", first)):
        monkeypatch.setattr(chunk_reuse, name, value)
    texts = odd_texts(400 if bits > 1 else 60)
    encoder = chunk_reuse.ReusingEncoder(open(PATH, "rb").read())
    ids, at = encoder.encode(pa.array(texts))
    assert [ids[i:j].tolist() for i, j in zip(at, at[1:])] == [ids_of(t) for t in texts]


def test_joins_need_their_repair():
    """Chunks by themselves give other ids."""
    encoder = chunk_reuse.ReusingEncoder(open(PATH, "rb").read())
    text = " ".join(f"word{k} of some prose" for k in range(2000))
    data = np.frombuffer(text.encode(), np.uint8)
    starts = [*chunk_reuse.chunk_starts(data, np.array([0, len(data)]), encoder.values).tolist(), len(data)]
    assert len(starts) > 20
    alone = [k for i, j in zip(starts, starts[1:]) for k in ids_of(text[i:j])]
    ids, _ = encoder.encode(pa.array([text]))
    assert ids.tolist() == ids_of(text) != alone


def test_shared_chunks_are_encoded_once():
    encoder = chunk_reuse.ReusingEncoder(open(PATH, "rb").read())
    pick = random.Random(4)
    body = " ".join(f"w{pick.randrange(10**6)}" for _ in range(5000))
    encoder.encode(pa.array([body]))
    strings = []
    inner, encoder.memory.encode = encoder.memory.encode, lambda s: strings.extend(s) or inner(s)
    texts = ["Another beginning, " + body, "x" * 77 + " " + body, body]
    ids, at = encoder.encode(pa.array(texts))
    assert [ids[i:j].tolist() for i, j in zip(at, at[1:])] == [ids_of(t) for t in texts]
    assert sum(map(len, strings)) < 0.1 * sum(map(len, texts))


def test_forgetting_changes_nothing():
    encoder = chunk_reuse.ReusingEncoder(open(PATH, "rb").read(), remembered=500)
    texts = odd_texts(100)
    for i in range(0, len(texts), 7):
        ids, at = encoder.encode(pa.array(texts[i : i + 7]))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [ids_of(t) for t in texts[i : i + 7]]


def test_odd_rows(spark):
    rows = list(enumerate(odd_texts(60))) + [(3, "again"), (3, "again"), (None, "no id"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("n_tokens", F.lit("x")).withColumn("decoded", F.lit(0))
    out = chunk_reuse.encode(docs, PATH, decoded=True)
    found = sorted(((r.doc_id, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in out.collect()), key=repr)
    assert found == sorted(((d, len(ids_of(t)), ids_of(t), t or "") for d, t in rows), key=repr)
    again = chunk_reuse.decode(chunk_reuse.encode(docs, PATH), PATH)
    assert sorted(r.decoded for r in again.collect()) == sorted(t or "" for _, t in rows)
    assert chunk_reuse.encode(docs.limit(0), PATH, decoded=True).count() == 0


def test_decoding_any_ids(spark):
    pick = random.Random(9)
    lists = [[pick.randrange(50257) for _ in range(pick.randint(0, 30))] for _ in range(200)]
    rows = spark.createDataFrame([(k, bytearray(np.array(x, "<u4").tobytes())) for k, x in enumerate(lists)] + [(1000, None)], "doc_id long, ids binary")
    found = {r.doc_id: r.decoded for r in chunk_reuse.decode(rows, PATH).collect()}
    assert found == {k: library().decode(x, skip_special_tokens=False) for k, x in enumerate(lists)} | {1000: ""}


def test_query_on_the_table(spark):
    wanted = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = ids_of(r.text)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        wanted[r.doc_id] = (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library().decode(ids, skip_special_tokens=False).encode()))
    assert {r[0]: tuple(r)[1:] for r in queries.op12_chunk_reuse(spark, SF).collect()} == wanted
