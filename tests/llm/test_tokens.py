import base64
import functools
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evidra.llm import bpe, queries, token_records
from evidra.llm.chunks import ChunkEncoder
from evidra.llm.library_bpe import LibraryEncoder
from evidra.session import shared_path

ODD = ["", " ", "  ", "a  b", " a", "a ", "x\n\ny z", "<|endoftext|> x", "漢字 é😀 it's 12", "a" * 3000, "\x1c b\x85c"]


def odd_texts():
    pick = random.Random(7)
    letters = "ab  \n\t é漢字123'st!?  \x1c\x85😀"
    return ODD + ["".join(pick.choice(letters) for _ in range(pick.randint(0, 50))) for _ in range(400)]


def own():
    data = open(public_tokenizers.path(queries.RANKS), "rb").read()
    return data, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(data), special_tokens={})


@functools.cache
def library():
    return Tokenizer.from_file(public_tokenizers.path(queries.RECORD_TOKENIZER))


def test_matrices_equal_tiktoken():
    data, expected = own()
    codec, texts = bpe.Codec(data, public_tokenizers.PATTERN), odd_texts()
    for _ in range(2):
        ids, at = codec.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [expected.encode_ordinary(t) for t in texts]
    assert bpe.Decoder(data).decode(ids)[0].tobytes() == "".join(texts).encode()


def test_pieces_by_themselves_equal_tiktoken(monkeypatch):
    """Any ranks, also those that no training would give."""
    monkeypatch.setattr(bpe, "LONG", 1)
    pick = random.Random(5)
    for _ in range(60):
        tokens = {bytes([b]) for b in range(256)} | {bytes(pick.choice(b"abc") for _ in range(pick.randint(2, 5))) for _ in range(40)}
        tokens = sorted(tokens, key=lambda t: (len(t) > 1, pick.random()))
        ranks = {t: k for k, t in enumerate(tokens)}
        data = b"\n".join(base64.b64encode(t) + b" %d" % k for t, k in ranks.items())
        codec, expected = bpe.Codec(data, "[a-z]+"), tiktoken.Encoding("own", pat_str="[a-z]+", mergeable_ranks=ranks, special_tokens={})
        pieces = ["".join(pick.choice("abc") for _ in range(pick.randint(1, 40))) for _ in range(40)]
        flat, sizes = codec.encode_pieces([p.encode() for p in pieces])
        assert [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])] == [expected.encode_ordinary(p) for p in pieces]


def test_long_pieces_equal_tiktoken():
    data, expected = own()
    codec, pick = bpe.Codec(data, public_tokenizers.PATTERN), random.Random(8)
    texts = ["a" * 5001, "ab" * 3000, "the" * 40_000, "".join(pick.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60_000)), "aaab" * 700 + "é" * 900, "漢字" * 2000]
    ids, at = codec.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [expected.encode_ordinary(t) for t in texts]


def test_op4_on_a_very_long_text(spark):
    text = " ".join(f"w{k * k}" for k in range(400_000)) + "x" * 50_000
    where = shared_path(spark, "records")
    manifest = token_records.write_records(spark.createDataFrame([(1, text), (2, "end")], "doc_id long, text string"), where, public_tokenizers.path(queries.RECORD_TOKENIZER), 2, shards=2)
    found = {r.doc_id: (r.start, bytes(r.ids)) for r in token_records.read_records(spark, where, manifest).collect()}
    ids = library().encode(text, add_special_tokens=False).ids + [2]
    assert found[1] == (0, np.array(ids, "<u4").tobytes()) and found[2][0] == len(ids)


def test_forgetting_chunks_changes_nothing():
    data, expected = own()
    codec = bpe.Codec(data, public_tokenizers.PATTERN)
    codec.chunks = ChunkEncoder(codec._encode_chunks, remembered=20)
    texts = odd_texts()
    for i in range(0, len(texts), 9):
        ids, at = codec.encode(texts[i : i + 9])
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [expected.encode_ordinary(t) for t in texts[i : i + 9]]


def test_joined_chunks_equal_the_library():
    texts = odd_texts()
    ids, at = LibraryEncoder(open(public_tokenizers.path(queries.RECORD_TOKENIZER), "rb").read()).encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [library().encode(t, add_special_tokens=False).ids for t in texts]


SPECIAL = "<|endoftext|>"


@pytest.mark.parametrize("text", [f"hello {SPECIAL} world", SPECIAL, f"{SPECIAL}x", f"x{SPECIAL}", f" {SPECIAL} ", f"a  {SPECIAL}  b", f"a\n{SPECIAL}\n\nb", SPECIAL * 3, f"{SPECIAL[:-1]} {SPECIAL[1:]}", f"it's{SPECIAL}'s"])
def test_special_tokens_as_the_library_does(text):
    encoder = LibraryEncoder(open(public_tokenizers.path(queries.RECORD_TOKENIZER), "rb").read())
    ids, at = encoder.encode([text, "other words " + text + " and more", text])
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [library().encode(t, add_special_tokens=False).ids for t in (text, "other words " + text + " and more", text)]
    assert (50256 in ids.tolist()) == (SPECIAL in text)


def docs(spark):
    rows = [(k, t) for k, t in enumerate(odd_texts())] + [(3, "again"), (3, "again"), (None, "no id"), (900, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("start", F.lit("x"))


def test_op6_on_odd_rows(spark):
    path = public_tokenizers.path(queries.RANKS)
    _, expected = own()
    out = bpe.encode(docs(spark), path, public_tokenizers.PATTERN, decoded=True).collect()
    again = bpe.decode(bpe.encode(docs(spark), path, public_tokenizers.PATTERN), path).collect()
    assert sorted(bytes(r.decoded) for r in out) == sorted(bytes(r.decoded) for r in again)
    found = sorted((r.doc_id is None, r.doc_id or 0, hashlib.sha256(r.ids).hexdigest(), r.n_tokens, bytes(r.decoded)) for r in out)
    wanted = []
    for r in docs(spark).collect():
        ids = expected.encode_ordinary(r.text or "")
        wanted.append((r.doc_id is None, r.doc_id or 0, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), len(ids), (r.text or "").encode()))
    assert found == sorted(wanted)


def test_op4_round_trip(spark):
    path = shared_path(spark, "records")
    manifest = token_records.write_records(docs(spark), path, public_tokenizers.path(queries.RECORD_TOKENIZER), 2, shards=3)
    found = sorted((r.start, r.doc_id, bytes(r.ids)) for r in token_records.read_records(spark, path, manifest).collect())
    wanted, start = [], 0
    rows = docs(spark).collect()
    order = {t: k for k, (t,) in enumerate(docs(spark).select("text").distinct().orderBy(F.xxhash64("text"), "text").collect())}
    for r in sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0, order[r.text])):
        ids = library().encode(r.text or "", add_special_tokens=False).ids + [2]
        wanted.append((start, r.doc_id, np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert found == wanted
    first = manifest.orderBy("shard").first()
    k = first.n_records - 1
    assert token_records.fetch_record(path, first.shard, k).astype("<u4").tobytes() == wanted[k][2]


def test_damage_is_found():
    data = bytearray(token_records.frame(b"abcdef"))
    for k in (0, 9, 13, len(data) - 1):
        bad = bytearray(data)
        bad[k] ^= 1
        at = 0

        def read(n):
            nonlocal at
            at += n
            return bytes(bad[at - n : at])

        with pytest.raises(ValueError):
            token_records.read_frame(read)
    assert zlib.crc32(b"") == 0 and token_records.masked_crc(b"") == token_records.MASK_DELTA


def test_empty_tables(spark):
    none = docs(spark).limit(0)
    path = public_tokenizers.path(queries.RANKS)
    assert bpe.decode(bpe.encode(none, path, public_tokenizers.PATTERN), path).count() == 0
    where = shared_path(spark, "records")
    manifest = token_records.write_records(none, where, public_tokenizers.path(queries.RECORD_TOKENIZER), 2)
    assert token_records.read_records(spark, where, manifest).count() == 0
