"""Alignment of two tokenizers against plain loops over the libraries' own tokens."""

import functools
import hashlib
import os
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyarrow.fs import FileSystem
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from evidra.llm import cross_alignment as ca
from evidra.llm import queries
from evidra.session import shared_path

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path(queries.RECORD_TOKENIZER), public_tokenizers.path(queries.PIECES)


@functools.cache
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B)


def tokens(text):
    """Ids and bytes of both tokenizers' tokens of whole texts."""
    a, b = libraries()
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [k for k in range(256) if k not in own]
    byte_of = {chr(k): k for k in own} | {chr(256 + n): k for n, k in enumerate(rest)}
    found = a.encode(" " + text, add_special_tokens=False)
    in_a = [(k, bytes(byte_of[c] for c in t)) for k, t in zip(found.ids, found.tokens)]
    in_b = []
    for k in b.encode(text):
        piece = b.id_to_piece(k)
        in_b.append((k, bytes([int(piece[3:5], 16)]) if piece.startswith("<0x") and len(piece) == 6 and b.is_byte(k) else piece.replace("▁", " ").encode()))
    return in_a, in_b


def ends(items):
    at, out = 0, []
    for k, data in items:
        at += len(data)
        out.append((at, k))
    return out


def brute(texts):
    links, docs, count = {}, {}, Counter()
    for d, text in texts:
        docs[d] = (0, 0, 0, "")
        links[d] = []
        if not text:
            continue
        in_a, in_b = tokens(text)
        joined = [b"".join(x for _, x in side) for side in (in_a, in_b)]
        if joined[0] != b" " + text.encode() or joined[1] != b" " + text.encode():
            continue
        ea, eb = ends(in_a), ends(in_b)
        common = sorted({e for e, _ in ea} & {e for e, _ in eb})
        last, groups = 0, []
        for c in common:
            groups.append(",".join(str(k) for e, k in ea if last < e <= c) + "|" + ",".join(str(k) for e, k in eb if last < e <= c))
            last = c
        of_b = dict(eb)
        links[d] = [(k, of_b[e]) for e, k in ea if e in of_b]
        count.update(links[d])
        docs[d] = (len(ea), len(eb), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest())
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    return {d: (*docs[d][:3], len(links[d]), sum(count[x] == best[x[1]] for x in links[d]), sum(count[x] for x in links[d]), docs[d][3]) for d in docs}, count


def odd_texts():
    pick = random.Random(3)
    bits = ["the", " the", " of", "  ", " ", "a", "\n", "é", "漢字", "😀", "<|endoftext|>", "<s>", "</s>", "<0x41>", "12", "'s", "\t", " ", " ", "!", "\x00", "́"]
    texts = ["".join(pick.choice(bits) for _ in range(pick.randint(1, 30))) for _ in range(150)]
    return [*texts, "", None, " ", "  ", "a ", " a", "\n", "x ▁ y", "▁", "a▁b", "ab " * 20_000, "q" * 3_000, "the cat sat", "the cat sat", "ﬁ ½"]


def columns(rows):
    return {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows}


def test_odd_rows(spark):
    texts = list(enumerate(odd_texts()))
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("links", F.lit(1)).withColumn("n_a", F.lit("x")).repartition(3)
    wanted, _ = brute(texts)
    assert columns(ca.cross_align(docs, A, B).collect()) == wanted
    assert any(not w[0] and t for (_, t), w in zip(texts, wanted.values()))  # some text's bytes don't come back
    twice = docs.limit(0).union(spark.createDataFrame([(None, "the cat"), (None, "the cat")], "doc_id long, text string").withColumn("links", F.lit(1)).withColumn("n_a", F.lit("x")))
    out = ca.cross_align(twice, A, B).collect()
    assert [(r.doc_id, r.n_links, r.n_best, r.count_sum) for r in out] == [(None, 2, 2, 4)] * 2


def test_counts_equal_whatever_the_partitions(spark, monkeypatch):
    """Partials that are handed on early, keys of many partitions, runs across batches."""
    monkeypatch.setattr(ca, "MERGE", 50)
    texts = [(k, t) for k, t in enumerate(odd_texts()) if t and len(t) < 1000]
    aligned = ca.align(spark.createDataFrame(texts, "doc_id long, text string").repartition(7), A, B)
    _, count = brute(texts)
    total = Counter()
    for r in ca.partial_counts(aligned).collect():
        total[r.key] += r.n
    assert total == Counter({b << 32 | a: n for (a, b), n in count.items()})
    path = shared_path(spark, "pairs")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        manifest = ca.count_links(aligned, path).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sum(r.n for r in manifest) == len(count) and len(manifest) > 1
    order = sorted(manifest, key=lambda r: r["first"])
    assert all(x["last"] < y["first"] for x, y in zip(order, order[1:]))
    keys = np.array(sorted(total) + [max(total) + 1], np.int64)
    for local in (True, False):
        counts = ca.SortedCounts(path, [(r["shard"], r["first"], r["last"]) for r in manifest])
        if not local:  # as a store that can't be mapped
            counts.fs = Store(counts.fs)
        assert counts.look_up(keys).tolist() == [total[k] for k in keys.tolist()]
    assert not [f for f in os.listdir(FileSystem.from_uri(path)[1]) if f.startswith("_attempt")]


class Store:
    def __init__(self, fs):
        self.fs = fs

    def open_input_file(self, name):
        return self.fs.open_input_file(name)


def test_a_vocabulary_that_goes_on_after_spaces_is_refused(monkeypatch):
    class Model(SentencePieceProcessor):
        def id_to_piece(self, k):
            return "a▁b" if k == 300 else super().id_to_piece(k)

    monkeypatch.setattr(ca, "SentencePieceProcessor", Model)
    with pytest.raises(ValueError):
        ca.PieceEncoder(open(B, "rb").read())


def test_query_on_the_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = queries.op13_cross_alignment(spark, SF)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    docs = [(d, t) for d, t in docs]
    assert columns(found.collect()) == brute(docs)[0]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ca.cross_align(docs, A, B).count() == 0
    assert ca.cross_align(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), A, B).count() == 2
