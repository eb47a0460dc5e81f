import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from evidra.llm import queries
from evidra.llm.fill_middle import LINES, count_units, cut_places, fill_in_middle, restore

SF = "/root/testdata/sf0.001"


def plain(doc_id, text, rate=100, spm_rate=50):
    """The contract with a list of units."""
    text = text or ""
    units = re.findall(LINES, text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in range(0, 32, 8))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return (n, "plain", None, None, text)
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    if h4 % 100 < spm_rate:
        return (n, "spm", len(prefix), len(middle), "<S>" + suffix + "<P>" + prefix + "<M>" + middle)
    return (n, "psm", len(prefix), len(middle), "<P>" + prefix + "<S>" + suffix + "<M>" + middle)


def odd_rows():
    pick = random.Random(2)
    bits = ["a", "\n", "\n\n", "é漢", "😀", "<", "<P", "S>", "<M", ">", " ", "\r\n", " ", "<P>"]
    texts = ["", None, "\n", "x", "x\n", "<M>", "a\n<S>\nb", "<P\n<S\n<M\n>", "long line " * 50_000, "l\n" * 100_000]
    return list(enumerate(texts + ["".join(pick.choice(bits[:-1] if k % 5 else bits) for _ in range(pick.randint(0, 40))) for k in range(300)]))


def rows(spark):
    data = odd_rows() + [(5, "tie\ntie\n"), (5, "tie\ntie\n"), (None, "a\nb\nc\n"), (None, None)]
    return spark.createDataFrame(data, "doc_id long, text string").withColumn("n", F.lit("c")).withColumn("form", F.lit(1)).withColumn("output", F.lit(2.0))


@pytest.mark.parametrize("rate, spm_rate", [(100, 50), (30, 0), (0, 100)])
def test_equals_the_contract_with_lists(spark, rate, spm_rate):
    docs = rows(spark)
    out = fill_in_middle(docs, rate=rate, spm_rate=spm_rate).withColumn("restored", restore(F.col("output"), F.col("form"))).collect()
    found = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out), key=repr)
    assert found == sorted(((d, *plain(d, t, rate, spm_rate)) for d, t in docs.select("doc_id", "text").collect()), key=repr)
    assert sorted(r.restored for r in out) == sorted(r.text or "" for r in docs.collect())


def test_query_on_the_table(spark):
    wanted = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        n, form, prefix, middle, output = plain(r.doc_id, r.text)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        wanted[r.doc_id] = (n, form, prefix, middle, sha(output), sha(r.text or ""))
    found = {r[0]: tuple(r)[1:] for r in queries.op11_fill_middle(spark, SF).collect()}
    assert found == wanted


def test_other_units_and_marks(spark):
    marks = ("\x02pre", "\x02suf", "\x02mid")
    docs = spark.createDataFrame([(k, " ".join(f"w{i}" for i in range(k))) for k in range(40)], "doc_id long, text string")
    out = fill_in_middle(docs, units=r"\S+\s*", seed="s", marks=marks).withColumn("restored", restore(F.col("output"), F.col("form"), marks))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in out.collect():
        assert r.restored == texts[r.doc_id] and r.n == len(texts[r.doc_id].split())
    for bad in [("<P>", "<P>", "<M>"), ("<P>", "S>", "<M>"), ("<<", "<S", "<M")]:
        with pytest.raises(ValueError):
            fill_in_middle(docs, marks=bad)


def test_no_more_matches_than_needed():
    """The second pass stops at the later rank, and no pass keeps its matches."""
    class Counted:
        made = 0

        def finditer(self, text):
            for m in re.finditer(LINES, text):
                Counted.made += 1
                yield m

    text = "a\n" * 1000
    assert count_units(Counted(), text) == 1000
    Counted.made = 0
    assert cut_places(Counted(), text, 3, 10) == (6, 20) and Counted.made == 10
    Counted.made = 0
    assert cut_places(Counted(), text, 0, 0) == (0, 0) and Counted.made == 0


def test_empty_table(spark):
    assert fill_in_middle(rows(spark).limit(0)).count() == 0
