import json
import os

import pytest
from pyspark.sql import functions as F

from evidra.sources import promotion
from evidra.sources.promotion import RefusedError, promote, recover

NAMES = ["report", "captions", "sarif"]


def outputs(spark, version, names=NAMES):
    return {n: spark.range(20).select("id", F.lit(f"{n} v{version}").alias("body")).repartition(3) for n in names}


def seen(target):
    """What readers find: the versions of each output, and what else lies there."""
    found = {}
    for name in sorted(os.listdir(target)):
        if name.startswith("_"):
            found[name.split("-")[0]] = True
            continue
        lines = [json.loads(x) for f in os.listdir(f"{target}/{name}") if f.endswith(".json") for x in open(f"{target}/{name}/{f}")]
        found[name] = {x["body"] for x in lines}, len(lines)
    return found


def version(v, names=NAMES):
    return {n: ({f"{n} v{v}"}, 20) for n in sorted(names)}


class Failing:
    """A store whose n-th rename fails, or after whose n-th rename the process dies."""

    def __init__(self, fs, after, dies):
        self.fs, self.left, self.dies, self.dead = fs, after, dies, False

    def __getattr__(self, name):
        if self.dead:
            raise SystemExit("dead")
        return getattr(self.fs, name)

    def move(self, a, b):
        if self.dead:
            raise SystemExit("dead")
        if self.left == 0 and not self.dies:
            self.left -= 1
            raise OSError("the store failed")
        self.fs.move(a, b)
        self.left -= 1
        if self.left == 0 and self.dies:
            self.dead = True
            raise SystemExit("dead")


def test_all_or_none(spark, tmp_path):
    target = f"{tmp_path}/out"
    promote(outputs(spark, 1), f"file://{target}")
    assert seen(target) == version(1)
    promote(outputs(spark, 2), f"file://{target}")
    assert seen(target) == version(2)
    promote(outputs(spark, 3, ["report", "new"]), f"file://{target}")
    assert seen(target) == version(2, ["captions", "sarif"]) | version(3, ["report", "new"])


@pytest.mark.parametrize("after", range(7))
def test_a_failure_between_two_files_leaves_the_old_set(spark, tmp_path, monkeypatch, after):
    target = f"{tmp_path}/out"
    promote(outputs(spark, 1, ["report", "captions"]), f"file://{target}")
    swap = promotion._swap
    monkeypatch.setattr(promotion, "_swap", lambda fs, *rest: swap(Failing(fs, after, False), *rest))
    if after < 6:  # the journal's own rename, two for each output that was there, one for the new one
        with pytest.raises(OSError):
            promote(outputs(spark, 2), f"file://{target}")
        assert seen(target) == version(1, ["report", "captions"])
    else:
        promote(outputs(spark, 2), f"file://{target}")
        assert seen(target) == version(2)


@pytest.mark.parametrize("after", range(1, 7))
def test_a_process_that_dies_is_rolled_back_later(spark, tmp_path, monkeypatch, after):
    target = f"{tmp_path}/out"
    promote(outputs(spark, 1, ["report", "captions"]), f"file://{target}")
    swap = promotion._swap
    with monkeypatch.context() as m:
        m.setattr(promotion, "_swap", lambda fs, *rest: swap(Failing(fs, after, True), *rest))
        m.setattr(promotion, "_clear", lambda *_: None)  # the dead clear nothing
        with pytest.raises(SystemExit):
            promote(outputs(spark, 2), f"file://{target}")
    assert recover(f"file://{target}") == 1
    assert seen(target) == version(1, ["report", "captions"])
    assert recover(f"file://{target}") == 0
    promote(outputs(spark, 4), f"file://{target}")
    assert seen(target) == version(4)


def test_refused_outputs(spark, tmp_path):
    target = f"{tmp_path}/out"
    promote(outputs(spark, 1), f"file://{target}")
    bad = outputs(spark, 2)
    bad["sarif"] = bad["sarif"].withColumn("body", F.when(F.col("id") == 13, 'key "s3cr3t" here').otherwise(F.col("body")))
    with pytest.raises(RefusedError):
        promote(bad, f"file://{target}", ["s3cr3t"])
    with pytest.raises(RefusedError):
        promote(bad, f"file://{target}", ['"s3cr3t"'])  # as it stands in JSON
    with pytest.raises(RefusedError):
        promote(outputs(spark, 2) | {"report": spark.range(0).select("id", F.lit("").alias("body"))}, f"file://{target}", required=("report",))
    assert seen(target) == version(1)
    promote(outputs(spark, 3), f"file://{target}", ["", " "])
    assert seen(target) == version(3)
