"""Running sums of signed changes against a plain loop, and how many rows and bytes they move."""

import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from auctionflow import session
from auctionflow.operators import aggregates as A
from auctionflow.operators import packed

SMALL = {"PACK": 200, "AT_ONCE": 100}
CUT = {**SMALL, "MERGE_BYTES": 6000, "HOT": 150, "EVERY": 4}


def wanted(changes):
    net, run, out = Counter(), Counter(), []
    for word, time, diff in changes:
        net[word, time] += diff or 0
    for (word, time), diff in sorted(net.items(), key=lambda x: (str(x[0][0]), x[0][1] is not None, x[0][1] or 0)):
        if diff:
            run[word] += diff
            out.append((time, word, run[word]))
    return sorted(out, key=str)


def got(spark, changes, kind="time long, diff long"):
    df = spark.createDataFrame(changes, f"word string, {kind}").repartition(3)
    return sorted([(r.time, r.word, r.n) for r in A.running_diffs(df).collect()], key=str)


@pytest.fixture
def small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "50")
    yield
    spark.conf.set(name, before)


@pytest.mark.parametrize("sizes", [SMALL, CUT], ids=["whole", "cut"])
@pytest.mark.parametrize("words,times,diffs", [
    ([None, "", "ü" * 40, *"abcdefgh"], range(-50, 300), [1, -1, 2, -2, 3, 7, -300, 0, None]),
    (["a"], range(2000), [1, -1, 2**40]),
    (["a"] * 9 + ["b", "c"], range(-10**12, 10**12, 10**8 + 7), [1, -1, 4, -4]),
    (["a", None], [-2**63, 2**63 - 1, 0, 1, -5, 2**62, -2**61, None], [1, -1, 10**9]),
    (["a", "b"], [5], [1, -1]),
], ids=["mixed", "one word", "far times", "all times", "one time"])
def test_running_diffs_of_any_integers(spark, small_batches, monkeypatch, sizes, words, times, diffs):
    for name, value in sizes.items():
        monkeypatch.setattr(packed, name, value)
    rng = random.Random(1)
    changes = [(rng.choice(words), rng.choice(times), rng.choice(diffs)) for _ in range(2000)]
    assert got(spark, changes) == wanted(changes)


def test_running_diffs_of_other_types(spark):
    assert got(spark, []) == []
    changes = [("a", 3, 1), ("a", 1, 2), ("b", 1, -1), ("a", 3, -1), ("a", 4, 5)]
    assert got(spark, changes, "time int, diff int") == wanted(changes)
    days = spark.createDataFrame(changes, "word string, day int, diff long").select(
        "word", F.timestamp_seconds(F.col("day") * 86_400).alias("time"), "diff")
    assert sorted((r.word, r.time.day - 1, r.n) for r in A.running_diffs(days).collect()) == [
        ("a", 1, 2), ("a", 4, 7), ("b", 1, -1)]


def test_a_running_sum_beyond_64_bits_fails(spark):
    assert got(spark, [("a", 1, 2**62), ("a", 2, 2**62 - 1), ("b", 3, 2**62)])
    with pytest.raises(Exception, match="64 bits"):
        got(spark, [("a", i, 2**62) for i in range(3)])


@pytest.mark.parametrize("merge,most", [(1, 5), (1 << 26, 1)], ids=["packs", "merged"])
def test_a_task_merges_its_pieces_of_a_word_and_no_word_has_more_than_are_leading(monkeypatch, merge, most):
    for name, value in {**SMALL, "MERGE_BYTES": merge}.items():
        monkeypatch.setattr(packed, name, value)
    rows = pa.RecordBatch.from_pydict({"word": [f"w{i % 3}" for i in range(1000)], "time": range(1000), "diff": [1] * 1000})
    pieces = pa.Table.from_batches(packed._pack(rows.slice(i, 50) for i in range(0, 1000, 50))).to_pylist()
    assert max(Counter(p["word"] for p in pieces).values()) == most == sum(p["lead"] for p in pieces)
    assert sum(p["n"] for p in pieces) == 1000 and {(p["at"] % 3, p["last"] % 3) for p in pieces} == {(i, i) for i in range(3)}


def test_numbers_of_all_lengths_come_back():
    values = np.array([0, 1, 127, 128, 2**14, 2**35 - 1, 2**56, 2**63, 2**64 - 1], np.uint64)
    raw, size = packed._put(values)
    assert packed._get(raw).tolist() == values.tolist() and size.tolist() == [1, 1, 1, 2, 3, 5, 9, 10, 10]


def test_changes_are_stored_and_moved_packed(spark):
    """40,000 changes of 20 words; a row each is 40,000 stored rows and more than three bytes a change."""
    known = session._stored.setdefault(spark.sparkContext.applicationId, [])
    before = set(known)
    changes = spark.range(40_000).select(
        F.concat(F.lit("w"), F.col("id") % 20).alias("word"), F.floor(F.col("id") / 20 * 3).alias("time"), F.lit(1).alias("diff"))
    sums = A.running_diffs(changes)
    paths = [p for p in known if p not in before]
    assert paths and sum(spark.read.parquet(p).count() for p in paths) <= 20 * 8
    assert sum(os.path.getsize(f"{p}/{f}") for p in paths for f in os.listdir(p)) < 3 * 40_000
    assert sums.groupBy("word").agg(F.max("n").alias("n"), F.count("*").alias("k")).filter("n = 2000 AND k = 2000").count() == 20
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "hashpartitioning(word" in plan
