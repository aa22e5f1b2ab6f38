"""Batches by size or time against a plain loop over each source."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import flush


def slow(rows, size, wait):
    """(source, id) -> (batch, position), by the sender's rules, one row after the other."""
    out, by = {}, {}
    for s, at, i in rows:
        by.setdefault(s, []).append((at, i))
    for s, mine in by.items():
        batches, open_batch, deadline = [], [], None
        for at, i in sorted(mine):
            deadline = at + wait if deadline is None else deadline
            if open_batch and at >= deadline:  # time was up before this row
                batches.append(open_batch)
                open_batch, deadline = [], deadline + wait
            open_batch.append(i)
            if len(open_batch) >= size or at >= deadline:
                batches.append(open_batch)
                open_batch, deadline = [], at + wait
        for n, b in enumerate([*batches, open_batch]):
            for k, i in enumerate(b):
                out[s, i] = n, k
    return out


def fast(spark, rows, size, wait, parts):
    at = F.timestamp_micros("us").cast("timestamp_ntz")
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "source string, us long, id long, part string, at_1 int").withColumn("at", at).repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = flush.timed_batches(df, size, wait, ["at", "id"], "source")
        assert got.columns == [*df.columns, "batch", "position"]
        return {(r["source"], r["id"]): (r["batch"], r["position"]) for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize(("size", "wait", "parts"), [(5, 40, 16), (1000, 7, 16), (3, 1, 8), (10_000, 100_000, 8), (1, 5, 4)])
def test_batches_against_a_loop(spark, size, wait, parts):
    draw = random.Random(size)
    rows, at = [], 0
    for i in range(3000):
        at += draw.choice([0, 0, 1, 1, 2, 3, 5, 80 if i % 50 == 0 else 1])
        rows.append((draw.choice(["most", "most", "most", "b", None]), at, i))
    assert fast(spark, rows, size, wait, parts) == slow(rows, size, wait)


def test_one_source_has_all_rows_and_never_idles(spark):
    # no batch fills and no time is idle, so that each cut depends on the first row's instant
    rows = [("one", 1_000 + 3 * i, i) for i in range(4000)]
    assert fast(spark, rows, 10_000, 100, 32) == slow(rows, 10_000, 100)


def test_no_rows_and_rows_without_an_instant(spark):
    assert fast(spark, [], 3, 10, 4) == {}
    assert fast(spark, [("a", None, 1), ("a", 5, 2)], 3, 10, 4) == {("a", 2): (0, 0)}
