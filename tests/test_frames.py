from __future__ import annotations

import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import frames, order, times
from tallyframe.operators import matching, results
from tallyframe.sources import csvfile

from .test_matching import fold, frame, row


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_with_one_key_of_most_rows(spark, how):
    many = spark.createDataFrame([(i, 7 if i % 2 else i % 40, i) for i in range(3000)] + [(-1, None, 0)], "i int, k int, keys int")
    one = spark.createDataFrame([(k, f"v{k}") for k in range(30)], "k int, v string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = frames.spread_join(many, one, "k", how)
        assert sorted(map(str, got.collect())) == sorted(map(str, many.join(one, "k", how).collect()))
        assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_numbers_and_totals_beside_columns_of_their_names(spark):
    rows = spark.createDataFrame([(i * 37 % 101, i, i, i) for i in range(101)], "v int, Part int, at int, before int").repartition(5)
    got = {r["v"]: (r["n"], r["Part"], r["at"]) for r in order.row_numbers(rows, ["v"], "n").collect()}
    assert got == {i * 37 % 101: (i * 37 % 101 + 1, i, i) for i in range(101)}
    sums = {r["v"]: r["s"] for r in order.running_totals(rows, "v", "v", "s").collect()}
    assert sums == {v: v * (v + 1) // 2 for v in range(101)}
    assert order.row_numbers(rows.limit(0), ["v"], "n").columns[-1] == "n"


def test_scratch_deletes_what_was_written_inside(spark):
    rows = spark.range(3)
    outer = frames.written(rows, "outer")
    with frames.scratch(spark, "kept"):
        inner, kept = frames.written(rows, "inner"), frames.written(rows, "kept")
        assert inner.count() == 3
    assert outer.count() == 3 and kept.count() == 3
    with pytest.raises(Exception, match="(?i)not exist|not found"):
        inner.count()


def test_decimals_by_the_exact_binary_value(spark):
    rng = random.Random(3)
    values = [1.005, 0.125, 0.375, 2.5, 0.0, 59.995, 1.045, *(rng.randrange(60_000) / 1000 for _ in range(400)), *(rng.randrange(4_000) / 16 for _ in range(200))]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    for digits in (1, 2):
        want = [str(Decimal(v).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) for v in values]
        assert [r[0] for r in rows.orderBy("i").select(times.to_fixed(F.col("v"), digits)).collect()] == want


@pytest.mark.parametrize("mode", ["arrived", "all"])
def test_one_transaction_with_half_of_all_rows(spark, mode):
    rng = random.Random(5)
    rows = [row("gateway" if n % 2 else "ledger", n, f"{1000 + rng.randint(0, 3) * 5}.00", rng.randint(0, 900), "HOT" if n < 180 else f"T{n // 6}", "INR", rng.randint(0, 1200)) for n in range(360)]
    pairs = matching.classified(frame(spark, rows))
    hot = pairs.filter("txn_id = 'HOT'").count()
    assert hot > matching.FOLD_EDGES
    want = fold(rows, mode)
    for most in (matching.FOLD_EDGES, hot):  # rounds and then the fold, the fold alone
        got = {(r["g_row_id"], r["l_row_id"]) for r in matching.assign(pairs, mode, most).collect()}
        assert got == want


def test_drain_gives_what_one_pass_gives(spark):
    rows = [row("gateway" if n % 2 else "ledger", n, "1000.00", n % 7 * 20, f"T{n // 2}", "INR", n % 11 * 30) for n in range(90)]
    rec, as_of = frame(spark, rows), F.lit("2026-03-14 09:38:00").cast("timestamp_ntz")
    none = matching.classified(rec).limit(0)
    whole = results.sweep(rec, none, as_of)
    parts, drained = results.drain(rec, none, as_of, batch=12)
    key = lambda df: sorted(map(str, df.collect()))
    assert drained and whole.count() > 20 and key(parts.filter("status not like 'unm%'")) != [] and key(parts) == key(whole)
    some, drained = results.drain(rec, none, as_of, batch=2, max_passes=1)
    assert not drained and 0 < some.count() <= 4
    # as many passes as there are rows, and each takes one row of a side
    many, drained = results.drain(rec, none, as_of, batch=1, max_passes=None)
    assert drained and many.count() > 20 and many.count() <= whole.count() * 2


def test_results_are_taken_once(spark):
    cols = "gateway_id long, ledger_id long, status string"
    kept = spark.createDataFrame([(1, 2, "matched"), (3, None, "duplicate")], cols)
    found = spark.createDataFrame([(1, 2, "matched"), (1, 9, "matched"), (None, 2, "unmatched_ledger_only"), (3, None, "duplicate"), (3, 4, "matched"), (1, None, "duplicate")], cols)
    assert sorted(map(tuple, results.append(kept, found).collect())) == [(1, None, "duplicate"), (3, 4, "matched")]


def test_records_with_line_breaks_and_many_files(spark, tmp_path):
    for f in range(3):
        (tmp_path / f"{f}.csv").write_text("Txn Id;Amount;Date;Note\n" + "".join(f'"T{f}{i}";{i}.50;2026-03-14;"one ""{i}""\nand\n\nmore; so"\n\n ; ;;\n' for i in range(4)) + f"T{f}9;1;2026-03-14;x;y\nT{f}8;1\n")
    cells, headers = csvfile.read_csv(spark, str(tmp_path))
    assert headers == ["Txn Id", "Amount", "Date", "Note"]
    got = sorted((r["file"][-5:], r["line"], r["cells"][0], r["cells"][3], r["ragged"]) for r in cells.collect())
    want = [(f"{f}.csv", n + 2, f"T{f}{i}", f'one "{i}"\nand\n\nmore; so' if i < 4 else "x" if i == 9 else "", i > 3) for f in range(3) for n, i in enumerate((0, 1, 2, 3, 9, 8))]
    assert got == want
