"""Assignment by a sweep against assignment over all pairs."""

from __future__ import annotations

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyframe.config import MatchConfig
from tallyframe.operators import matching, sweepmerge

COLS = ["txn_id", "currency", "g_row_id", "l_row_id", "rank", "dt_us", "d_amount", "match_layer", "g_amount", "l_amount", "g_occurred_at", "l_received_at"]


def receipts(spark, rows):
    at = lambda c: F.timestamp_micros(F.lit(1_773_480_600_000_000) + F.col(c)).cast("timestamp_ntz")
    df = spark.createDataFrame(rows, "side string, row_id long, txn_id string, currency string, cents long, t long, r long")
    return df.select("side", "row_id", "txn_id", "currency", (F.col("cents") / 100).cast("decimal(18,2)").alias("amount"), at("t").alias("occurred_at"), at("r").alias("received_at"), F.lit(1).alias("stretch")).repartition(4)


def slow(rows, cfg):
    """(txn, currency, gateway, ledger, rank): each row in turn looks at all free rows of the other side."""
    free, out = [], []
    for row in sorted((r for r in rows if None not in r), key=lambda r: (r[6], r[0], r[1])):
        side, i, txn, ccy, cents, t, _ = row
        fits = []
        for o in free:
            if o[0] == side or o[2:4] != (txn, ccy) or abs(o[5] - t) > cfg.drift_window_us:
                continue
            dt, off, g = abs(o[5] - t), abs(o[4] - cents), abs(Decimal(cents if side == "gateway" else o[4]))
            if not off:
                fits.append((0 if dt <= cfg.exact_window_us else 1, dt, off, o[1], o))
            elif off <= max(g * cfg.amount_drift_pct, cfg.amount_drift_floor * 100):
                fits.append((2, dt, off, o[1], o))
        if not fits:
            free.append(row)
            continue
        rank, *_, o = min(fits, key=lambda f: f[:4])
        free.remove(o)
        out.append((txn, ccy, *((i, o[1]) if side == "gateway" else (o[1], i)), rank))
    return sorted(out)


def both(spark, rows, cfg=None, **how):
    cfg = cfg or MatchConfig()
    return sorted(map(tuple, sweepmerge.assign(receipts(spark, rows), cfg, **how).select(*COLS[:5]).collect())), slow(rows, cfg)


def crowd(draw, n, every_us, amounts):
    """One transaction with most rows, ties in time, amount and receipt among them, and a few others."""
    out = []
    for i in range(n):
        t = i * every_us + draw.choice([0, 0, 1, 500_000, 1_999_999, 2_000_000, -30_000_000])
        if i > n // 2:
            t += 61_000_000 + every_us
        txn, ccy = draw.choice([("hot", "INR")] * 6 + [("hot", "USD"), ("b", "INR"), ("c", "EUR")])
        out.append((draw.choice(["gateway", "ledger"]), i, txn, ccy, draw.choice(amounts), t, t + draw.choice([0, 0, 1_000_000, 5_000_000, 40_000_000])))
    return out


@pytest.mark.parametrize(
    ("n", "every_us", "amounts"),
    [(500, 700_000, [100_000, 100_500, 101_000, 101_100, 99_000]), (300, 0, [5_000, 5_900, 6_000, 6_100, -5_000, -5_500, 0]), (400, 3_000_000, list(range(200_000, 204_000, 37))), (60, 100_000_000, [1, 2])],
)
def test_sweep_gives_what_all_pairs_give(spark, n, every_us, amounts):
    got, want = both(spark, crowd(random.Random(n), n, every_us, amounts))
    assert got == want
    assert n < 100 or len(want) > n / 5


def test_other_settings(spark):
    rows = crowd(random.Random(3), 300, 900_000, [100_000, 100_400, 102_000])
    got, want = both(spark, rows, MatchConfig(exact_window_us=0, drift_window_us=5_000_000))
    assert got == want and want


def test_columns_are_those_of_the_assignment_over_pairs(spark):
    rows, cfg = crowd(random.Random(4), 60, 20_000_000, [100_000, 100_400]), MatchConfig()
    listed = lambda df: sorted(map(tuple, df.select(*COLS).collect()), key=str)
    pairs = matching.classified(receipts(spark, rows), cfg)
    want = listed(matching.assign(pairs, "arrived"))
    assert want and listed(sweepmerge.assign(receipts(spark, rows), cfg)) == want
    assert listed(sweepmerge.assign(receipts(spark, rows), cfg, stretch_rows=20)) == want
    assert set(sweepmerge.assign(receipts(spark, rows), cfg).columns) == set(pairs.columns)


def test_no_rows_one_side_and_nulls(spark):
    assert both(spark, [])[0] == []
    assert both(spark, [("gateway", i, "a", "INR", 100, i, i) for i in range(5)])[0] == []
    got, want = both(spark, [("gateway", 1, "a", "INR", 100, 0, 0), ("ledger", 1, "a", "INR", 100, 60_000_000, 0), ("ledger", 2, None, "INR", 100, 0, 0), ("ledger", 3, "a", None, 100, 0, 0), ("ledger", 4, "a", "INR", None, 0, 0), ("ledger", 5, "a", "INR", 100, 60_000_001, 0)])
    assert got == want and len(got) == 1


def test_a_sweep_of_very_many_rows_that_all_fit_is_quick():
    draw, n = random.Random(1), 20_000
    rows = [(("gateway", "ledger")[i % 2], i, 1_000_000 + draw.randrange(9_000), draw.randrange(60_000_000), i // 2) for i in range(n)]
    out = sweepmerge.swept(rows, MatchConfig())
    assert len(out) == n // 2  # about n * n / 4 pairs fit
