from __future__ import annotations

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyframe.config import MatchConfig
from tallyframe.operators import matching, receipts, results

T0 = datetime(2026, 3, 14, 9, 30)
SCHEMA = "side string, row_id long, idempotency_key string, txn_id string, amount decimal(18,2), currency string, occurred_at timestamp_ntz, received_at timestamp_ntz, submissions long"


def row(side, row_id, amount="1000.00", s=0.0, txn="TXN-1", ccy="INR", received=None):
    at = T0 + timedelta(microseconds=round(s * 1_000_000))
    return (side, row_id, f"{side}-{row_id}", txn, Decimal(amount), ccy, at, at if received is None else T0 + timedelta(seconds=received), 1)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def layers(spark, pairs):
    """Layer of each (gateway amount, ledger amount, seconds apart), each its own transaction."""
    rows = []
    for i, (g, led, s) in enumerate(pairs):
        rows += [row("gateway", i, g, 0, f"T{i}"), row("ledger", i, led, s, f"T{i}")]
    got = {r["g_row_id"]: r["match_layer"] for r in matching.classified(frame(spark, rows)).collect()}
    return [got.get(i) for i in range(len(pairs))]


def test_time_bounds_are_inclusive_on_both_sides(spark):
    want = {0: "exact", 1.999: "exact", 2.0: "exact", 2.001: "time_drift", 59.999: "time_drift", 60.0: "time_drift", 60.001: None}
    cases = [("1000.00", "1000.00", sign * s) for s in want for sign in (1, -1)]
    assert layers(spark, cases) == [x for v in want.values() for x in (v, v)]


def test_amount_bounds(spark):
    inside = [("1000.00", x) for x in ("990.00", "1009.99", "1010.00", "1000.01", "999.99")] + [("50.00", "59.00"), ("50000.00", "50400.00"), ("-1000.00", "-1010.00"), ("5.00", "-5.00")]
    outside = [("1000.00", x) for x in ("1010.01", "989.99", "1500.00", "0.01")] + [("50.00", "61.00"), ("50000.00", "50600.00")]
    assert layers(spark, [(g, led, 1) for g, led in inside]) == ["amount_drift"] * len(inside)
    assert layers(spark, [(g, led, 1) for g, led in outside]) == [None] * len(outside)
    # the gateway's amount sets the tolerance, whichever side is larger
    assert layers(spark, [("2000.00", "1980.00", 0), ("1980.00", "2000.00", 0)]) == ["amount_drift", None]


def test_currency_is_part_of_identity(spark):
    rows = [row("gateway", 1), row("ledger", 1, ccy="USD")]
    assert matching.classified(frame(spark, rows)).isEmpty()


def test_rank_beats_distance_and_ties_go_to_the_smaller_id(spark):
    rows = [row("gateway", 1, received=99), row("ledger", 5, s=50), row("ledger", 6, "1000.01", s=1), row("ledger", 7, s=-50)]
    best = matching.best_counterparty(matching.classified(frame(spark, rows))).first()
    assert (best["partner_id"], best["match_layer"]) == (5, "time_drift")


def test_notes(spark):
    rows = [row("gateway", i, a, 0, f"T{i}") for i, a in enumerate(("1000.00", "1000.00", "2000.00", "100.00"))]
    rows += [row("ledger", i, a, s, f"T{i}") for i, (a, s) in enumerate((("1000.00", 3.25), ("990.00", 0), ("2000.50", 0), ("95.00", 0)))]
    notes = {r["gateway_id"]: r["notes"] for r in results.match_results(matching.classified(frame(spark, rows))).collect()}
    assert notes == {
        0: "clock drift 3.250s within 60s window", 1: "amount drift +10.00 (gateway 1000.00 vs ledger 990.00), tolerance 10.0000",
        2: "amount drift -0.50 (gateway 2000.00 vs ledger 2000.50), tolerance 20.0000", 3: "amount drift +5.00 (gateway 100.00 vs ledger 95.00), tolerance 10.0",
    }


def fold(rows, mode):
    """Rows in turn take their best free partner; independent of the engine's classifier."""
    free, out = {}, set()
    order = sorted(rows, key=lambda r: (r[7], r[0], r[1]))
    if mode == "all":
        for r in rows:
            free[r[0], r[1]] = r
    for r in order:
        if mode == "all" and (r[0], r[1]) not in free:
            continue
        best = None
        for o in list(free.values()):
            if o[0] == r[0] or o[3] != r[3] or o[5] != r[5]:
                continue
            g, led = (r, o) if r[0] == "gateway" else (o, r)
            dt, da = abs(g[6] - led[6]), abs(g[4] - led[4])
            if dt > timedelta(seconds=60) or (da and da > max(abs(g[4]) / 100, 10)):
                continue
            rank = 2 if da else int(dt > timedelta(seconds=2))
            key = (rank, dt, da, o[1])
            if best is None or key < best[0]:
                best = (key, o)
        if best:
            o = best[1]
            free.pop((o[0], o[1]), None)
            free.pop((r[0], r[1]), None)
            g, led = (r, o) if r[0] == "gateway" else (o, r)
            out.add((g[1], led[1]))
        elif mode == "arrived":
            free[r[0], r[1]] = r
    return out


@pytest.mark.parametrize("mode", ["arrived", "all"])
def test_assignment_against_a_fold(spark, mode):
    rng = random.Random(11)
    rows, n = [], 0
    for t in range(120):
        for side in ("gateway", "ledger"):
            for _ in range(rng.randint(0, 5)):
                n += 1
                rows.append(row(side, n, f"{1000 + rng.randint(0, 4) * 5}.00", rng.randint(0, 90), f"T{t}", rng.choice(["INR", "USD"]), rng.randint(0, 200)))
    pairs = matching.classified(frame(spark, rows))
    got = {(r["g_row_id"], r["l_row_id"]) for r in matching.assign(pairs, mode).collect()}
    assert got == fold(rows, mode) and len(got) > 50
    rounds = {(r["g_row_id"], r["l_row_id"]) for r in matching.assign_rounds(pairs, mode).collect()}
    assert rounds == got
    assert matching.crowded(matching.assign(pairs, mode)).isEmpty()


def test_first_receipt_wins_and_retries_count(spark):
    a, b = row("gateway", 1), row("gateway", 2, "5.00", received=9)
    b = (*b[:2], a[2], *b[3:])
    sub = frame(spark, [b, a, row("ledger", 3, received=4)]).drop("submissions")
    got = {r["row_id"]: r for r in receipts.first_receipts(sub).collect()}
    assert set(got) == {1, 3} and got[1]["amount"] == Decimal("1000.00") and got[1]["submissions"] == 2
    marks = receipts.duplicate_markers(receipts.first_receipts(sub)).collect()
    assert [(m["gateway_id"], m["ledger_id"], m["notes"]) for m in marks] == [(1, None, "2 submissions of idempotency key; first receipt retained")]


def test_sweep_matches_before_it_gives_up(spark):
    as_of = F.lit("2026-03-14 10:00:00").cast("timestamp_ntz")
    rec = frame(spark, [row("gateway", 1), row("ledger", 2, s=5), row("gateway", 3, txn="T3"), row("ledger", 4, txn="T4", received=1795), row("ledger", 9, txn="T9", received=1500)])
    none = matching.classified(rec).limit(0)
    got = {(r["gateway_id"], r["ledger_id"]): r["status"] for r in results.sweep(rec, none, as_of).collect()}
    assert got == {(1, 2): "matched", (3, None): "unmatched_gateway_only"}  # row 4 is fresh, row 9 exactly at the limit
    again = results.sweep(rec, matching.assign(matching.classified(rec)), as_of)
    assert again.filter("status = 'matched'").isEmpty()


def test_config_is_checked():
    with pytest.raises(ValueError):
        MatchConfig(amount_drift_pct=Decimal(0))
    with pytest.raises(ValueError):
        MatchConfig(exact_window_us=70_000_000)


def test_join_plan_has_one_exchange_per_side(spark):
    rec = frame(spark, [row("gateway", 1), row("ledger", 2)])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = matching.candidates(rec)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning(txn_id") == 2 and "CartesianProduct" not in plan


def test_ids_are_counted_by_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(matching, "IDS_A_TASK", 100, raising=False)
    pairs = [(i, i + 5_000) for i in range(2_000)] + [(7, 9_000)] * 40 + [(9_001, 5_011)]
    found = matching.crowded(spark.createDataFrame(pairs, "g_row_id long, l_row_id long"))
    assert found._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") == 2
    assert sorted(map(tuple, found.collect())) == [("gateway", 7, 41), ("ledger", 5_011, 2), ("ledger", 9_000, 40)]
