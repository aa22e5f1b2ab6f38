from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import groundtruth, metrics, reads, results
from tallyframe.plans import reconciliation as plan
from tallyframe.sources import synthetic

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def numbered(spark):
    return plan._stored(spark, SF).cache()


def test_known_counts(spark):
    got = {r["match_layer"] if r["status"] != "duplicate" else "duplicate": r["n"] for r in plan.recon_summary(spark, SF).collect() if "unmatched" not in r["status"]}
    assert got == {"exact": 743, "time_drift": 442, "amount_drift": 55, "duplicate": 45}


def test_stats_algebra(spark, numbered):
    exc = results.exceptions(numbered).withColumn("closed_at", F.lit(None).cast("timestamp_ntz"))
    s = reads.stats(numbered, exc, "7d", plan.as_of()).first()
    assert s["total"] == s["matched"] + s["unmatched"] + s["drift"] and s["unmatched"] == s["unmatched_gateway_only"] + s["unmatched_ledger_only"]
    assert s["open_exceptions"] == exc.count()
    none = reads.stats(numbered.limit(0), exc.limit(0), "1h", plan.as_of()).first()
    assert none["match_rate"] == 0.0 and none["latency_p50"] is None and none["total"] == 0


def test_page_walk_covers_every_id_once(numbered):
    seen, cursor = [], None
    while True:
        ids = [r["id"] for r in reads.page(numbered, 400, cursor).collect()]
        seen += ids[:400]
        if len(ids) <= 400:
            break
        cursor = ids[399]
    assert seen == sorted(seen, reverse=True) and len(seen) == len(set(seen)) == numbered.count()


@pytest.mark.parametrize("bad", [{"limit": 0}, {"limit": 501}, {"cursor": 0}, {"status": "lost"}])
def test_page_arguments(bad):
    with pytest.raises(ValueError):
        reads.checked_page(**bad)


def test_first_close_wins(spark):
    opened = spark.createDataFrame([(1,), (2,)], "id long")
    asked = spark.sql("select * from values (1L, 'b', timestamp_ntz'2026-01-01 00:00:02', 2L), (1L, 'a', timestamp_ntz'2026-01-01 00:00:01', 3L), (9L, 'x', timestamp_ntz'2026-01-01 00:00:00', 1L) t(exception_id, resolution_notes, closed_at, seq)")
    got = {(r["exception_id"], r["seq"]): r["outcome"] for r in results.closure_outcomes(opened, asked).collect()}
    assert got == {(1, 3): "closed", (1, 2): "conflict", (9, 1): "not_found"}
    closed = {r["id"]: r["resolution_notes"] for r in results.closed(opened, asked).collect()}
    assert closed == {1: "a", 2: None}


def test_engine_agrees_with_ground_truth(spark):
    cfg = synthetic.GeneratorConfig(count=1_500, drop_rate=0.15, duplicate_rate=0.15, drift_rate=0.15, time_skew_ms=3_000, seed=7)
    planned = synthetic.plan(spark, cfg).cache()
    truth = groundtruth.totals(planned)
    found = groundtruth.detected(results.reconcile(synthetic.planned_submissions(planned), F.lit("2027-01-01 00:00:00").cast("timestamp_ntz")))
    rows = groundtruth.compare(truth, found).collect()
    assert all(r["agrees"] for r in rows) and groundtruth.verify(truth, found).filter("not agrees").isEmpty()
    t = truth.first()
    assert min(t[c] for c in ("matched_exact", "matched_time_drift", "amount_drift", "unmatched_gateway", "duplicates")) > 0


def test_generator_clamps():
    c = synthetic.clamp(synthetic.GeneratorConfig(count=5, drop_rate=0.9, duplicate_rate=-1, drift_rate=float("nan"), time_skew_ms=1e9))
    assert (c.count, c.drop_rate, c.duplicate_rate, c.drift_rate, c.time_skew_ms) == (100, 0.5, 0.0, 0.0, 90_000.0)


def test_nearest_rank_rounds_halves_to_even(spark):
    import random

    rng = random.Random(1)
    for n in (1, 2, 3, 10, 101):
        v = [rng.randint(0, 50) for _ in range(n)]
        got = {r["pct"]: r["value"] for r in metrics.nearest_rank(spark.createDataFrame([(x,) for x in v], "v long"), "v").collect()}
        assert got == {p: sorted(v)[min(round(p / 100 * (n - 1)), n - 1)] for p in (50, 95, 99)}
