from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import reads, rollup
from tallyframe.plans import reconciliation

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("as_of", ["2001-08-01 20:00:00", "2001-08-01 20:00:17.250001"])
def test_kept_minutes_give_what_a_scan_gives(spark, tmp_path, as_of):
    found = reconciliation._stored(spark, SF)
    open_ = found.filter("status = 'amount_drift'").select("id", F.lit(None).cast("timestamp_ntz").alias("closed_at"))
    for part in range(3):
        rollup.keep(found.filter(F.col("id") % 3 == part), str(tmp_path / "minutes"))
    kept, at = rollup.load(spark, str(tmp_path / "minutes")), F.lit(as_of).cast("timestamp_ntz")
    for window in ("1h", "24h", "7d"):
        want, got = reads.stats(found, open_, window, at).first().asDict(), rollup.stats(kept, found, open_, window, at).first().asDict()
        assert got == {k: pytest.approx(v, rel=1e-12) if isinstance(v, float) else v for k, v in want.items()}


def test_percentiles_by_rank(spark):
    rows = [("matched", "exact", v, n) for v, n in [(5, 3), (7, 1), (20, 96), (1000, 1)]] + [("duplicate", "duplicate", 0, 50)]
    cells = spark.createDataFrame(rows, "status string, match_layer string, match_latency_ms long, n long")
    assert tuple(rollup.percentiles(cells, (0, 3, 50, 100)).first()) == pytest.approx((5, 7, 20, 1000))
    assert tuple(rollup.percentiles(cells.limit(0), (50,)).first()) == (None,)


def test_the_minute_a_window_starts_in_is_read_by_result(spark, tmp_path):
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    times = ["2024-01-01 00:00:29", "2024-01-01 00:00:30", "2024-01-01 00:00:59", "2024-01-01 00:01:00"]
    found = spark.createDataFrame([(t,) for t in times], "t string").select(F.lit("matched").alias("status"), F.lit("exact").alias("match_layer"), F.lit(1).cast("long").alias("match_latency_ms"), F.col("t").cast("timestamp_ntz").alias("resolved_at"))
    rollup.keep(found, str(tmp_path / "minutes"))
    kept = rollup.load(spark, str(tmp_path / "minutes"))
    assert [rollup.within(kept, found, "1h", at(f"2024-01-01 01:00:{s}")).agg(F.sum("n")).first()[0] for s in ("00", "30", "59")] == [4, 3, 2]


def test_a_scan_gathers_no_latencies_in_one_task(spark):
    found = reconciliation._stored(spark, SF)
    rows = reads.stats(found, found.select(F.lit(None).cast("timestamp_ntz").alias("closed_at")), "1h", reconciliation.as_of())
    assert "percentile(" not in rows._jdf.queryExecution().executedPlan().toString()
    near = found.filter(F.col("resolved_at") >= F.lit("2001-08-01 19:00:00").cast("timestamp_ntz")).filter("status <> 'duplicate'")
    want = near.agg(*(F.percentile("match_latency_ms", F.lit(p / 100)) for p in (50, 95, 99))).first()
    assert tuple(rows.select("latency_p50", "latency_p95", "latency_p99").first()) == pytest.approx(tuple(want), rel=1e-12)
