from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.streaming import closures


def _run(spark, tmp_path, arrivals):
    """Arrivals of (exception ids opened, requests (exception, seq, minute)); outcomes of all."""
    minute = lambda c: F.expr(f"timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, {c})")
    for opened, requests in arrivals:
        spark.createDataFrame([(i,) for i in opened], "id long").select("id", minute("0").alias("opened_at")).coalesce(1).write.mode("append").parquet(str(tmp_path / "opened"))
        asked = spark.createDataFrame(requests, "exception_id long, seq long, m int").select("exception_id", "seq", minute("m").alias("closed_at"), F.concat(F.lit("note "), "seq").alias("resolution_notes"))
        asked.coalesce(1).write.mode("append").parquet(str(tmp_path / "requests"))
        found = closures.run_available(spark, str(tmp_path / "opened"), str(tmp_path / "requests"), str(tmp_path / "out"), str(tmp_path / "ck"))
    return sorted((r["exception_id"], r["seq"], r["outcome"]) for r in found.collect())


def test_requests_are_decided_in_their_order_whenever_they_arrive(spark, tmp_path):
    got = _run(
        spark, tmp_path,
        [
            ([1], [(1, 2, 6), (2, 1, 5), (3, 1, 4)]),  # a later request of 1 first; 2 is not opened yet; 3 never is
            ([2], [(1, 1, 5), (2, 2, 5)]),
            ([], [(None, None, 600)]),
            ([], [(1, 3, 1), (3, 2, 700)]),  # hours behind the clock: decided where it arrives
            ([3], [(None, None, 900)]),
        ],
    )
    # the last request of 3 waits when 3 is opened
    assert got == [(1, 1, "closed"), (1, 2, "conflict"), (1, 3, "conflict"), (2, 1, "closed"), (2, 2, "conflict"), (3, 1, "not_found"), (3, 2, "closed")]


def test_a_second_run_decides_nothing_anew(spark, tmp_path):
    arrivals = [([1], [(1, 1, 5), (1, 1, 5)]), ([], [(None, None, 600)])]
    got = _run(spark, tmp_path, arrivals)
    assert [o for _, _, o in got] == ["closed", "conflict"]  # a repeated request is a conflict
    found = closures.run_available(spark, str(tmp_path / "opened"), str(tmp_path / "requests"), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert found.count() == 2
