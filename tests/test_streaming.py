from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import matching, receipts, results
from tallyframe.schemas import SUBMISSION
from tallyframe.sources import feeds
from tallyframe.streaming import matcher


def _small(spark):
    rows = feeds.contested(spark.read.parquet("/root/testdata/sf0.001/orders.parquet").filter("o_orderkey < 160"))
    again = rows.filter("row_id % 13 = 4").withColumn("received_at", F.expr("received_at + interval 3 seconds"))
    return rows.unionByName(again)


def test_stream_gives_what_batch_gives(spark, tmp_path):
    rows = _small(spark)
    for i in range(2):  # two arrivals, cut in time, so nothing goes backwards
        part = rows.filter(F.col("received_at") < "2024-01-01 03:00:00") if i == 0 else rows.filter(F.col("received_at") >= "2024-01-01 03:00:00")
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        matcher.run_available(spark, str(tmp_path / "in"), SUBMISSION, str(tmp_path / "out"), str(tmp_path / "ck"))
    got = matcher.streamed_results(spark, str(tmp_path / "out")).filter("ledger_id is not null and gateway_id is not null")
    rec = receipts.first_receipts(rows)
    want = results.match_results(matching.assign(matching.classified(rec), "arrived"))
    cols = ["gateway_id", "ledger_id", "status", "match_layer", "match_latency_ms", "notes"]
    assert sorted(map(tuple, got.select(cols).collect()), key=str) == sorted(map(tuple, want.select(cols).collect()), key=str)
    before = got.count()
    matcher.run_available(spark, str(tmp_path / "in"), SUBMISSION, str(tmp_path / "out"), str(tmp_path / "ck"))
    after = matcher.streamed_results(spark, str(tmp_path / "out"))
    assert after.filter("ledger_id is not null and gateway_id is not null").count() == before
    lone = after.filter("match_layer = 'unmatched_sweep'")
    assert lone.count() > 0
    assert lone.filter("not (notes like 'no counterparty after 300s')").isEmpty()


def _receipts(spark, rows):
    """(side, id, txn, minutes after midnight), all of one amount."""
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, minute)")
    named = spark.createDataFrame(rows, "side string, row_id long, txn_id string, minute int")
    return named.select("side", "row_id", F.concat_ws("-", "side", "row_id").alias("idempotency_key"), "txn_id", F.lit("5.00").cast("decimal(18,2)").alias("amount"), F.lit("INR").alias("currency"), at.alias("occurred_at"), at.alias("received_at"))


def _arrive(spark, tmp_path, parts, **how):
    for rows in parts:
        _receipts(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        matcher.run_available(spark, str(tmp_path / "in"), SUBMISSION, str(tmp_path / "out"), str(tmp_path / "ck"), **how)
    got = matcher.streamed_results(spark, str(tmp_path / "out")).select("gateway_id", "ledger_id", "status", "notes").collect()
    return sorted([tuple(r) for r in got], key=str)


def test_rows_behind_the_clock_are_matched_or_swept(spark, tmp_path):
    parts = [
        [("gateway", 1, "A", 0), ("ledger", 1, "A", 0), ("gateway", 2, "B", 0), ("gateway", 9, "C", 120)],
        [("gateway", 4, "D", 60), ("ledger", 3, "B", 0)],  # D comes an hour behind the newest receipt; B was swept
        [("ledger", 5, "D", 60), ("ledger", 9, "C", 120)],  # D's partner an arrival later: D still waits
        [("gateway", 7, "E", 10), ("ledger", 7, "E", 10), ("gateway", 8, "F", 5)],
        [("gateway", 10, "G", 240)],
    ]
    lone = "no counterparty after "
    assert _arrive(spark, tmp_path, parts) == [
        (1, 1, "matched", None), (2, None, "unmatched_gateway_only", f"{lone}300s"), (4, 5, "matched", None), (7, 7, "matched", None),
        (8, None, "unmatched_gateway_only", f"{lone}6600s"), (9, 9, "matched", None), (None, 3, "unmatched_ledger_only", f"{lone}6900s"),
    ]


def test_a_stream_takes_over_what_a_batch_left_pending(spark, tmp_path):
    rows = _small(spark)
    cut = "2024-01-01 00:40:05"  # within a group
    first = receipts.first_receipts(rows.filter(F.col("received_at") < cut))
    done = matching.assign(matching.classified(first), "arrived")
    later = rows.filter(F.col("received_at") >= cut).filter("row_id % 13 <> 4")
    later.coalesce(1).write.parquet(str(tmp_path / "in"))
    matcher.run_available(spark, str(tmp_path / "in"), SUBMISSION, str(tmp_path / "out"), str(tmp_path / "ck"), backlog=results.pending(first, done))
    streamed = matcher.streamed_results(spark, str(tmp_path / "out"))
    cols = ["gateway_id", "ledger_id", "status", "match_layer"]
    both = done.transform(results.match_results).select(cols).unionByName(streamed.filter("gateway_id is not null and ledger_id is not null").select(cols))
    whole = receipts.first_receipts(rows.filter((F.col("received_at") < cut) | F.expr("row_id % 13 <> 4")))
    want = results.match_results(matching.assign(matching.classified(whole), "arrived")).select(cols)
    assert sorted(map(tuple, both.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert not streamed.filter(F.coalesce("gateway_id", "ledger_id").isin([r[0] for r in results.pending(first, done).select("row_id").collect()])).isEmpty()
