from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import receipts
from tallyframe.schemas import SUBMISSION
from tallyframe.sources import feeds
from tallyframe.streaming import backlog, matcher


def test_the_state_holds_what_is_neither_matched_nor_swept(spark, tmp_path):
    rows = feeds.contested(spark.read.parquet("/root/testdata/sf0.001/orders.parquet").filter("o_orderkey < 160"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    matcher.run_available(spark, str(tmp_path / "in"), SUBMISSION, str(tmp_path / "out"), str(tmp_path / "ck"))
    done = matcher.streamed_results(spark, str(tmp_path / "out"))
    decided = done.select(F.lit("gateway").alias("side"), F.col("gateway_id").alias("row_id")).unionByName(done.select(F.lit("ledger").alias("side"), F.col("ledger_id").alias("row_id")))
    want = receipts.first_receipts(rows).join(decided, ["side", "row_id"], "left_anti")
    cols = ["side", "row_id", "txn_id", "currency", "amount", "occurred_at", "received_at"]
    held = backlog.pending(spark, str(tmp_path / "ck"))
    got = sorted(map(tuple, held.select(cols).collect()))
    assert got and got == sorted(map(tuple, want.select(cols).collect()))
    spread = backlog.partitions(spark, str(tmp_path / "ck"))
    assert spread.agg(F.sum("rows")).first()[0] == len(got)
