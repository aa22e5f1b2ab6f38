from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.schemas import SUBMISSION
from tallyframe.streaming import closures, matcher


def _plan(df):
    return df._jdf.queryExecution().logical().toString().lower()


def test_no_key_costs_a_call_into_python(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = matcher.first_receipts(spark.readStream.schema(SUBMISSION).parquet(str(tmp_path / "in")))
    assert stream.isStreaming and "aggregate" in _plan(stream) and "python" not in _plan(stream) and "transformwithstate" not in _plan(stream)


def test_a_replayed_epoch_overwrites_itself_and_old_versions_go(spark, tmp_path):
    m = matcher.Matcher(str(tmp_path / "out"), str(tmp_path / "state"))
    rows = lambda *r: spark.createDataFrame([(s, i, t, "INR", x * 60_000_000, x * 60_000_000) for s, i, t, x in r], "side string, row_id long, txn_id string, currency string, occurred_us long, received_us long").withColumn("amount", F.lit("5.00").cast("decimal(18,2)"))
    got = lambda: sorted([tuple(r) for r in m.sink.read(spark).select("kind", "gateway_id", "ledger_id").collect()], key=str)
    m(rows(("gateway", 1, "A", 0), ("gateway", 2, "B", 0)), 0)
    for _ in range(2):  # the second time is a replay
        m(rows(("ledger", 1, "A", 0), ("gateway", 9, "C", 600)), 1)
        assert got() == [("match", 1, 1)]
    for _ in range(2):
        m.settle(spark)
        assert got() == [("gateway", 2, None), ("match", 1, 1)]
    left = m.waiting(spark, *[m.kept.before(spark)[i] for i in (0, 2)])
    assert [r["row_id"] for r in left.collect()] == [9]
    assert sorted(p.name for p in (tmp_path / "state" / "rows").iterdir()) == ["version=2", "version=3"]


def test_a_replayed_epoch_of_closures_decides_the_same(spark, tmp_path):
    c = closures.Closer(str(tmp_path / "out"), str(tmp_path / "state"))
    rows = lambda *r: spark.createDataFrame(r, "kind string, exception_id long, seq long, at_us long, notes string")
    minute = 60_000_000
    c(rows(("opened", 1, None, 0, None), ("close", 1, 2, 6 * minute, None), ("close", 2, 1, 5 * minute, None)), 0)
    for _ in range(2):
        c(rows(("close", 1, 1, 5 * minute, None), ("tick", None, None, 600 * minute, None)), 1)
    for _ in range(2):
        c(rows(("opened", 2, None, 0, None), ("close", 1, 3, 0, None), ("close", 2, 9, 0, None)), 2)
    got = sorted((r["exception_id"], r["seq"], r["outcome"]) for r in c.sink.read(spark).collect())
    # held requests come first, though those of the third epoch lie before them
    assert got == [(1, 1, "closed"), (1, 2, "conflict"), (1, 3, "conflict"), (2, 1, "closed"), (2, 9, "conflict")]
