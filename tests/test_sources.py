from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import money, text, times
from tallyframe.operators import messages, validate
from tallyframe.sources import csvfile


def one(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def test_parse_minor(spark):
    cases = {"1,204.00": 120400, "-3.4": -340, ".5": 50, "5.": 500, "8.115": 811, "abc": None, "": None, "0.00": 0, "+12": 1200, " 1 000.1 ": 100010, ".": None, "-": None, "90071992547409.91": 2**53 - 1, "90071992547409.92": None, "9" * 30: None, "1e5": None, "-0.019": -1}
    assert one(spark, list(cases), money.parse_minor) == list(cases.values())


def test_parse_timestamp(spark):
    cases = {"1773480600": 1773480600000, "1773480600000": 1773480600000, "2026-03-14 09:30:00": 1773480600000, "2026-03-14T15:00:00+05:30": 1773480600000, "2026-03-14T09:30Z": 1773480600000, "2026-03-14T09:30:00.25Z": 1773480600250, "2026-03-14": 1773446400000, "03/04/2026": None, "": None, "2026-02-30": None, "2026-13-01T00:00:00Z": None, "177348060": None}
    assert one(spark, list(cases), times.parse_timestamp_ms) == list(cases.values())


def test_text_forms(spark):
    assert one(spark, [210000, -5, 0, 123456789], lambda c: money.to_decimal_string(c), "long") == ["2100.00", "-0.05", "0.00", "1234567.89"]
    assert one(spark, [123456789, -120400], lambda c: money.format_money(c, F.lit("INR")), "long") == ["₹1,234,567.89", "₹-1,204.00"]
    assert one(spark, ["5", None, "x"], lambda c: money.format_amount(c, F.lit("CHF"))) == ["5.00 CHF", "—", "x"]
    assert one(spark, [0, -999, 1500, 59_999, 90_000], times.format_skew, "long") == ["+0ms", "-999ms", "+1.50s", "+60.00s", "+1.5m"]
    assert one(spark, [500, 2048, 3 << 20], text.format_bytes, "long") == ["500 B", "2.0 KB", "3.0 MB"]
    assert one(spark, [88_102 * 97, 1023, 1024, 1088, (1 << 20) - 1], text.format_bytes, "long") == ["8.2 MB", "1023 B", "1.0 KB", "1.1 KB", "1024.0 KB"]
    assert one(spark, ["note", " ", None], lambda c: text.resolution_text(F.lit("reason"), c)) == ["reason — note", "reason", "reason"]
    assert one(spark, [0.5, 1500.0], times.format_duration, "double") == ["0.50ms", "1.50s"]


def test_header_mapping():
    got = csvfile.guess_mapping(["entry_id", "txn_reference", "posted_value", "ccy", "posted_at"])
    assert got == {"txn_id": "txn_reference", "amount": "posted_value", "currency": "ccy", "timestamp": "posted_at", "idempotency_key": "entry_id"}
    assert csvfile.mapping_errors(csvfile.guess_mapping(["foo"])) == [f"Map the {x} column to continue" for x in ("transaction ID", "amount", "timestamp")]
    assert csvfile.sniff_delimiter(["a;b;c", "1;2,5;3"]) == ";" and csvfile.header_names(["a", " ", None]) == ["a", "column_2", "column_3"]


def test_csv_import_and_export(spark, tmp_path):
    (tmp_path / "g.csv").write_text('Transaction Ref,Gross Amount,Currency Code,Captured At,\n\nT1,"1,204.00",inr,1773480600,k1\nT2,5.,,2026-03-14\n , , ,,\n,1,INR,1773480600,\nT4,0,INR,1773480600,x,extra\nT5,1,Rs,1773480600,\nT6,abc,INR,1773480600,k\n"T ""7""",2.50,USD,03/04/2026,\n')
    cells, headers = csvfile.read_csv(spark, str(tmp_path / "g.csv"))
    assert headers == ["Transaction Ref", "Gross Amount", "Currency Code", "Captured At", "column_5"]
    rows = csvfile.coerce(cells, headers, csvfile.guess_mapping(headers), "gateway").orderBy("line").collect()
    assert [(r["line"], r["txn_id"], r["reject_reason"]) for r in rows] == [
        (2, "T1", None), (3, "T2", None), (4, "", "empty transaction ID"), (5, "T4", "amount is zero"), (6, "T5", 'currency "RS" is not a 3-letter ISO 4217 code'),
        (7, "T6", 'amount "abc" is not a number'), (8, 'T "7"', 'timestamp "03/04/2026" is not ISO 8601 or an epoch value'),
    ]
    assert rows[0]["amount_minor"] == 120400 and rows[1]["idempotency_key"] == "gateway:T2:500:1773446400000"
    assert [r["ragged"] for r in cells.orderBy("line").collect()] == [False, True, False, True, False, False, False]
    good = csvfile.accepted(csvfile.coerce(cells, headers, csvfile.guess_mapping(headers), "gateway"))
    csvfile.write_csv(good, str(tmp_path / "out"), "gateway")
    back, names = csvfile.read_csv(spark, str(tmp_path / "out"))
    assert names == ["txn_id", "amount", "currency", "timestamp", "idempotency_key"]
    assert sorted(map(tuple, csvfile.accepted(csvfile.coerce(back, names, csvfile.guess_mapping(names), "gateway")).drop("line").collect())) == sorted(map(tuple, good.drop("line").collect()))
    csvfile.write_sample_pair(good, good, str(tmp_path / "pair"))
    _, ledger = csvfile.read_csv(spark, str(tmp_path / "pair/ledger-sample"))
    assert ledger == ["entry_id", "txn_reference", "posted_value", "ccy", "posted_at"]
    assert csvfile.gateway_payload(good).filter("occurred_at = '2026-03-14T09:30:00.000Z' and amount = '1204.00'").count() == 1


@pytest.mark.parametrize(("field", "value", "reason"), [("amount", "100.005", "amount format"), ("amount", "0.00", "amount zero"), ("currency", "inr", "currency format"), ("occurred_at", "2026-03-14T09:30:00", "occurred_at zone"), ("txn_id", "", "txn_id length"), ("txn_id", "x" * 129, "txn_id length"), ("extra", "1", "unknown field"), ("gateway_ref", "", "gateway_ref length"), ("occurred_at", "2026-02-30T00:00:00Z", "occurred_at value"), (None, None, None)])
def test_validation(spark, field, value, reason):
    import json

    body = {"txn_id": "TXN-1", "amount": "-12.5", "currency": "INR", "occurred_at": "2026-03-14T09:30:00+05:30", "gateway_ref": "R"} | ({field: value} if field else {})
    raw = spark.createDataFrame([("k", json.dumps(body))], "idempotency_key string, payload string")
    assert validate.validated(raw, "gateway").first()["reject_reason"] == reason


def test_batches_are_taken_whole(spark):
    rows = spark.range(2_005).selectExpr("case when id < 1000 then 1 when id < 2001 then 2 else 3 end as batch_id", "case when id = 2004 then 'bad' end as reject_reason")
    assert {r["batch_id"]: r["accepted"] for r in validate.batch_verdicts(rows).collect()} == {1: True, 2: False, 3: False}


def test_message_defaults(spark):
    rows = spark.createDataFrame([('{"source":"ledger","row_id":7,"txn_id":"T"}',)], "message string")
    assert rows.select(messages.decode(F.col("message")).alias("m")).select("m.*").first().asDict() == {"source": "ledger", "row_id": 7, "txn_id": "T", "is_duplicate": False, "submissions": 1}
