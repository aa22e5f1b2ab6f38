"""Streaming ingestion: whole requests, reasons, replays."""

from __future__ import annotations

import json

from tallyframe.streaming import ingest


def entry(i, **other):
    return {"entry_id": f"e{i}", "txn_id": f"t{i}", "amount": "5.00", "currency": "INR", "occurred_at": "2026-03-14T09:30:00Z", "idempotency_key": f"k{i}"} | other


def put(path, name, requests):
    path.mkdir(exist_ok=True)
    (path / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in requests) + "\n")


def take(spark, tmp_path, side="ledger"):
    return ingest.run_available(spark, str(tmp_path / "in"), side, str(tmp_path / "out"), str(tmp_path / "ck"))


def rows(df, *cols):
    return sorted([tuple(r) for r in df.select(*cols).collect()], key=str)


def test_an_invalid_entry_rejects_its_whole_request(spark, tmp_path):
    put(tmp_path / "in", "1.json", [{"request_id": "a", "entries": [entry(1), entry(2)]}, {"request_id": "b", "entries": [entry(3), entry(4, amount="1.001"), entry(5, other=1)]}])
    intake = take(spark, tmp_path)
    put(tmp_path / "in", "2.json", [{"request_id": "c", "entries": []}, "not json", {"request_id": "d", "entries": [entry(i) for i in range(1001)]}, "", {"request_id": "e", "entries": [entry(9)], "more": 1}, {"entries": [None]}])
    take(spark, tmp_path)
    verdicts = rows(intake.read(spark, "verdicts"), "request_id", "entries", "invalid", "accepted")
    assert verdicts == sorted([("a", 2, 0, True), ("b", 3, 2, False), ("c", 0, 0, False), (None, 0, 0, False), (None, 0, 0, False), ("d", 1001, 0, False), ("e", 1, 0, True)], key=str)
    assert rows(intake.read(spark, "accepted"), "request_id", "position", "txn_id") == [("a", 0, "t1"), ("a", 1, "t2"), ("e", 0, "t9")]
    why = rows(intake.read(spark, "rejected").filter("request_id in ('b', 'c') or request_id is null"), "request_id", "position", "reason")
    assert why == sorted([("b", 0, ingest.WITH_BATCH), ("b", 1, "amount format"), ("b", 2, "unknown field"), ("c", None, ingest.NOT_READ), (None, None, ingest.NOT_READ), (None, 0, ingest.NOT_READ)], key=str)
    assert intake.read(spark, "rejected").filter("request_id = 'd'").count() == 1001


def test_a_replayed_epoch_adds_nothing_and_an_uncommitted_one_is_not_read(spark, tmp_path):
    put(tmp_path / "in", "1.json", [{"request_id": "a", "entries": [entry(1)]}])
    intake = take(spark, tmp_path)
    before = {t: rows(intake.read(spark, t), "request_id") for t in ingest.TABLES if t != "rejected"}
    lines = spark.read.text(str(tmp_path / "in"))
    intake(lines, 0)
    assert {t: rows(intake.read(spark, t), "request_id") for t in before} == before
    ingest.verdicts(spark.read.parquet(intake.at("checked", 0))).write.parquet(intake.at("verdicts", 7))  # a crash before the commit
    assert rows(intake.read(spark, "verdicts"), "request_id") == before["verdicts"]


def test_webhooks_carry_their_key_beside_the_body(spark, tmp_path):
    hook = {"txn_id": "t", "amount": "-5.00", "currency": "INR", "occurred_at": "2026-03-14T15:00:00+05:30", "gateway_ref": "r"}
    put(tmp_path / "in", "1.json", [{"request_id": "a", "entries": [hook | {"idempotency_key": "k"}]}, {"request_id": "b", "entries": [hook]}, {"request_id": "c", "entries": [hook | {"idempotency_key": "k2", "x": 1}]}])
    intake = take(spark, tmp_path, "gateway")
    assert rows(intake.read(spark, "accepted"), "request_id", "idempotency_key", "txn_id") == [("a", "k", "t")]
    assert rows(intake.read(spark, "rejected"), "request_id", "reason") == [("b", "idempotency_key missing"), ("c", "unknown field")]
