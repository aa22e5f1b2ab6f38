from __future__ import annotations

import base64
import hashlib

from tallyframe.llm import warc
from tallyframe.llm.common import shared_path

PAGES = [(1, "http://a.example/x?y=1#z", "<p>é</p>", 0), (2, "http://a.example/", "<p>é</p>", 0), (3, None, None, 0), (4, "not a url\r\nX: y", "", 0), (5, "https://b.example", "WARC/1.1\r\n\r\nbody\r\n\r\n" * 5, 0), (5, "https://b.example", "WARC/1.1\r\n\r\nbody\r\n\r\n" * 5, 0), (None, "https://c.example", "<p>é</p>", 0), (6, "https://c.example/long", "z" * 200_000, 0)]


def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string, capture long").repartition(3)


def test_round_trip(spark):
    rows = warc.archive_round_trip(pages(spark)).collect()
    assert len(rows) == len(PAGES)
    by = {}
    for i, _, html, _ in PAGES:
        by.setdefault((html or "").encode(), []).append(i)
    digest = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    want = []
    for body, ids in by.items():
        ids = sorted(ids, key=lambda i: -1 if i is None else i)
        want += [(i, len(body), digest(body), "revisit", ids[-1]) for i in ids[:-1]] + [(ids[-1], len(body), digest(body), "response", None)]
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_small_payloads_are_all_responses(spark):
    rows = warc.archive_round_trip(pages(spark), min_bytes=50).collect()
    assert [r["page_id"] for r in rows if r["record_type"] == "revisit"] == [5]


def test_assembly_and_payloads(spark):
    path = shared_path(spark, "warc")
    warc.write_warc(pages(spark), path)
    records = warc.read_warc(spark, path)
    assert records.count() == 3 * len(PAGES)
    captures = warc.assemble(records)
    assert captures.count() == len(PAGES) and captures.filter("n_requests <> 1 or n_metadata <> 1").isEmpty()
    bodies = {bytes(r[0]).decode() for r in captures.filter("capture.record_type = 'response'").select("capture.payload").collect()}
    assert bodies == {p[2] or "" for p in PAGES}
    alone = warc.assemble(records.filter("record_type <> 'request'"))
    assert alone.filter("request is null and n_requests = 0").count() == len(PAGES)


def test_empty(spark):
    assert warc.archive_round_trip(pages(spark).limit(0)).count() == 0


def test_one_payload_in_half_of_all_pages_and_small_archives(spark, monkeypatch):
    rows = [(i, f"http://h.example/{i}", "the same page" if i % 2 else f"page {i} " * (i % 50 * 30), 0, 1) for i in range(1300)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, to int, record_id int").repartition(4)
    key = lambda r: (str(r["page_id"]), r["payload_digest"], r["record_type"], str(r["refers_to"]))
    want = sorted(map(key, warc.archive_round_trip(table).collect()))
    assert sum(w[2] == "revisit" for w in want) >= 649
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", 0)
    monkeypatch.setattr(warc, "SIZE_CLASSES", (100, 1_000, 5_000, 1 << 30))
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(key, warc.archive_round_trip(table).collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
