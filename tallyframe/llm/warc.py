"""WARC: writes page captures as archives, reads them back, assembles transactions.

Writing is plain Spark: each page becomes a response (or revisit) record, a request and a
metadata record, as text whose line separator is the CRLF CRLF that ends a WARC record, so
the text writer's files are WARC files, gzipped. Only (digest, page id) pairs are grouped
to find which of equal payloads is kept, never the payloads.

Reading parses each file as a stream, record by record by Content-Length. Assembly joins
requests and metadata to the record that they name in WARC-Concurrent-To and emits one
nested row per capture.

Defined results
* null html is an empty payload; a null url gives records without WARC-Target-URI.
* equal payloads of at least ``min_bytes``: the largest page id is the response (null ids
  count as smallest), the others revisit it. Repeated rows of that page id: one is the
  response and the rest revisit the same page id.
* control characters and spaces in urls are percent-encoded in the headers.
* an empty table gives no records and no captures; other columns are not read.
* payloads of one size class share archives, so that an archive holds FILE_BYTES of them at
  most; a larger payload has one of its own (2 GB is what one row of Spark holds).
* a capture without request or metadata keeps nulls there; of several, the smallest record
  id stands in the row and ``n_requests`` / ``n_metadata`` count them.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path, spread_join, written

CRLF = "\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Records and bytes of payload in one archive file at most; an archive file is one row for its reader.
RECORDS_PER_FILE, FILE_BYTES = 6_000, 256 << 20
#: Payload sizes up to which pages are written together.
SIZE_CLASSES = (64 << 10, 1 << 20, 16 << 20, 2 << 30)
#: Repeated payloads (digests of 40 bytes with an id and a url) that are broadcast at most.
BROADCAST_DIGESTS = 100_000
RECORD_SCHEMA = "record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, content_type string, declared_digest string, page_id long, payload_bytes long, payload_digest string, payload binary"


def base32_of_hex(hex40: Column) -> Column:
    """Upper-case base32 of 40 hexadecimal digits: each 5 of these are 4 of those."""
    fives = F.transform(F.sequence(F.lit(1), F.lit(36), F.lit(5)), lambda at: F.conv(F.substring(hex40, at, F.lit(5)), 16, 10).cast("int"))
    places = F.flatten(F.transform(fives, lambda x: F.array(*(F.shiftright(x, n).bitwiseAND(31) for n in (15, 10, 5, 0)))))
    return F.array_join(F.transform(places, lambda n: F.substring(F.lit(BASE32), n + 1, F.lit(1))), "")


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts)).cast("binary"))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(kind: str, headers: list[Column], block: Column) -> Column:
    head = [F.lit(f"WARC/1.1{CRLF}WARC-Type: {kind}"), *headers, F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(CRLF, *head), F.lit(CRLF + CRLF), block)


def write_warc(pages: DataFrame, path: str, *, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes one transaction (three records) for each row of pages(page_id, url, html)."""
    html = F.coalesce(F.col("html"), F.lit(""))
    seen = pages.select("page_id", "url", html.alias("html")).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    # of each payload the largest page id, how many rows have it, and the least of their urls
    shared = F.octet_length("html") >= min_bytes
    small = seen.select("digest", F.coalesce("page_id", F.lit(-(2**63))).alias("id"), "url", size_class(F.octet_length("html")).alias("class"), shared.alias("shared"))
    per_id = written(small.groupBy("digest", "id", "class", "shared").agg(F.count("*").alias("same"), F.min(F.struct(F.col("url").isNotNull().alias("named"), "url")).alias("first")), "warc-digests")
    classes = [r[0] for r in per_id.select("class").distinct().collect()]
    kept = per_id.filter("shared").groupBy("digest").agg(F.max(F.struct("id", "same", "first.url")).alias("top"), F.sum("same").alias("n")).filter("n > 1")
    kept = written(kept, "warc-repeated")
    if kept.count() <= BROADCAST_DIGESTS:
        all_ = seen.join(F.broadcast(kept.drop("n")), "digest", "left")
    else:  # the pages meet their digests by a shuffle, those of very common payloads by a broadcast
        all_ = spread_join(seen, kept.drop("n"), "digest", "left", counts=kept.select("digest", "n"))
    is_last = F.col("top").isNull() | (F.coalesce("page_id", F.lit(-(2**63))) == F.col("top.id"))
    tied = F.coalesce(is_last & (F.col("top.same") > 1), F.lit(False))
    all_ = all_.withColumn("is_top", is_last)
    if not per_id.filter("shared and same > 1").isEmpty():
        # repeated rows of one page: counted, and one of the first url's copies is the response
        copies = all_.filter(tied).groupBy("page_id", "url", "html", "digest", "top").agg(F.count("*").alias("n")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
        marked = copies.withColumn("is_top", (F.col("copy") == 1) & F.col("url").eqNullSafe(F.col("top.url")))
        all_ = all_.filter(~tied).unionByName(marked.select(*all_.columns))
    # the id of a kept response follows from its payload, so that a revisit can name it
    kept_id = _urn(F.lit("kept"), F.col("digest"))
    own_id = F.when(F.col("top").isNotNull() & F.col("is_top"), kept_id).otherwise(_urn(F.lit("own"), F.col("page_id"), F.col("digest"), F.monotonically_increasing_id()))
    safe = F.regexp_replace("url", "[\\x00-\\x20\\x7f]", "%20")
    rows = all_.select("page_id", "html", "digest", safe.alias("uri"), own_id.alias("id"), "is_top", kept_id.alias("kept_id"))
    named = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    about = [named("WARC-Date", F.lit(date)), named("WARC-Target-URI", F.col("uri"))]  # concat_ws leaves out nulls
    about_page = [named("WARC-Record-ID", F.col("id")), *about, named("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_of_hex(F.col("digest")))), F.lit("Content-Type: application/http;msgtype=response")]
    n = F.octet_length("html").cast("string")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), n, F.lit(CRLF + CRLF))
    page = F.when(F.col("is_top"), _record("response", about_page, F.concat(http, F.col("html")))).otherwise(
        _record("revisit", [*about_page, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), named("WARC-Refers-To", F.col("kept_id"))], http)
    )
    beside = lambda kind: [named("WARC-Record-ID", _urn(F.lit(kind), F.col("id"))), *about, named("WARC-Concurrent-To", F.col("id"))]
    host = F.regexp_extract("uri", r"(?s)^.*?://([^/?#]*)", 1)
    target = F.regexp_extract("uri", r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    get = F.concat(F.lit("GET "), F.when(F.coalesce(target, F.lit("")) == "", "/").otherwise(target), F.lit(f" HTTP/1.1{CRLF}Host: "), F.coalesce(host, F.lit("")), F.lit(CRLF + CRLF))
    request = _record("request", [*beside("request"), F.lit("Content-Type: application/http;msgtype=request")], get)
    fields = F.concat_ws(CRLF, named("pageId", F.col("page_id").cast("string")), named("payloadBytes", n), F.lit(""))
    metadata = _record("metadata", [*beside("metadata"), F.lit("Content-Type: application/warc-fields")], fields)
    for c in sorted(classes):
        lines = rows.filter(size_class(F.octet_length("html")) == c).select(F.explode(F.array(page, request, metadata)).alias("value"))
        most = max(3, min(RECORDS_PER_FILE, 3 * (FILE_BYTES // SIZE_CLASSES[c])))
        lines.write.mode("append").option("lineSep", CRLF + CRLF).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", most).text(path)
    if not classes:
        rows.select("digest").write.text(path)


def size_class(size: Column) -> Column:
    """The place in SIZE_CLASSES of a payload of so many bytes."""
    return sum(((size > s).cast("int") for s in SIZE_CLASSES[1:-1]), (size > SIZE_CLASSES[0]).cast("int"))


def _records(content: bytes, with_payload: bool) -> Iterator[tuple]:
    f = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)), 1 << 16)
    while line := f.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:60]!r}")
        head = {}
        while (line := f.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        block = f.read(int(head["content-length"]))
        kind, page_id, size, digest, payload = head["warc-type"], None, None, None, None
        if kind in ("response", "revisit"):
            payload = block.partition(b"\r\n\r\n")[2] if head.get("content-type", "").startswith("application/http") else block
            if kind == "response":
                size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        elif kind == "metadata":
            fields = dict(x.split(": ", 1) for x in block.decode("utf-8", "replace").split(CRLF) if ": " in x)
            page_id = int(fields["pageId"]) if "pageId" in fields else None
            size = int(fields["payloadBytes"]) if "payloadBytes" in fields else None
        yield (head.get("warc-record-id"), kind, head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri"), head.get("content-type"), head.get("warc-payload-digest"), page_id, size, digest, payload if with_payload else None)


def read_warc(spark: SparkSession, path: str, *, with_payload: bool = True) -> DataFrame:
    """One row per record of the gzipped archives under path (RECORD_SCHEMA)."""
    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, held = [], 0
        frame = lambda rows: pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "payload_bytes": "Int64"})
        for batch in batches:
            for content in batch["content"]:
                for r in _records(content, with_payload):
                    out.append(r)
                    held += len(r[-1] or b"")
                    if len(out) >= 5_000 or held >= 1 << 23:
                        yield frame(out)
                        out, held = [], 0
        yield frame(out)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInPandas(parse, RECORD_SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture, request, metadata, n_requests, n_metadata.

    capture is a response or revisit record; request and metadata are those that name it in
    WARC-Concurrent-To. The side records are reduced to one row per capture before the join.
    """
    fields = ("record_id", "record_type", "concurrent_to", "refers_to", "target_uri", "content_type", "declared_digest", "page_id", "payload_bytes", "payload_digest", "payload")
    main = records.filter(F.col("record_type").isin("response", "revisit")).select(F.struct(*fields).alias("capture"))
    side = records.filter(F.col("record_type").isin("request", "metadata") & F.col("concurrent_to").isNotNull())
    brief = F.struct("record_id", "target_uri", "content_type", "page_id", "payload_bytes")
    of = lambda kind: F.when(F.col("record_type") == kind, brief)
    sides = side.groupBy("concurrent_to").agg(
        F.min(of("request")).alias("request"), F.min(of("metadata")).alias("metadata"),
        F.count_if(F.col("record_type") == "request").alias("n_requests"), F.count_if(F.col("record_type") == "metadata").alias("n_metadata"),
    )
    joined = main.join(sides, F.col("capture.record_id") == F.col("concurrent_to"), "left")
    return joined.select("capture", "request", "metadata", F.coalesce("n_requests", F.lit(0)).alias("n_requests"), F.coalesce("n_metadata", F.lit(0)).alias("n_metadata"))


def archive_round_trip(pages: DataFrame, *, min_bytes: int = 0) -> DataFrame:
    """Writes pages to archives in the shared folder and gives their assembled captures back.

    page_id, payload_bytes, payload_digest, record_type, refers_to; sizes and digests of
    revisits come from the response that they refer to.
    """
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_warc(pages, path, min_bytes=min_bytes)
    got = assemble(read_warc(spark, path, with_payload=False))
    # a response names itself, so that no key stands for all of them
    flat = got.select(F.col("metadata.page_id").alias("page_id"), F.col("capture.record_id").alias("id"), F.col("capture.record_type").alias("record_type"), F.coalesce("capture.refers_to", "capture.record_id").alias("to"), "capture.payload_bytes", "capture.payload_digest")
    flat = written(flat, "captures")
    firsts = flat.filter("record_type = 'response'").select(F.col("id").alias("to"), F.col("page_id").alias("to_page"), "payload_bytes", "payload_digest")
    joined = spread_join(flat.drop("payload_bytes", "payload_digest"), firsts, "to", "left")
    return joined.select("page_id", "payload_bytes", "payload_digest", "record_type", F.when(F.col("id") != F.col("to"), F.col("to_page")).alias("refers_to"))
