"""CSV import and export: headers are guessed, cells stay text until they are coerced."""

from __future__ import annotations

import csv
import io
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MAX_REPORTED_REJECTS
from ..functions.frames import written
from ..functions.money import parse_minor, to_decimal_string
from ..functions.text import derive_key
from ..functions.times import iso_utc, parse_timestamp_ms

FIELDS = ("txn_id", "amount", "currency", "timestamp", "idempotency_key")
REQUIRED = ("txn_id", "amount", "timestamp")
LABELS = {"txn_id": "transaction ID", "amount": "amount", "currency": "currency", "timestamp": "timestamp", "idempotency_key": "idempotency key"}
#: Header spellings, most specific first.
SYNONYMS = {
    "txn_id": ["txn_id", "txnid", "transaction_id", "transactionid", "payment_id", "reference", "ref", "order_id", "id"],
    "amount": ["amount", "amount_minor", "value", "gross_amount", "net_amount", "total", "sum"],
    "currency": ["currency", "currency_code", "ccy", "iso_currency"],
    "timestamp": ["timestamp", "occurred_at", "created_at", "captured_at", "settled_at", "booked_at", "transaction_date", "value_date", "posted_at", "datetime", "date", "time"],
    "idempotency_key": ["idempotency_key", "idempotencykey", "entry_ref", "entry_id", "dedupe_key", "request_id"],
}
DELIMITERS = (",", "\t", "|", ";")


def normalise(header: str) -> str:
    return re.sub(r"[^a-z0-9_]", "", re.sub(r"[\s-]+", "_", header.lower()))


def guess_mapping(headers: list[str]) -> dict[str, str | None]:
    """Field -> header: exact spellings first, then headers that contain one."""
    plain = [normalise(h) for h in headers]
    found: dict[str, str | None] = dict.fromkeys(FIELDS)
    for fits in (lambda h, s: h == s, lambda h, s: s in h):
        for field in FIELDS:
            free = [(p, h) for p, h in zip(plain, headers, strict=True) if h not in found.values()]
            if found[field] is None:
                found[field] = next((h for s in SYNONYMS[field] for p, h in free if fits(p, s)), None)
    return found


def mapping_errors(mapping: dict[str, str | None]) -> list[str]:
    return [f"Map the {LABELS[f]} column to continue" for f in REQUIRED if mapping[f] is None]


def sniff_delimiter(lines: list[str]) -> str:
    """The delimiter that cuts the first lines into the most, and equally many, cells."""
    best, score = ",", (0, 0)
    for d in DELIMITERS:
        widths = [len(r) for r in csv.reader(io.StringIO("\n".join(lines)), delimiter=d) if r]
        now = (-len(set(widths)), widths[0]) if widths and widths[0] > 1 else (-99, 0)
        if score == (0, 0) or now > score:
            best, score = d, now
    return best


def header_names(cells: list[str | None]) -> list[str]:
    return [(c or "").strip() or f"column_{i}" for i, c in enumerate(cells, 1)]


def read_csv(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """(cells, headers): a row for each record, which may hold line breaks inside quotes.

    cells has file, line, cells (as many strings as headers) and ragged, whether the record
    had another width. Records count from 1, the header, in each file; blank records are
    left out and not counted. A file is parsed as a stream by one task, as only that can
    tell which line breaks are quoted, so a large feed should come as many files.
    """
    head = spark.read.text(path).filter(F.trim("value") != "").limit(5).collect()
    lines = [r[0] for r in head]
    delimiter = sniff_delimiter(lines)
    headers = header_names(next(csv.reader(io.StringIO("\n".join(lines)), delimiter=delimiter), []))
    names = [f"c{i}" for i in range(len(headers))]
    # the parser keeps the text of a record whose width is another than the schema's
    schema = ", ".join(f"{c} string" for c in (*names, "off_width"))
    read = spark.read.schema(schema).option("columnNameOfCorruptRecord", "off_width").option("mode", "PERMISSIVE").option("multiLine", True).option("header", True).option("sep", delimiter)
    raw = read.option("escape", '"').option("nullValue", "\0").option("emptyValue", "").csv(path)
    cells = F.array(*(F.coalesce(F.col(c), F.lit("")) for c in names))
    found = raw.select(F.col("_metadata.file_path").alias("file"), cells.alias("cells"), F.col("off_width").isNotNull().alias("ragged"))
    kept = written(found.filter(F.exists("cells", lambda c: F.trim(c) != "")).withColumn("at", F.monotonically_increasing_id()), "csv-records")
    first = kept.groupBy("file").agg(F.min("at").alias("first"))
    return kept.join(first, "file").select("file", (F.col("at") - F.col("first") + 2).alias("line"), "cells", "ragged"), headers


def coerce(cells: DataFrame, headers: list[str], mapping: dict[str, str | None], side: str, fallback_currency: str = "INR", key_prefix: str = "", keep: tuple[str, ...] = ()) -> DataFrame:
    """line, typed columns and reject_reason (null: accepted); the first failing rule names it. keep: further columns of cells."""
    cell = lambda f: F.col("cells")[headers.index(mapping[f])] if mapping[f] is not None else F.lit("")
    given = F.upper(F.trim(cell("currency")))
    raw = F.struct(
        F.trim(cell("txn_id")).alias("txn_id"), cell("amount").alias("amount"), cell("timestamp").alias("at"), F.trim(cell("idempotency_key")).alias("key"),
        F.when(given == "", fallback_currency).otherwise(given).alias("currency"), parse_minor(cell("amount")).alias("minor"), parse_timestamp_ms(cell("timestamp")).alias("ms"),
    )
    # each value is computed once: what comes out of an array's element is not written out again
    once = cells.select("line", *keep, F.explode(F.array(raw)).alias("v"))
    v = lambda c: F.col(f"v.{c}")
    reason = (
        F.when(v("txn_id") == "", "empty transaction ID")
        .when(v("minor").isNull(), F.concat(F.lit('amount "'), v("amount"), F.lit('" is not a number')))
        .when(v("minor") == 0, "amount is zero")
        .when(v("ms").isNull(), F.concat(F.lit('timestamp "'), v("at"), F.lit('" is not ISO 8601 or an epoch value')))
        .when(~v("currency").rlike("^[A-Z]{3}$"), F.concat(F.lit('currency "'), v("currency"), F.lit('" is not a 3-letter ISO 4217 code')))
    )
    own = F.when(v("key") != "", v("key")).otherwise(derive_key(F.lit(side), v("txn_id"), v("minor"), v("ms"), key_prefix))
    return once.select("line", *keep, v("txn_id").alias("txn_id"), v("minor").alias("amount_minor"), v("currency").alias("currency"), v("ms").alias("occurred_ms"), reason.alias("reject_reason"), own.alias("idempotency_key"))


def accepted(coerced: DataFrame) -> DataFrame:
    return coerced.filter("reject_reason is null").drop("reject_reason")


def reported_rejects(coerced: DataFrame) -> DataFrame:
    """The first rejects by line, as many as are shown; all of them are counted elsewhere."""
    return coerced.filter("reject_reason is not null").orderBy("line").limit(MAX_REPORTED_REJECTS).select("line", "reject_reason")


def gateway_payload(rows: DataFrame) -> DataFrame:
    return rows.select("txn_id", to_decimal_string(F.col("amount_minor")).alias("amount"), "currency", iso_utc(F.col("occurred_ms")).alias("occurred_at"), F.substring("idempotency_key", 1, 128).alias("gateway_ref"))


def ledger_payload(rows: DataFrame) -> DataFrame:
    return rows.select(F.substring("idempotency_key", 1, 128).alias("entry_id"), "txn_id", to_decimal_string(F.col("amount_minor")).alias("amount"), "currency", iso_utc(F.col("occurred_ms")).alias("occurred_at"), F.substring("idempotency_key", 1, 255).alias("idempotency_key"))


def write_csv(rows: DataFrame, path: str, side: str) -> None:
    """One side's rows (txn_id, amount_minor, currency, occurred_ms, idempotency_key)."""
    key = "idempotency_key" if side == "gateway" else "entry_ref"
    rows.select("txn_id", to_decimal_string(F.col("amount_minor")).alias("amount"), "currency", iso_utc(F.col("occurred_ms")).alias("timestamp"), F.col("idempotency_key").alias(key)).write.mode("overwrite").option("header", True).csv(path)


def write_sample_pair(gateway: DataFrame, ledger: DataFrame, path: str) -> None:
    """Both sides under headers that differ on purpose."""
    amount, at = to_decimal_string(F.col("amount_minor")), iso_utc(F.col("occurred_ms"))
    gateway.select(F.col("txn_id").alias("Transaction Ref"), amount.alias("Gross Amount"), F.col("currency").alias("Currency Code"), at.alias("Captured At"), F.col("idempotency_key").alias("Idempotency Key")).write.mode("overwrite").option("header", True).csv(f"{path}/gateway-sample")
    ledger.select(F.replace("idempotency_key", F.lit("ldg-"), F.lit("ENTRY-")).alias("entry_id"), F.col("txn_id").alias("txn_reference"), amount.alias("posted_value"), F.col("currency").alias("ccy"), at.alias("posted_at")).write.mode("overwrite").option("header", True).csv(f"{path}/ledger-sample")
