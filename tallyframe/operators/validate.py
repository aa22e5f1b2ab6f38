"""Validation of raw submissions: the first failing rule gives the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import LEDGER_BATCH_MAX
from ..schemas import GATEWAY_FIELDS, LEDGER_FIELDS

MONEY = r"^[+-]?0*\d{1,16}(\.\d{1,2})?$"
CURRENCY = "^[A-Z]{3}$"
ZONED = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"


def _length(field: str, most: int) -> tuple[Column, str]:
    return F.coalesce(F.length(field), F.lit(0)).between(1, most), f"{field} length"


def _rules(key: str) -> list[tuple[Column, str]]:
    return [
        (F.trim(F.coalesce(F.col(key), F.lit(""))) != "", f"{key} missing"), _length(key, 255), _length("txn_id", 128),
        (F.coalesce(F.col("amount").rlike(MONEY), F.lit(False)), "amount format"), (F.col("amount").try_cast("decimal(18,2)") != 0, "amount zero"),
        (F.coalesce(F.col("currency").rlike(CURRENCY), F.lit(False)), "currency format"), (F.coalesce(F.col("occurred_at").rlike(ZONED), F.lit(False)), "occurred_at zone"),
        (F.try_to_timestamp("occurred_at").isNotNull(), "occurred_at value"),
    ]


def parsed(raw: DataFrame, side: str, payload: str = "payload") -> DataFrame:
    """The payload's fields as text columns, and unknown, the names it should not have."""
    fields = GATEWAY_FIELDS if side == "gateway" else LEDGER_FIELDS
    record = F.from_json(payload, ", ".join(f"{f} string" for f in fields))
    unknown = F.array_except(F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>")), F.array(*map(F.lit, fields)))
    # one element, so that the payload is parsed once and not for each field that is read
    once = F.explode(F.array(F.struct(record.alias("record"), unknown.alias("unknown")))).alias("v")
    return raw.select(*raw.columns, once).select(*raw.columns, *(F.col(f"v.record.{f}").alias(f) for f in fields), F.col("v.unknown").alias("unknown"))


def validated(raw: DataFrame, side: str) -> DataFrame:
    """raw with fields, typed values and reject_reason (null: accepted); the payload stays."""
    rows = parsed(raw, side)
    own = "gateway_ref" if side == "gateway" else "entry_id"
    reason = F.when(F.size("unknown") > 0, "unknown field")
    for ok, text in [*_rules("idempotency_key"), _length(own, 128)]:
        reason = reason.when(~ok, text)
    return rows.withColumns({"reject_reason": reason, "amount_value": F.col("amount").try_cast("decimal(18,2)"), "occurred_value": F.try_to_timestamp("occurred_at")})


def batch_verdicts(entries: DataFrame, batch_col: str = "batch_id") -> DataFrame:
    """A ledger batch is taken whole or not at all: 1 to LEDGER_BATCH_MAX entries, all valid."""
    per = entries.groupBy(batch_col).agg(F.count("*").alias("entries"), F.count_if(F.col("reject_reason").isNotNull()).alias("invalid"))
    return per.withColumn("accepted", (F.col("entries") <= LEDGER_BATCH_MAX) & (F.col("invalid") == 0))
