"""The queue envelope: a pointer to a row, as JSON text, with defaults for what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import MESSAGE


def encode(rows: DataFrame) -> DataFrame:
    """One message per first receipt (side, row_id, txn_id, submissions)."""
    body = F.struct(F.col("side").alias("source"), "row_id", "txn_id", (F.col("submissions") > 1).alias("is_duplicate"), F.col("submissions").cast("int").alias("submissions"))
    return rows.select(F.to_json(body).alias("message"))


def decode(message: Column) -> Column:
    m = F.from_json(message, MESSAGE)
    return F.struct(m["source"].alias("source"), m["row_id"].alias("row_id"), m["txn_id"].alias("txn_id"), F.coalesce(m["is_duplicate"], F.lit(False)).alias("is_duplicate"), F.coalesce(m["submissions"], F.lit(1)).alias("submissions"))


def load(messages: DataFrame, receipts: DataFrame) -> DataFrame:
    """The rows that messages point to; a message without a row is passed over."""
    asked = messages.select(decode(F.col("message")).alias("m")).select(F.col("m.source").alias("side"), F.col("m.row_id").alias("row_id")).distinct()
    return receipts.join(asked, ["side", "row_id"], "left_semi")
