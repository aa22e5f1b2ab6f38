"""What a stream still holds: the matcher's waiting rows, read from its checkpoint as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .matcher import DELAY_MS, WAITING, state_path
from .versions import Versions


def _held(spark: SparkSession, checkpoint: str) -> DataFrame:
    kept = Versions(state_path(checkpoint), DELAY_MS)
    version, _, clock_ms = kept.before(spark)
    return kept.read(spark, "rows", version, WAITING).filter(F.col("due_ms") > clock_ms)


def pending(spark: SparkSession, checkpoint: str) -> DataFrame:
    """side, row_id, txn_id, currency, amount, occurred_at, received_at of rows that wait for a partner.

    checkpoint: the folder that matcher.run_available was given. The state is read where it
    lies; the stream need not run.
    """
    at = lambda c: F.timestamp_micros(f"{c}_us").cast("timestamp_ntz").alias(f"{c}_at")
    return _held(spark, checkpoint).select("side", "row_id", "txn_id", "currency", "amount", at("occurred"), at("received"))


def partitions(spark: SparkSession, checkpoint: str) -> DataFrame:
    """side, partition_id, keys, rows: how the waiting rows are spread over the state's files, of which tasks read them."""
    rows = _held(spark, checkpoint).withColumn("partition_id", F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("int"))
    return rows.groupBy("side", "partition_id").agg(F.count_distinct("txn_id", "currency").alias("keys"), F.count("*").alias("rows"))
