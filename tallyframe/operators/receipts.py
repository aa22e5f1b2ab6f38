"""Idempotent ingestion: the first receipt of a key wins, later ones only count."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import fresh
from ..functions.order import row_numbers
from ..functions.text import duplicate_notes

ARRIVAL = ("received_at", "row_id")
KEY = ("side", "idempotency_key")


def first_receipts(submissions: DataFrame) -> DataFrame:
    """One row per (side, key): the first submission's columns, and how many there were.

    One aggregation with map-side combining: a key sent a million times moves once per task.
    """
    rest = [c for c in submissions.columns if c not in (*KEY, *ARRIVAL)]
    first = F.min_by(F.struct(*ARRIVAL, *rest), F.struct(*ARRIVAL)).alias("first")
    return submissions.groupBy(*KEY).agg(first, F.count("*").alias("submissions")).select(*KEY, "first.*", "submissions").select(*submissions.columns, "submissions")


def duplicate_counts(submissions: DataFrame) -> DataFrame:
    return submissions.groupBy(*KEY).agg((F.count("*") - 1).alias("duplicate_count"))


def duplicate_markers(receipts: DataFrame, *keep: str) -> DataFrame:
    """A result for every key that was sent more than once; its row stays open to a match.

    keep: further columns of the receipt.
    """
    of = lambda side: F.when(F.col("side") == side, F.col("row_id"))
    return receipts.filter("submissions > 1").select(of("gateway").alias("gateway_id"), of("ledger").alias("ledger_id"), F.lit("duplicate").alias("status"), F.lit("duplicate").alias("match_layer"), duplicate_notes(F.col("submissions")).alias("notes"), *keep)


def acks(submissions: DataFrame) -> DataFrame:
    """What each submission was told: the kept row, whether it was a repeat, how many so far."""
    w = Window.partitionBy(*KEY).orderBy(*ARRIVAL)
    n = F.row_number().over(w)
    return submissions.select(*KEY, *ARRIVAL, "txn_id", F.first("row_id").over(w).alias("kept_row_id"), (n > 1).alias("duplicate"), n.cast("long").alias("submissions"))


def batch_acks(entries: DataFrame, batch_col: str = "batch_id") -> DataFrame:
    """Ledger batches, in request order: a key that is sent twice in one new batch is told
    duplicate both times, as is every key of an earlier batch."""
    key = ["side", "idempotency_key"]
    before = F.min(batch_col).over(Window.partitionBy(*key))
    inside = F.count("*").over(Window.partitionBy(*key, batch_col))
    so_far = F.count("*").over(Window.partitionBy(*key).orderBy(batch_col).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    first = F.first("row_id").over(Window.partitionBy(*key).orderBy(batch_col, "position"))
    return entries.select(batch_col, "position", "idempotency_key", first.alias("row_id"), "txn_id", ((inside > 1) | (before < F.col(batch_col))).alias("duplicate"), so_far.alias("submissions"))


def batch_ack_totals(acked: DataFrame, batch_col: str = "batch_id") -> DataFrame:
    return acked.groupBy(batch_col).agg(F.count_if(~F.col("duplicate")).alias("accepted"), F.count_if("duplicate").alias("duplicates"))


def batches(rows: DataFrame, size: int, order: list[str], within: str) -> DataFrame:
    """batch_id and position: runs of size rows in the given order, numbered within each group.

    Numbers come from one order over all rows, less the first of each group, so that a group
    with very many rows is no single task's work. order must tell a group's rows apart.
    """
    n, first = fresh(rows, "n"), fresh(rows, "first")
    numbered = row_numbers(rows, [within, *order], n)
    starts = numbered.groupBy(within).agg(F.min(n).alias(first))
    at = F.col(n) - F.col(first)
    placed = numbered.join(starts, within)
    return placed.withColumn("batch_id", F.concat_ws("-", F.col(within).cast("string"), F.floor(at / size).cast("string"))).withColumn("position", at % size).drop(n, first)
