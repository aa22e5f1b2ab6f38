"""The read path: feeds, pages, statistics, the layer cascade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import PAGE_LIMIT, PAGE_LIMIT_MAX, STATS_WINDOWS, STATUSES
from ..functions.order import row_numbers
from ..functions.times import diff_us, whole_ms
from . import rollup


def checked_page(limit: int = PAGE_LIMIT, cursor: int | None = None, status: str | None = None) -> None:
    if not 1 <= limit <= PAGE_LIMIT_MAX:
        raise ValueError(f"limit must be 1 to {PAGE_LIMIT_MAX}")
    if cursor is not None and cursor < 1:
        raise ValueError("cursor must be a positive id")
    if status is not None and status not in STATUSES:
        raise ValueError(f"unknown status {status}")


def feed(results: DataFrame, receipts: DataFrame) -> DataFrame:
    """Results with what both sides say, skew and difference (ledger minus gateway)."""
    of = lambda s, p: receipts.filter(F.col("side") == s).select(F.col("row_id").alias(f"{s}_id"), *(F.col(c).alias(f"{p}_{c}") for c in ("txn_id", "currency", "amount", "occurred_at")))
    both = results.join(of("gateway", "g"), "gateway_id", "left").join(of("ledger", "l"), "ledger_id", "left")
    return shown(both.withColumns({c: F.coalesce(f"g_{c}", f"l_{c}") for c in ("txn_id", "currency")}))


#: What results may carry of their rows, so that a feed needs no join: see with_sides and shown.
SIDES = ("txn_id", "currency", "g_amount", "l_amount", "g_occurred_at", "l_occurred_at")


def with_sides(receipts: DataFrame) -> DataFrame:
    """Receipts with SIDES: their own facts on their side, nothing on the other. Pairs have SIDES as they are."""
    return receipts.withColumns({f"{s[0]}_{c}": F.when(F.col("side") == s, F.col(c)) for s in ("gateway", "ledger") for c in ("amount", "occurred_at")})


def shown(both: DataFrame) -> DataFrame:
    """The feed of results that carry SIDES."""
    keep = [c for c in ("id", "status", "match_layer", "resolved_at", "match_latency_ms", "notes") if c in both.columns]
    return both.select(
        *keep, "gateway_id", "ledger_id", "txn_id", "currency",
        F.col("g_amount").alias("gateway_amount"), F.col("l_amount").alias("ledger_amount"), F.col("g_occurred_at").alias("gateway_occurred_at"), F.col("l_occurred_at").alias("ledger_occurred_at"),
        whole_ms(diff_us(F.col("g_occurred_at"), F.col("l_occurred_at"))).alias("skew_ms"), (F.col("l_amount") - F.col("g_amount")).cast("decimal(19,2)").alias("amount_delta"),
    )


def page(rows: DataFrame, limit: int = PAGE_LIMIT, cursor: int | None = None, status: str | None = None) -> DataFrame:
    """The newest rows below a cursor, one more than limit: that row says there is a next page."""
    checked_page(limit, cursor, status)
    if status is not None:
        rows = rows.filter(F.col("status") == status)
    if cursor is not None:
        rows = rows.filter(F.col("id") < cursor)
    return rows.orderBy(F.desc("id")).limit(limit + 1)


def page_numbers(rows: DataFrame, limit: int) -> DataFrame:
    """The page that each row stands on in a whole walk, newest first."""
    checked_page(limit)
    return row_numbers(rows, [F.desc("id")], "n").withColumn("page", F.floor((F.col("n") - 1) / limit).cast("long")).drop("n")


def exception_feed(exceptions: DataFrame, enriched: DataFrame, open_only: bool | None = None) -> DataFrame:
    """Exceptions with their enriched result; open_only: True open, False closed, None all."""
    if open_only is not None:
        exceptions = exceptions.filter(F.col("closed_at").isNull() if open_only else F.col("closed_at").isNotNull())
    return exceptions.join(enriched.withColumnRenamed("id", "result_id"), "result_id")


def stats(results: DataFrame, exceptions: DataFrame, window: str, as_of: Column) -> DataFrame:
    """One row of counts, percentiles and rates over a window that ends at as_of.

    Percentiles are picked by rank from counts of latencies, which no one task holds.
    """
    near = results.filter(diff_us(F.col("resolved_at"), as_of) <= STATS_WINDOWS[window] * 1_000_000)
    return rollup.summed(near.groupBy(*rollup.CELL).agg(F.count("*").alias("n")), exceptions, window)


def layer_cascade(results: DataFrame) -> DataFrame:
    """What each layer decided, its share, and what was handed to it by the layers before."""
    ranks = F.create_map(*(F.lit(x) for pair in {"exact": 1, "time_drift": 2, "amount_drift": 3, "duplicate": 4, "unmatched_sweep": 5}.items() for x in pair))
    spark = results.sparkSession
    layers = spark.range(1, 6).select(F.col("id").cast("int").alias("rank"))
    counts = results.groupBy("match_layer").agg(F.count("*").alias("n")).select(ranks[F.col("match_layer")].alias("rank"), "n")
    w = Window.orderBy("rank")  # five rows
    rows = layers.join(F.broadcast(counts), "rank", "left").withColumn("decided", F.coalesce("n", F.lit(0)))
    all_ = F.sum("decided").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    carried = F.sum("decided").over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return rows.select("rank", F.col("decided").alias("count"), carried.alias("carried_in"), F.when(all_ > 0, F.col("decided") / all_).otherwise(0.0).alias("share"))
