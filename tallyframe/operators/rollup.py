"""Statistics that are kept as results come in: counts a minute, so a window reads no results.

A kept table holds, for each minute, how many results had a status, layer and latency. Each batch
of results appends its own counts; counts of several batches are summed where they are read.
Percentiles are picked by rank from the summed counts, which no one task holds. The minute in
which a window starts is the only one that is read result by result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import STATS_WINDOWS
from ..functions.frames import written
from ..functions.order import running_totals
from ..functions.times import add_us, diff_us, epoch_us

MINUTE_US = 60_000_000
CELL = ("status", "match_layer", "match_latency_ms")


def counted(results: DataFrame) -> DataFrame:
    """minute (since 1970), status, match_layer, match_latency_ms, n."""
    minute = F.floor(epoch_us("resolved_at") / MINUTE_US).cast("long")
    return results.groupBy(minute.alias("minute"), *CELL).agg(F.count("*").alias("n"))


def keep(results: DataFrame, path: str) -> None:
    """Adds the counts of results that were not kept before, in files by time, so that a window reads few of them."""
    counted(results).repartitionByRange("minute").sortWithinPartitions("minute").write.mode("append").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("minute long, status string, match_layer string, match_latency_ms long, n long").parquet(path)


def within(kept: DataFrame, results: DataFrame, window: str, as_of: Column) -> DataFrame:
    """status, match_layer, match_latency_ms, n over the window of this name that ends at as_of."""
    since = add_us(as_of, F.lit(-STATS_WINDOWS[window] * 1_000_000))
    start = diff_us(F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), since)
    first = F.ceil(start / MINUTE_US).cast("long")
    whole = kept.filter(F.col("minute") >= first)
    edge = results.filter((F.col("resolved_at") >= since) & (epoch_us("resolved_at") < first * MINUTE_US)).withColumn("n", F.lit(1).cast("long"))
    return whole.select(*CELL, "n").unionByName(edge.select(*CELL, "n")).groupBy(*CELL).agg(F.sum("n").alias("n"))


def percentiles(cells: DataFrame, pcts: tuple[int, ...]) -> DataFrame:
    """One row: latency_p<pct>, interpolated between ranks, of the latencies of all but duplicates."""
    counts = cells.filter("status <> 'duplicate' and match_latency_ms is not null").groupBy(F.col("match_latency_ms").alias("v")).agg(F.sum("n").alias("count"))
    upto = running_totals(counts, "v", "count", "upto")
    at = lambda p: (F.col("total") - 1) * (p / 100)
    asked = upto.agg(F.max("upto").alias("total")).select(F.explode(F.array(*(F.struct(F.lit(p).alias("pct"), at(p).alias("at")) for p in pcts))).alias("x")).select("x.*")
    # one row for each percentile
    met = upto.join(F.broadcast(asked), F.col("upto") > F.floor("at"))
    picked = met.groupBy("pct", "at").agg(F.min("v").alias("low"), F.min(F.when(F.col("upto") > F.ceil("at"), F.col("v"))).alias("high"))
    share = F.col("at") - F.floor("at")
    valued = picked.select("pct", (F.col("low") * (1 - share) + F.col("high") * share).alias("value"))
    return valued.agg(*(F.max(F.when(F.col("pct") == p, F.col("value"))).alias(f"latency_p{p}") for p in pcts))


def stats(kept: DataFrame, results: DataFrame, exceptions: DataFrame, window: str, as_of: Column) -> DataFrame:
    """The row of reads.stats, from kept counts."""
    return summed(within(kept, results, window, as_of), exceptions, window)


def summed(cells: DataFrame, exceptions: DataFrame, window: str) -> DataFrame:
    """One row of counts, percentiles and rates from counts by CELL over a window."""
    # the sums read them, and the ranks do twice
    cells = written(cells, "cells")
    seconds, status, n = STATS_WINDOWS[window], F.col("status"), F.col("n")
    of = lambda c, name: F.coalesce(F.sum(F.when(c, n)), F.lit(0)).alias(name)
    sums = cells.agg(
        of(status == "matched", "matched"), of(F.col("match_layer") == "time_drift", "matched_via_time_drift"), of(status == "unmatched_gateway_only", "unmatched_gateway_only"),
        of(status == "unmatched_ledger_only", "unmatched_ledger_only"), of(status == "duplicate", "duplicates"), of(status.isin("amount_drift", "time_drift"), "drift"),
    )
    opened = exceptions.agg(F.count_if(F.col("closed_at").isNull()).alias("open_exceptions"))
    # one row each
    one = sums.join(F.broadcast(percentiles(cells, (50, 95, 99)))).join(F.broadcast(opened))
    unmatched = F.col("unmatched_gateway_only") + F.col("unmatched_ledger_only")
    total = F.col("matched") + unmatched + F.col("drift")
    return one.select(
        F.lit(window).alias("window"), F.lit(seconds).cast("long").alias("window_seconds"), "*", unmatched.alias("unmatched"), total.alias("total"),
        F.when(total > 0, F.col("matched") / total).otherwise(0.0).alias("match_rate"), (total / F.lit(float(seconds))).alias("throughput_tx_per_sec"),
    )
