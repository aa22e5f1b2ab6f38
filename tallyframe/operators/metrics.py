"""Metrics: histograms with fixed buckets, nearest-rank percentiles, backlog, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.order import running_totals

#: Upper bounds of the latency histogram, in seconds.
LATENCY_BUCKETS = (0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 300.0)


def histogram(rows: DataFrame, value: Column, buckets: tuple[float, ...] = LATENCY_BUCKETS) -> DataFrame:
    """Cumulative counts at or below each bound (infinity last), in one scan."""
    counts = [F.count_if(value <= b).alias(f"b{i}") for i, b in enumerate(buckets)]
    one = rows.agg(*counts, F.count(value).alias("b_inf"))
    pairs = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("count")) for i, b in enumerate(buckets)]
    pairs.append(F.struct(F.lit(None).cast("double").alias("le"), F.col("b_inf").alias("count")))
    return one.select(F.explode(F.array(*pairs)).alias("x")).select("x.*")


def nearest_rank(rows: DataFrame, value: str, pcts: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """The value at index round(p / 100 x (n - 1)), halves to even, of the sorted values.

    Counts of distinct values are summed in order, so the values are never gathered.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("count"))
    upto = running_totals(counts, "v", "count", "upto")
    total = upto.agg(F.sum("count").alias("n"))
    asked = total.select("n", F.explode(F.array(*map(F.lit, pcts))).alias("pct")).withColumn("at", F.bround(F.col("pct").cast("decimal(6,2)") * (F.col("n") - 1).cast("decimal(18,0)") / 100, 0).cast("long"))
    # one row for each pct
    return upto.join(F.broadcast(asked), F.col("upto") > F.col("at")).groupBy("pct").agg(F.min("v").alias("value"))


def status_totals(results: DataFrame) -> DataFrame:
    return results.groupBy("status", "match_layer").agg(F.count("*").alias("n"), F.avg("match_latency_ms").alias("mean_latency_ms"))


def backlog(receipts: DataFrame, waiting: DataFrame, as_of: Column, after_s: int) -> DataFrame:
    """One row: rows received, rows pending, rows overdue at as_of."""
    late = F.timestamp_diff("MICROSECOND", "received_at", as_of) > after_s * 1_000_000
    return receipts.agg(F.count("*").alias("received")).join(waiting.agg(F.count("*").alias("pending"), F.count_if(late).alias("overdue")))


def observed(rows: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """rows with counters that fill as they are written."""
    o = Observation(name)
    return rows.observe(o, F.count("*").alias("rows"), F.count_if(F.col("status") == "matched").alias("matched")), o


def settled(produced: int, expected: int) -> bool:
    """A run has settled when it has produced at least what was planned."""
    return produced >= expected


def achieved(rows: int, seconds: float) -> float:
    return rows / seconds if seconds > 0 else 0.0
