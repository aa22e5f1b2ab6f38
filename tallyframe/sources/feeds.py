"""Gateway and ledger feeds made from an orders table by arithmetic on its key.

The same rules give the same rows in any engine: which rows are absent, sent twice, drifted
in time or amount, or in another currency follows from the order key alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import money
from ..functions.times import add_us

CURRENCIES = ("INR", "USD", "EUR", "GBP")


#: Orders that one task expands to submissions.
ORDERS_A_TASK = 250_000


def spread(orders: DataFrame) -> DataFrame:
    """Key, price and date of orders, over enough tasks for what each is expanded to; a count reads no column."""
    few = orders.select("o_orderkey", "o_totalprice", "o_orderdate")
    parts = -(-orders.count() // ORDERS_A_TASK)
    return few.repartition(parts) if parts > 1 else few


def _every(k: Column, n: int, r: int) -> Column:
    return F.pmod(k, F.lit(n)) == r


def pick(values: Sequence[str], at: Column) -> Column:
    """The value at a place, counted from 0; null beyond the last."""
    return F.get(F.array(*map(F.lit, values)), at.cast("int"))


def _planned(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    return orders.select(
        k.alias("k"), F.concat(F.lit("TXN-"), F.lpad(k.cast("string"), 8, "0")).alias("txn_id"), money(F.col("o_totalprice")).alias("planned"),
        pick(CURRENCIES, F.pmod(k, F.lit(4))).alias("planned_currency"),
        add_us(F.col("o_orderdate"), (k % 86400) * 1_000_000).alias("at"),
    )


def gateway_submissions(orders: DataFrame) -> DataFrame:
    """Every webhook received; a retry has the same key, a later receipt and another body."""
    k = F.col("k")
    first = _planned(orders).filter(~_every(k, 50, 11))
    both = first.withColumn("copy", F.explode(F.when(_every(k, 33, 7), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return both.select(
        F.lit("gateway").alias("side"), (k * 2 + F.col("copy")).alias("row_id"), F.concat(F.lit("gw-"), F.col("txn_id")).alias("idempotency_key"), "txn_id",
        money(F.col("planned") + F.col("copy")).alias("amount"), F.col("planned_currency").alias("currency"), F.col("at").alias("occurred_at"),
        add_us(F.col("at"), (k % 7 + F.col("copy") * 5) * 1_000_000).alias("received_at"),
    )


def ledger_submissions(orders: DataFrame) -> DataFrame:
    k = F.col("k")
    amount = F.when(_every(k, 25, 4), money(F.col("planned") * F.lit("1.005").cast("decimal(4,3)"))).when(_every(k, 25, 9), money(F.col("planned") * F.lit("1.02").cast("decimal(3,2)"))).otherwise(F.col("planned"))
    ms = F.when(k % 10 < 6, (k * 37) % 4001 - 2000).otherwise((k * 7919) % 140001 - 70000)
    at = add_us(F.col("at"), ms * 1000)
    return _planned(orders).filter(~_every(k, 20, 3)).select(
        F.lit("ledger").alias("side"), k.alias("row_id"), F.concat(F.lit("ld-"), F.col("txn_id")).alias("idempotency_key"), "txn_id", amount.alias("amount"),
        F.when(_every(k, 97, 13), "JPY").otherwise(F.col("planned_currency")).alias("currency"), at.alias("occurred_at"), add_us(at, (k % 11) * 1_000_000).alias("received_at"),
    )


def contested(orders: DataFrame) -> DataFrame:
    """Four orders share a txn_id, currency and ten minutes: several partners fit each row."""
    k = F.col("o_orderkey")
    q = F.floor(k / 4).cast("long")
    at = add_us(F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), (q * 600 + k % 4 * 11) * 1_000_000)
    amount = money(F.lit(1000) + 5 * (k % 3))
    base = orders.select(k.alias("k"), F.concat(F.lit("GRP-"), q.cast("string")).alias("txn_id"), pick(CURRENCIES, F.pmod(q, F.lit(4))).alias("currency"), amount.alias("amount"), at.alias("at"))
    k = F.col("k")
    side = lambda name, ahead_s, drift, late_s: base.select(
        F.lit(name).alias("side"), "k", k.alias("row_id"), F.concat(F.lit(name + "-"), k.cast("string")).alias("idempotency_key"), "txn_id", money(F.col("amount") + drift).alias("amount"), "currency",
        add_us(F.col("at"), ahead_s * 1_000_000).alias("occurred_at"), add_us(F.col("at"), late_s * 1_000_000).alias("received_at"),
    )
    return side("gateway", F.lit(0), F.lit(0), k % 7).filter("k % 9 <> 2").unionByName(side("ledger", k * 3 % 5, 5 * (k % 2), k % 5 + 1).filter("k % 11 <> 5")).drop("k")


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spread(spark.read.parquet(f"{sf_dir}/orders.parquet"))
    return gateway_submissions(orders).unionByName(ledger_submissions(orders))
