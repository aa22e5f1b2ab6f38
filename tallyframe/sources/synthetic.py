"""Synthetic pairs with known faults: hashes of the row number stand in for random draws."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_RANGE = 1 << 31


@dataclass(frozen=True)
class GeneratorConfig:
    count: int = 600
    drop_rate: float = 0.04
    duplicate_rate: float = 0.02
    drift_rate: float = 0.03
    time_skew_ms: float = 400.0
    seed: int = 20260819
    currency: str = "INR"


#: The range of each setting.
COUNT_RANGE, RATE_RANGE, SKEW_RANGE = (100, 10_000), (0.0, 0.5), (0.0, 90_000.0)


def clamp(cfg: GeneratorConfig) -> GeneratorConfig:
    within = lambda v, r: min(r[1], max(r[0], v)) if math.isfinite(v) else r[0]
    return replace(
        cfg, count=int(within(cfg.count, COUNT_RANGE)), drop_rate=within(cfg.drop_rate, RATE_RANGE), duplicate_rate=within(cfg.duplicate_rate, RATE_RANGE),
        drift_rate=within(cfg.drift_rate, RATE_RANGE), time_skew_ms=within(cfg.time_skew_ms, SKEW_RANGE),
    )


def draw(i: Column, seed: int, salt: int) -> Column:
    """A share of one, a hash of the row number: the same on every run and any partitioning."""
    return F.pmod(F.xxhash64(i, F.lit(seed), F.lit(salt)), F.lit(_RANGE)).cast("double") / float(_RANGE)


def plan(spark: SparkSession, cfg: GeneratorConfig) -> DataFrame:
    """One row per planned pair: seq, txn_id, amounts in minor units, instants in ms, faults."""
    i = F.col("id")
    u = lambda salt: draw(i, cfg.seed, salt)
    amount = (5_000 + F.floor(u(1) * 4_995_000)).cast("long")
    share = (0.002 + u(5) * 0.006) * F.when(u(6) < 0.5, 1).otherwise(-1)
    moved = F.floor(amount * (1 + share) + 0.5).cast("long")
    ledger = F.when(u(4) < cfg.drift_rate, F.when(moved == amount, amount + 1).otherwise(moved)).otherwise(amount)
    # the sum of twelve draws is close to a normal one
    normal = sum((u(10 + j) for j in range(1, 12)), u(10)) - 6.0
    skew = F.floor(cfg.time_skew_ms + normal * max(cfg.time_skew_ms * 0.3, 1.0) + 0.5).cast("long")
    at = F.lit(1_773_480_600_000) + i * 100
    return spark.range(cfg.count).select(
        i.alias("seq"), F.concat(F.lit(f"TXN-{cfg.seed}-"), F.lpad(i.cast("string"), 8, "0")).alias("txn_id"), F.lit(cfg.currency).alias("currency"), amount.alias("amount_minor"), ledger.alias("ledger_minor"),
        at.alias("occurred_ms"), (at + skew).alias("ledger_occurred_ms"), (u(2) < cfg.drop_rate).alias("dropped"), (u(3) < cfg.duplicate_rate).alias("duplicate"),
    )


def planned_submissions(planned: DataFrame) -> DataFrame:
    """The plan as submissions of both sides, in the schema of the matcher's feeds."""
    money = lambda c: (F.col(c).cast("decimal(18,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(18,2)")
    at = lambda c: F.timestamp_millis(F.col(c)).cast("timestamp_ntz")
    copies = planned.withColumn("copy", F.explode(F.when(F.col("duplicate"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    gateway = copies.select(F.lit("gateway").alias("side"), (F.col("seq") * 2 + F.col("copy")).alias("row_id"), F.concat(F.lit("gw-"), "txn_id").alias("idempotency_key"), "txn_id", money("amount_minor").alias("amount"), "currency", at("occurred_ms").alias("occurred_at"), at("occurred_ms").alias("received_at"))
    ledger = planned.filter("not dropped").select(F.lit("ledger").alias("side"), F.col("seq").alias("row_id"), F.concat(F.lit("ldg-"), "txn_id").alias("idempotency_key"), "txn_id", money("ledger_minor").alias("amount"), "currency", at("ledger_occurred_ms").alias("occurred_at"), at("ledger_occurred_ms").alias("received_at"))
    return gateway.unionByName(ledger)
