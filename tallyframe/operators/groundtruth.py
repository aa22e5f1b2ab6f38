"""Ground truth: verdicts predicted from a plan alone, in integer minor units.

This repeats the rules on purpose and shares no code with the matcher, so that a fault
there does not show up here as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXACT_MS, DRIFT_MS = 2_000, 60_000
DRIFT_BPS, FLOOR_MINOR = 100, 1_000
VERDICTS = ("matched_exact", "matched_time_drift", "amount_drift", "unmatched_gateway_only", "unmatched_ledger_only", "unmatched_both")
#: Columns that a plan may lack: then every gateway row is sent, and both rows are of one currency.
OPTIONAL = ("absent", "currency", "ledger_currency")


def verdict() -> Column:
    """Of one planned pair: amount_minor, ledger_minor, occurred_ms, ledger_occurred_ms, dropped
    (no ledger row), absent (no gateway row), currency, ledger_currency."""
    apart = F.abs(F.col("ledger_occurred_ms") - F.col("occurred_ms"))
    off = F.abs(F.col("amount_minor") - F.col("ledger_minor")) * 10_000
    band = F.greatest(F.abs(F.col("amount_minor")) * DRIFT_BPS, F.lit(FLOOR_MINOR * 10_000))
    return (
        F.when(F.col("dropped") & F.col("absent"), F.lit(None))
        .when(F.col("dropped"), "unmatched_gateway_only")
        .when(F.col("absent"), "unmatched_ledger_only")
        .when(F.col("currency") != F.col("ledger_currency"), "unmatched_both")
        .when(apart > DRIFT_MS, "unmatched_both")
        .when((off > 0) & (off <= band), "amount_drift")
        .when(off > 0, "unmatched_both")
        .when(apart <= EXACT_MS, "matched_exact")
        .otherwise("matched_time_drift")
    )


def totals(planned: DataFrame) -> DataFrame:
    """One row: counts by verdict, duplicates, and the totals that follow from them."""
    one_currency = F.col("currency") if "currency" in planned.columns else F.lit("")
    defaults = dict(zip(OPTIONAL, (F.lit(False), one_currency, one_currency), strict=True))
    v = planned.withColumns({c: x for c, x in defaults.items() if c not in planned.columns}).withColumn("verdict", verdict())
    n = v.agg(*(F.count_if(F.col("verdict") == x).alias(x) for x in VERDICTS), F.count_if("duplicate").alias("duplicates"), F.count("*").alias("planned"))
    matched = F.col("matched_exact") + F.col("matched_time_drift")
    gateway, ledger = F.col("unmatched_gateway_only") + F.col("unmatched_both"), F.col("unmatched_ledger_only") + F.col("unmatched_both")
    active = matched + F.col("amount_drift") + gateway + ledger
    return n.select(
        "planned", "matched_exact", "matched_time_drift", "amount_drift", gateway.alias("unmatched_gateway"), ledger.alias("unmatched_ledger"), "duplicates", matched.alias("matched"),
        (active + F.col("duplicates")).alias("expected_results"), active.alias("expected_active"), F.when(active > 0, matched / active).otherwise(0.0).alias("expected_match_rate"),
    )


def detected(results: DataFrame) -> DataFrame:
    """The same counts from an engine's results (gateway_id, ledger_id, status, match_layer)."""
    n = lambda c: F.count_if(c)
    s, layer = F.col("status"), F.col("match_layer")
    return results.agg(
        n((s == "matched") & (layer == "exact")).alias("matched_exact"), n((s == "matched") & (layer == "time_drift")).alias("matched_time_drift"), n(s == "amount_drift").alias("amount_drift"),
        n(s == "unmatched_gateway_only").alias("unmatched_gateway"), n(s == "unmatched_ledger_only").alias("unmatched_ledger"), n(s == "duplicate").alias("duplicates"),
    )


def _lines(one: DataFrame, lines: dict[str, Column], name: str) -> DataFrame:
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("category"), v.alias(name)) for k, v in lines.items()))).alias("x")).select("x.*")


def _side_by_side(truth: DataFrame, found: DataFrame, lines: dict[str, Column]) -> DataFrame:
    both = _lines(truth, lines, "injected").join(_lines(found, lines, "detected"), "category")
    return both.withColumn("delta", F.col("detected") - F.col("injected")).withColumn("agrees", F.col("delta") == 0)


def verify(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Four lines: matched, drift, unmatched (both sides), duplicates."""
    c = F.col
    return _side_by_side(truth, found, {"matched": c("matched_exact") + c("matched_time_drift"), "amount drift": c("amount_drift"), "unmatched": c("unmatched_gateway") + c("unmatched_ledger"), "duplicates": c("duplicates")})


def compare(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Six lines; a pair that is broken on both sides counts on both orphan lines."""
    names = ("matched_exact", "matched_time_drift", "amount_drift", "unmatched_gateway", "unmatched_ledger", "duplicates")
    return _side_by_side(truth, found, {n: F.col(n) for n in names})


def write_truth(truth: DataFrame, path: str) -> None:
    truth.coalesce(1).write.mode("overwrite").json(path)
