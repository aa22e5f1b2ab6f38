"""Results: matches, duplicate markers and breaks in one frame; exceptions and closures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, EXCEPTION_STATUSES, MAX_SWEEP_PASSES, SWEEP_BATCH, MatchConfig
from ..functions.frames import written
from ..functions.order import row_numbers
from ..functions.text import match_notes, unmatched_notes
from ..functions.times import add_us, diff_us, match_latency_ms
from . import matching, receipts as receipt_ops

COLUMNS = ("gateway_id", "ledger_id", "status", "match_layer", "resolved_at", "match_latency_ms", "notes")


def match_results(matches: DataFrame, cfg: MatchConfig = DEFAULT, delay_us: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """A result per match, decided delay_us after the later of its two rows arrived. keep: further columns of matches."""
    later = F.greatest("g_received_at", "l_received_at")
    resolved = add_us(later, delay_us) if delay_us is not None else later
    status = F.when(F.col("match_layer") == "amount_drift", "amount_drift").otherwise("matched")
    rows = matches.withColumn("resolved_at", resolved)
    return rows.select(
        F.col("g_row_id").alias("gateway_id"), F.col("l_row_id").alias("ledger_id"), status.alias("status"), "match_layer", "resolved_at",
        match_latency_ms(F.col("g_received_at"), F.col("l_received_at"), F.col("resolved_at")).alias("match_latency_ms"),
        match_notes(F.col("match_layer"), F.col("dt_us"), F.col("g_amount"), F.col("l_amount"), cfg).alias("notes"), *keep,
    )


def pending(receipts: DataFrame, matches: DataFrame) -> DataFrame:
    """Receipts without a match; a duplicate marker leaves a row pending."""
    taken = matches.select(F.lit("gateway").alias("side"), F.col("g_row_id").alias("row_id")).unionByName(matches.select(F.lit("ledger").alias("side"), F.col("l_row_id").alias("row_id")))
    # the id first: a sort tells rows apart by it, while there are but two sides
    return receipts.join(taken, ["row_id", "side"], "left_anti").select(*receipts.columns)


def stale(pending_rows: DataFrame, as_of: Column, cfg: MatchConfig = DEFAULT) -> DataFrame:
    """Strictly older than the wait at as_of."""
    return pending_rows.filter(diff_us(F.col("received_at"), as_of) > cfg.unmatched_after_s * 1_000_000)


def oldest(rows: DataFrame, limit: int) -> DataFrame:
    """The oldest rows first, by row id among equals."""
    return rows.orderBy("received_at", "row_id").limit(limit)


def breaks(stale_rows: DataFrame, as_of: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """One-sided results for rows that waited too long, with what they waited in their notes."""
    of = lambda s: F.when(F.col("side") == s, F.col("row_id"))
    us = diff_us(F.col("received_at"), as_of)
    waited = F.bround(us.cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)"), 0).cast("decimal(20,0)")
    return stale_rows.select(
        of("gateway").alias("gateway_id"), of("ledger").alias("ledger_id"), F.concat(F.lit("unmatched_"), "side", F.lit("_only")).alias("status"), F.lit("unmatched_sweep").alias("match_layer"),
        as_of.alias("resolved_at"), F.greatest(F.floor(us / 1000), F.lit(0)).cast("long").alias("match_latency_ms"), unmatched_notes(waited).alias("notes"), *keep,
    )


def sweep(receipts: DataFrame, matches: DataFrame, as_of: Column, cfg: MatchConfig = DEFAULT, mode: str = "arrived") -> DataFrame:
    """Pending rows first try every pending partner, stale or not; then the stale ones break.

    One pass settles all that any number of passes would: what is left has no partner.
    """
    waiting = written(pending(receipts, matches), "waiting")
    rematched, left = _swept(waiting, as_of, cfg, mode)
    return rematched.unionByName(breaks(stale(left, as_of, cfg), as_of))


def _swept(waiting: DataFrame, as_of: Column, cfg: MatchConfig, mode: str) -> tuple[DataFrame, DataFrame]:
    """Results of stale rows that find a partner after all, and the rows that do not."""
    late = lambda c: diff_us(F.col(c), as_of) > cfg.unmatched_after_s * 1_000_000
    again = written(matching.assign(matching.classified(waiting, cfg), mode).filter(late("g_received_at") | late("l_received_at")), "rematched")
    return _decided_at(again, as_of, cfg), pending(waiting, again)


def _decided_at(matches: DataFrame, as_of: Column, cfg: MatchConfig) -> DataFrame:
    """Matches found by a sweep at as_of, which is when their latency ends."""
    return match_results(matches, cfg, diff_us(F.greatest("g_received_at", "l_received_at"), as_of)).withColumn("resolved_at", as_of)


def drain(receipts: DataFrame, matches: DataFrame, as_of: Column, cfg: MatchConfig = DEFAULT, mode: str = "arrived", batch: int = SWEEP_BATCH, max_passes: int | None = MAX_SWEEP_PASSES) -> tuple[DataFrame, bool]:
    """(results, drained): passes over the oldest stale rows, batch of a side in each.

    A pass takes the next batch of each side, by age; a row that an earlier pass matched leaves its
    place empty. The passes end when none is left (drained) or when their number is spent; what is
    left stays pending. max_passes: None for as many as there are.

    The passes are made at once: a pair belongs to the first pass that takes one of its rows, and
    the greedy scan goes by pass before all else, so it meets the pairs as one pass after the other
    would. Their number costs nothing.
    """
    waiting = written(pending(receipts, matches), "waiting")
    late = stale(waiting, as_of, cfg)
    per = lambda s: row_numbers(late.filter(F.col("side") == s).select("side", "row_id", "received_at"), ["received_at", "row_id"], "n")
    numbered_rows = written(per("gateway").unionByName(per("ledger")).select("side", "row_id", F.floor((F.col("n") - 1) / batch).cast("long").alias("pass")), "sweep-passes")
    last = numbered_rows.agg(F.max("pass")).first()[0]
    # the pass that finds nothing is one of them
    drained = max_passes is None or (-1 if last is None else last) + 1 < max_passes
    if not drained:
        numbered_rows = numbered_rows.filter(F.col("pass") < max_passes)
    passed = written(waiting.join(numbered_rows, ["side", "row_id"], "left"), "waiting")
    pairs = matching.classified(passed, cfg, ("pass",)).withColumn("pass", F.least("g_pass", "l_pass")).filter("pass is not null")
    again = written(matching.assign(pairs, mode, first="pass"), "rematched")
    return _decided_at(again, as_of, cfg).unionByName(breaks(pending(passed.filter("pass is not null"), again), as_of)), drained


def append(kept: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of found that a results table may take beside kept; a conflict is a no-op.

    A row has one result that is not a duplicate marker, and one marker; a result whose rows
    have theirs is left out, so a batch that is sent again adds nothing.
    """
    kind = (F.col("status") == "duplicate").alias("marker")
    has = lambda c: kept.filter(F.col(c).isNotNull()).select(c, kind)
    fresh = found.withColumn("marker", kind)
    for c in ("gateway_id", "ledger_id"):
        fresh = fresh.join(has(c), [c, "marker"], "left_anti")
    return fresh.select(*found.columns)


def duplicates(receipts: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Duplicate markers as results, decided when the row was first received."""
    marked = receipt_ops.duplicate_markers(receipts, "received_at", *keep)
    return marked.select("gateway_id", "ledger_id", "status", "match_layer", F.col("received_at").alias("resolved_at"), F.lit(0).cast("long").alias("match_latency_ms"), "notes", *keep)


def reconcile(submissions: DataFrame, as_of: Column, cfg: MatchConfig = DEFAULT, mode: str = "arrived") -> DataFrame:
    """Everything the engine decides about a feed up to as_of."""
    rec = written(receipt_ops.first_receipts(submissions), "receipts")
    matches = matching.assign(matching.classified(rec, cfg), mode)
    waiting = stale(pending(rec, matches), as_of, cfg)
    return match_results(matches, cfg).unionByName(duplicates(rec)).unionByName(breaks(waiting, as_of)).select(*COLUMNS)


def numbered(results: DataFrame) -> DataFrame:
    """Results with ids, 1 .. n, in the order of decision."""
    return row_numbers(results, ["resolved_at", "status", "gateway_id", "ledger_id"], "id")


def exceptions(results: DataFrame) -> DataFrame:
    """One open exception for each result of an exception status."""
    return results.filter(F.col("status").isin(*EXCEPTION_STATUSES)).select(F.col("id"), F.col("id").alias("result_id"), F.col("resolved_at").alias("opened_at"))


def closed(opened: DataFrame, closures: DataFrame) -> DataFrame:
    """Exceptions with the first closure that names them, or open."""
    first = closures.groupBy("exception_id").agg(F.min_by(F.struct("closed_at", "resolution_notes"), F.struct("closed_at", "seq")).alias("c"))
    joined = opened.join(first, opened["id"] == F.col("exception_id"), "left")
    return joined.select(*opened.columns, F.col("c.closed_at").alias("closed_at"), F.col("c.resolution_notes").alias("resolution_notes"))


def closure_outcomes(opened: DataFrame, closures: DataFrame) -> DataFrame:
    """Each request's outcome: closed, conflict (someone was first), or not_found."""
    n = F.row_number().over(Window.partitionBy("exception_id").orderBy("closed_at", "seq"))
    asked = closures.withColumn("n", n).join(opened.select(F.col("id").alias("exception_id"), F.lit(True).alias("known")), "exception_id", "left")
    return asked.select("exception_id", "seq", F.when(F.col("known").isNull(), "not_found").when(F.col("n") == 1, "closed").otherwise("conflict").alias("outcome"))
