"""Greedy assignment by a sweep over arrivals, without writing any pairs.

The rows of a transaction and currency are cut where nothing occurred for longer than the drift
window: no pair reaches over such a gap, so the cuts are exact. Each stretch is swept in order
of arrival. An arriving row asks the free rows of the other side: those of its own amount, in
order of time, for the nearest (exact and time drift), and a tree over amounts, whose nodes keep
their free rows in order of time, for the nearest whose amount lies in the band (amount drift).
A stretch with n rows costs n log^2 n however many of them would fit each other.

A transaction with most of all rows is spread over tasks by its cuts; finding these needs one
row a range partition on the driver. A stretch that never pauses is one task's work up to
``STRETCH_ROWS``; longer ones go to the rounds of ``matching.assign``.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from math import inf

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, MatchConfig
from ..functions.frames import written
from ..functions.order import placed
from . import matching

#: Rows of a stretch that one task sweeps; about 200 bytes each.
STRETCH_ROWS = 2_000_000
#: Long stretches (a number each) that are broadcast at most.
BROADCAST_STRETCHES = 100_000

FOUND = "txn_id string, currency string, g_row_id long, g_cents long, g_occurred_us long, g_received_us long, l_row_id long, l_cents long, l_occurred_us long, l_received_us long, rank int"
_FOUND_TYPES = [pa.string(), pa.string(), *[pa.int64()] * 8, pa.int32()]


class Free:
    """Free rows (row_id, cents, occurred_us, received_us) of one side of a stretch."""

    def __init__(self, rows: list[tuple], cfg: MatchConfig) -> None:
        self.window, self.exact = cfg.drift_window_us, cfg.exact_window_us
        self.amounts = sorted({r[1] for r in rows})
        self.base = len(self.amounts)
        self.same: dict[int, list[tuple]] = {}
        self.nodes: list[list[tuple]] = [[] for _ in range(2 * self.base)]

    def _up(self, cents: int) -> Iterator[list[tuple]]:
        at = self.base + bisect_left(self.amounts, cents)
        while at:
            yield self.nodes[at]
            at //= 2

    def add(self, row: tuple) -> None:
        insort(self.same.setdefault(row[1], []), (row[2], row[0], row))
        for node in self._up(row[1]):
            insort(node, (row[2], row[1], row[0], row))

    def take(self, row: tuple) -> None:
        own = self.same[row[1]]
        del own[bisect_left(own, (row[2], row[0]))]
        for node in self._up(row[1]):
            del node[bisect_left(node, (row[2], row[1], row[0]))]

    def _instants(self, held: list[tuple], at: int) -> list[int]:
        """The nearest instants of a list in order of time: one, or two that are as near."""
        i = bisect_left(held, (at, -inf))
        near = [held[j][0] for j in (i - 1, i) if 0 <= j < len(held)]
        least = min((abs(x - at) for x in near), default=inf)
        return [x for x in near if abs(x - at) == least] if least <= self.window else []

    def of_amount(self, cents: int, at: int) -> tuple[int, tuple] | None:
        own = self.same.get(cents, ())
        near = [own[bisect_left(own, (x, -inf))] for x in self._instants(own, at)]
        if not near:
            return None
        t, _, row = min(near, key=lambda e: e[1])
        return (0 if abs(t - at) <= self.exact else 1), row

    def _cover(self, lo: int, hi: int) -> Iterator[list[tuple]]:
        """The tree's nodes that make up the amounts from place lo to before hi."""
        lo, hi = lo + self.base, hi + self.base
        while lo < hi:
            if lo & 1:
                yield self.nodes[lo]
                lo += 1
            if hi & 1:
                hi -= 1
                yield self.nodes[hi]
            lo, hi = lo // 2, hi // 2

    def in_band(self, cents: int, at: int, fits: Callable[[int], bool]) -> tuple | None:
        """The nearest row of another amount that fits, the nearer amount and smaller id first."""
        own, after = bisect_left(self.amounts, cents), bisect_left(self.amounts, cents + 1)
        # amounts that fit are those next to cents, on either side
        lo = bisect_left(range(own), True, key=lambda i: fits(self.amounts[i]))
        hi = after + bisect_left(range(self.base - after), True, key=lambda i: not fits(self.amounts[after + i]))
        best: tuple = (inf,)
        for below, nodes in ((True, self._cover(lo, own)), (False, self._cover(after, hi))):
            for node in nodes:
                for t in self._instants(node, at):
                    i = bisect_left(node, (t, inf)) - 1 if below else bisect_left(node, (t, -inf))
                    amount = node[i][1]
                    row = node[bisect_left(node, (t, amount, -inf))][3]
                    best = min(best, (abs(t - at), abs(amount - cents), row[0], row), key=lambda b: b[:3])
        return best[3] if len(best) > 1 else None


def band(cfg: MatchConfig) -> Callable[[int, int], bool]:
    """Whether a gateway's and a ledger's cents are within the tolerance, in whole numbers."""
    num, den = cfg.amount_drift_pct.as_integer_ratio()
    floor, floor_den = (cfg.amount_drift_floor * 100).as_integer_ratio()
    return lambda g, led: abs(g - led) * den * floor_den <= max(abs(g) * num * floor_den, floor * den)


def swept(rows: list[tuple], cfg: MatchConfig) -> list[tuple]:
    """(gateway, ledger, rank) of a stretch's rows (side, row_id, cents, occurred_us, received_us)."""
    sides = [[r[1:] for r in rows if r[0] == s] for s in ("gateway", "ledger")]
    if not all(sides):
        return []
    free, fits, out = [Free(s, cfg) for s in sides], band(cfg), []
    for row in sorted(rows, key=lambda r: (r[4], r[0], r[1])):
        me = int(row[0] == "ledger")
        mine, other = row[1:], free[1 - me]
        _, cents, at, _ = mine
        found = other.of_amount(cents, at)
        if found is None:
            drift = other.in_band(cents, at, (lambda x, c=cents: fits(x, c)) if me else (lambda x, c=cents: fits(c, x)))
            found = (2, drift) if drift else None
        if found is None:
            free[me].add(mine)
            continue
        rank, partner = found
        other.take(partner)
        out.append((partner, mine, rank) if me else (mine, partner, rank))
    return out


def _sweep(cfg: MatchConfig) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple] = []
        key = None

        def done() -> None:
            out.extend((*key[1:], *g, *led, rank) for g, led, rank in swept(held, cfg))
            held.clear()

        def batch() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(_FOUND_TYPES)], names=[c.split()[0] for c in FOUND.split(", ")])
            out.clear()
            return b

        for b in batches:
            for stretch, txn, ccy, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key and stretch != key[0]:
                    done()
                key = (stretch, txn, ccy)
                held.append(tuple(row))
            if out:
                yield batch()
        if held:
            done()
        if out:
            yield batch()

    return run


def _cuts(window: int, before: dict[int, tuple] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows with the number of their stretch if before (last row and number by partition) is
    known, else each partition's first and last row and its cuts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = first = last = None
        n = 0
        for b in batches:
            if not b.num_rows:
                continue
            numbers = []
            for p, txn, ccy, at in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                here = (txn, ccy, at)
                if part is None:
                    part, first = p, here
                    if before is not None:
                        last, n = before.get(p, (None, 0))
                if last is not None and (last[:2] != here[:2] or at - last[2] > window):
                    n += 1
                last = here
                numbers.append(n)
            if before is not None:
                yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), *b.columns[1:]], names=["stretch", *b.schema.names[1:]])
        if before is None and part is not None:
            row = (part, *first, *last, n)
            kinds = (pa.int64(), *(pa.string(), pa.string(), pa.int64()) * 2, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=["part", "txn", "ccy", "at", "last_txn", "last_ccy", "last_at", "cuts"])

    return run


def stretches(receipts: DataFrame, cfg: MatchConfig = DEFAULT) -> DataFrame:
    """stretch, txn_id, currency, occurred_us, side, row_id, cents, received_us of all rows that name a transaction and currency."""
    us = lambda c: F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(c))
    whole = receipts.filter("txn_id is not null and currency is not null and amount is not null and occurred_at is not null and received_at is not null")
    rows = whole.select("txn_id", "currency", us("occurred_at").alias("occurred_us"), "side", "row_id", (F.col("amount") * 100).cast("long").alias("cents"), us("received_at").alias("received_us"))
    kept = placed(rows, ["txn_id", "currency", "occurred_us", "side", "row_id"], "part")
    rows = kept.select("part", *rows.columns)
    ends = rows.mapInArrow(_cuts(cfg.drift_window_us, None), "part long, txn string, ccy string, at long, last_txn string, last_ccy string, last_at long, cuts long").collect()  # a row a partition
    before: dict[int, tuple] = {}
    last, n = None, 0
    for part, txn, ccy, at, last_txn, last_ccy, last_at, cuts in sorted(map(tuple, ends)):
        before[part] = (last, n)
        n += cuts + (last is not None and (last[:2] != (txn, ccy) or at - last[2] > cfg.drift_window_us))
        last = (last_txn, last_ccy, last_at)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "part")
    return rows.mapInArrow(_cuts(cfg.drift_window_us, before), f"stretch long, {fields}")


def assign(receipts: DataFrame, cfg: MatchConfig = DEFAULT, stretch_rows: int = STRETCH_ROWS) -> DataFrame:
    """The matches of ``matching.assign(matching.classified(receipts), "arrived")``, with its columns."""
    rows = written(stretches(receipts, cfg), "stretches")
    long = written(rows.groupBy("stretch").agg(F.count("*").alias("n")).filter(F.col("n") > stretch_rows).select("stretch"), "long-stretches")
    n = long.count()
    long = F.broadcast(long) if n <= BROADCAST_STRETCHES else long
    short = rows.join(long, "stretch", "left_anti") if n else rows
    order = ["stretch", "txn_id", "currency", "side", "row_id", "cents", "occurred_us", "received_us"]
    found = short.select(*order).repartition("stretch").sortWithinPartitions("stretch").mapInArrow(_sweep(cfg), FOUND)
    money = lambda c: (F.col(c).cast("decimal(20,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(18,2)")
    at = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    facts = [f(f"{s}_{c}").alias(f"{s}_{name}") for s in "gl" for c, name, f in (("row_id", "row_id", F.col), ("cents", "amount", money), ("occurred_us", "occurred_at", at), ("received_us", "received_at", at))]
    found = found.select(
        "txn_id", "currency", *facts, F.abs(F.col("g_occurred_us") - F.col("l_occurred_us")).alias("dt_us"), F.abs(money("g_cents") - money("l_cents")).alias("d_amount"), "rank", matching.layer_name(F.col("rank")).alias("match_layer"),
    )
    if not n:
        return found
    rest = rows.join(long, "stretch", "left_semi").select("txn_id", "currency", "side", "row_id", money("cents").alias("amount"), at("occurred_us").alias("occurred_at"), at("received_us").alias("received_at"))
    return found.unionByName(matching.assign(matching.classified(rest, cfg), "arrived").select(*found.columns))
