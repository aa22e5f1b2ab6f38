"""Queries of the engine over feeds that are made from the orders table.

Each is registered with the SQL that a second engine runs on the same tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, MatchConfig
from ..functions import money, text, times
from ..functions.frames import shared_path, small_tasks, written
from ..functions.order import ensure_checkpoints
from ..operators import flush, groundtruth, matching, messages, metrics, reads, receipts, results, rollup, store, sweepmerge, validate
from ..schemas import SUBMISSION
from ..sources import csvfile, csvsplit, feeds
from ..streaming import backlog as stream_state, closures, ingest, matcher

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
AS_OF = "2001-08-01 20:00:00"


def query(sql: str | None = None, money: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Registers a query and its SQL. Columns named in money leave both engines as doubles."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = (lambda spark, d: f(spark, d).withColumns({c: F.col(c).cast("double") for c in money})) if money else f
        if sql is not None:
            head, _, last = sql.rpartition("--result\n")
            kept = ", ".join(f"{c}::double as {c}" for c in money)
            SQL[f.__name__] = BASE + head + (f"select * replace ({kept}) from ({last})" if money else last)
        return f

    return register


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


#: The feeds, receipts, pairs and results of the engine, said again in SQL.
BASE = f"""
with o as (
  select o_orderkey as k, 'TXN-' || lpad(o_orderkey::varchar, 8, '0') as txn_id, o_totalprice::decimal(18,2) as planned,
         (['INR', 'USD', 'EUR', 'GBP'])[(o_orderkey % 4 + 1)::int] as ccy, o_orderdate + to_seconds(o_orderkey % 86400) as t0
  from orders),
gsub as (
  select 'gateway' as side, k * 2 + copy as row_id, 'gw-' || txn_id as idempotency_key, txn_id, (planned + copy)::decimal(18,2) as amount, ccy as currency,
         t0 as occurred_at, t0 + to_seconds(k % 7 + copy * 5) as received_at
  from o, (values (0), (1)) c(copy) where k % 50 <> 11 and (copy = 0 or k % 33 = 7)),
l0 as (
  select *, t0 + to_microseconds(1000 * case when k % 10 < 6 then (k * 37) % 4001 - 2000 else (k * 7919) % 140001 - 70000 end) as lat from o where k % 20 <> 3),
lsub as (
  select 'ledger' as side, k as row_id, 'ld-' || txn_id as idempotency_key, txn_id,
         case when k % 25 = 4 then (planned * 1.005)::decimal(18,2) when k % 25 = 9 then (planned * 1.02)::decimal(18,2) else planned end as amount,
         case when k % 97 = 13 then 'JPY' else ccy end as currency, lat as occurred_at, lat + to_seconds(k % 11) as received_at
  from l0),
sub as (select * from gsub union all select * from lsub),
rec as (
  select *, count(*) over (partition by side, idempotency_key) as submissions from sub
  qualify row_number() over (partition by side, idempotency_key order by received_at, row_id) = 1),
cand as (
  select g.txn_id, g.currency, g.row_id as g_row_id, l.row_id as l_row_id, g.amount as g_amount, l.amount as l_amount,
         g.occurred_at as g_occurred_at, l.occurred_at as l_occurred_at, g.received_at as g_received_at, l.received_at as l_received_at,
         abs(epoch_us(l.occurred_at) - epoch_us(g.occurred_at)) as dt_us, abs(g.amount - l.amount) as d_amount
  from (select * from rec where side = 'gateway') g join (select * from rec where side = 'ledger') l using (txn_id, currency)
  where abs(epoch_us(l.occurred_at) - epoch_us(g.occurred_at)) <= 60000000),
pairs as (
  select *, case when rank = 0 then 'exact' when rank = 1 then 'time_drift' else 'amount_drift' end as match_layer
  from (select *, case when g_amount = l_amount then case when dt_us <= 2000000 then 0 else 1 end
                       when d_amount <= greatest(abs(g_amount) * 0.01, 10.0) then 2 end as rank from cand)
  where rank is not null),
decided as (
  select *, greatest(g_received_at, l_received_at) + to_microseconds((g_row_id * 7919 + l_row_id * 104729) % 900001) as resolved_at from pairs),
mres as (
  select g_row_id as gateway_id, l_row_id as ledger_id, case when match_layer = 'amount_drift' then 'amount_drift' else 'matched' end as status, match_layer, resolved_at,
         greatest((epoch_us(resolved_at) - epoch_us(greatest(g_received_at, l_received_at))) // 1000, 0) as match_latency_ms,
         case when match_layer = 'time_drift' then 'clock drift ' || (dt_us / 1000000.0)::decimal(20,3)::varchar || 's within 60s window'
              when match_layer = 'amount_drift' then 'amount drift ' || case when g_amount >= l_amount then '+' else '' end || (g_amount - l_amount)::decimal(19,2)::varchar
                || ' (gateway ' || g_amount::varchar || ' vs ledger ' || l_amount::varchar || '), tolerance '
                || case when abs(g_amount) * 0.01 >= 10 then (abs(g_amount) * 0.01)::decimal(22,4)::varchar else '10.0' end end as notes
  from decided),
dres as (
  select case when side = 'gateway' then row_id end as gateway_id, case when side = 'ledger' then row_id end as ledger_id, 'duplicate' as status, 'duplicate' as match_layer,
         received_at as resolved_at, 0::bigint as match_latency_ms, submissions::varchar || ' submissions of idempotency key; first receipt retained' as notes
  from rec where submissions > 1),
pend as (
  select rec.* from rec
  where not exists (select 1 from pairs p where (rec.side = 'gateway' and p.g_row_id = rec.row_id) or (rec.side = 'ledger' and p.l_row_id = rec.row_id))),
stale as (select * from pend where epoch_us('{AS_OF}'::timestamp) - epoch_us(received_at) > 300000000),
bres as (
  select case when side = 'gateway' then row_id end as gateway_id, case when side = 'ledger' then row_id end as ledger_id, 'unmatched_' || side || '_only' as status,
         'unmatched_sweep' as match_layer, '{AS_OF}'::timestamp as resolved_at, (epoch_us('{AS_OF}'::timestamp) - epoch_us(received_at)) // 1000 as match_latency_ms,
         'no counterparty after ' || round_even((epoch_us('{AS_OF}'::timestamp) - epoch_us(received_at)) / 1000000.0, 0)::bigint::varchar || 's' as notes
  from stale),
res as (
  select *, row_number() over (order by resolved_at, status, gateway_id nulls first, ledger_id nulls first) as id
  from (select * from mres union all select * from dres union all select * from bres)),
feed as (
  select r.id, r.status, r.match_layer, r.resolved_at, r.match_latency_ms, r.notes, r.gateway_id, r.ledger_id, coalesce(g.txn_id, l.txn_id) as txn_id, coalesce(g.currency, l.currency) as currency,
         g.amount as gateway_amount, l.amount as ledger_amount, g.occurred_at as gateway_occurred_at, l.occurred_at as ledger_occurred_at,
         trunc((epoch_us(l.occurred_at) - epoch_us(g.occurred_at)) / 1000)::bigint as skew_ms, (l.amount - g.amount)::decimal(19,2) as amount_delta
  from res r left join (select * from rec where side = 'gateway') g on r.gateway_id = g.row_id left join (select * from rec where side = 'ledger') l on r.ledger_id = l.row_id),
exc as (select id, id as result_id, resolved_at as opened_at from res where status in ('amount_drift', 'unmatched_gateway_only', 'unmatched_ledger_only')),
clo as (
  select r.id as exception_id, 'note ' || n as resolution_notes, '{AS_OF}'::timestamp + to_seconds(60 * ((r.id * 7 + n * 3) % 5) + 1) as closed_at, n::bigint as seq
  from res r, (values (1), (2)) v(n) where r.id % 6 = 0 and (n = 1 or r.id % 12 = 0)),
exc2 as (
  select e.*, c.closed_at, c.resolution_notes from exc e
  left join (select * from clo qualify row_number() over (partition by exception_id order by closed_at, seq) = 1) c on c.exception_id = e.id)
"""


def _sub(spark: SparkSession, d: str) -> DataFrame:
    return feeds.submissions(spark, d)


def _submitted(spark: SparkSession, d: str) -> int:
    """About how many submissions there are: one a side; a count reads no column."""
    return 2 * spark.read.parquet(f"{d}/orders.parquet").count()


def _rec(spark: SparkSession, d: str) -> DataFrame:
    return receipts.first_receipts(_sub(spark, d))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return matching.classified(_rec(spark, d))


def _taken(receipts: DataFrame) -> DataFrame:
    """Which rows of receipts are matched, without what they say."""
    return matching.assign(matching.classified(receipts).select(*matching.CHOICE))


def _results(spark: SparkSession, d: str) -> DataFrame:
    """All results at AS_OF with what their rows say, matches decided up to 0.9 s after the later arrival."""
    rec, said = reads.with_sides(written(_rec(spark, d), "receipts")), reads.SIDES
    matches = matching.assign(matching.classified(rec))
    delay = (F.col("g_row_id") * 7919 + F.col("l_row_id") * 104729) % 900001
    waiting = results.stale(results.pending(rec, matches), as_of())
    return results.match_results(matches, DEFAULT, delay, said).unionByName(results.duplicates(rec, said)).unionByName(results.breaks(waiting, as_of(), said))


#: Results tables by session and input: written once, and read by all queries of the read path.
_TABLES: dict[tuple[str, str], str] = {}


def _build(spark: SparkSession, d: str) -> str:
    path = shared_path(spark, "results-table")
    with small_tasks(spark, _submitted(spark, d)):
        store.save(written(_results(spark, d), "results"), path)
    return path


def _table(spark: SparkSession, d: str) -> str:
    key = (spark.sparkContext.applicationId, d)
    if key not in _TABLES:
        _TABLES[key] = _build(spark, d)
    return _TABLES[key]


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """The results table: results with numbers and what both sides say."""
    return store.load(spark, _table(spark, d))


def _closures(numbered: DataFrame) -> DataFrame:
    n = F.explode(F.when(F.col("id") % 12 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    asked = numbered.filter("id % 6 = 0").select(F.col("id").alias("exception_id"), n.alias("seq"))
    return asked.select("exception_id", F.concat(F.lit("note "), F.col("seq").cast("string")).alias("resolution_notes"), times.add_us(as_of(), (60 * ((F.col("exception_id") * 7 + F.col("seq") * 3) % 5) + 1) * 1_000_000).alias("closed_at"), F.col("seq").cast("long").alias("seq"))


def _exceptions(numbered: DataFrame) -> DataFrame:
    return results.closed(results.exceptions(numbered), _closures(numbered))


# --- pairs and layers ---------------------------------------------------------------------


@query("""select status, match_layer, count(*) as n, sum(gateway_amount)::decimal(38,2) as gateway_amount from feed group by 1, 2""", money=("gateway_amount",))
def recon_summary(spark: SparkSession, d: str) -> DataFrame:
    """Counts and sums by status and layer: the whole engine end to end."""
    rows = reads.shown(_results(spark, d))
    return rows.groupBy("status", "match_layer").agg(F.count("*").alias("n"), F.sum("gateway_amount").cast("decimal(38,2)").alias("gateway_amount"))


@query("select txn_id, currency, g_row_id, l_row_id, dt_us, d_amount from cand", money=("d_amount",))
def pair_candidates(spark: SparkSession, d: str) -> DataFrame:
    return matching.candidates(_rec(spark, d)).select("txn_id", "currency", "g_row_id", "l_row_id", "dt_us", F.col("d_amount").cast("decimal(19,2)").alias("d_amount"))


@query("select g_row_id, l_row_id, match_layer from pairs")
def classify_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("g_row_id", "l_row_id", "match_layer")


def _layer(name: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _pairs(spark, d).filter(F.col("match_layer") == name).select("txn_id", "currency", "g_row_id", "l_row_id", "g_amount", "l_amount", "dt_us")

    n = matching.LAYER_OF_RANK.index(name) + 1
    run.__name__ = f"layer{n}_{name}"
    query(f"select txn_id, currency, g_row_id, l_row_id, g_amount, l_amount, dt_us from pairs where match_layer = '{name}'", money=("g_amount", "l_amount"))(run)


for _name in matching.LAYER_OF_RANK:
    _layer(_name)


def _unmatched(side: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rec = _rec(spark, d)
        waiting = results.stale(results.pending(rec, matching.classified(rec)), as_of())
        return results.breaks(waiting.filter(F.col("side") == side), as_of()).select(f"{side}_id", "status", "match_latency_ms", "notes")

    run.__name__ = f"unmatched_{side}_only"
    query(f"select {side}_id, status, match_latency_ms, notes from bres where {side}_id is not null")(run)


for _name in ("gateway", "ledger"):
    _unmatched(_name)

# --- receipts -----------------------------------------------------------------------------


@query("select side, row_id, idempotency_key, txn_id, amount, currency, occurred_at, received_at, submissions from rec", money=("amount",))
def first_receipts(spark: SparkSession, d: str) -> DataFrame:
    return _rec(spark, d)


@query("select side, idempotency_key, count(*) - 1 as duplicate_count from sub group by 1, 2")
def duplicate_counts(spark: SparkSession, d: str) -> DataFrame:
    return receipts.duplicate_counts(_sub(spark, d))


@query("select gateway_id, ledger_id, status, match_layer, notes from dres")
def duplicate_markers(spark: SparkSession, d: str) -> DataFrame:
    return receipts.duplicate_markers(_rec(spark, d))


@query("""select side, idempotency_key, received_at, row_id, txn_id, first_value(row_id) over w as kept_row_id, row_number() over w > 1 as duplicate, row_number() over w as submissions
from sub window w as (partition by side, idempotency_key order by received_at, row_id)""")
def submission_acks(spark: SparkSession, d: str) -> DataFrame:
    return receipts.acks(_sub(spark, d))


_BATCH_SQL = """, entries as (
  select (row_id // 700)::bigint as batch_id, (row_id % 700)::bigint as position, side, case when row_id % 700 % 90 = 5 then 'ld-again-' || (row_id // 1400)::varchar else idempotency_key end as idempotency_key, txn_id, row_id from rec where side = 'ledger'),
acked as (
  select batch_id, position, idempotency_key, first_value(row_id) over (partition by idempotency_key order by batch_id, position) as row_id, txn_id,
         count(*) over (partition by idempotency_key, batch_id) > 1 or min(batch_id) over (partition by idempotency_key) < batch_id as duplicate,
         count(*) over (partition by idempotency_key order by batch_id range between unbounded preceding and current row) as submissions
  from entries)
"""


def _entries(spark: SparkSession, d: str) -> DataFrame:
    rec = _rec(spark, d).filter("side = 'ledger'")
    k = F.col("row_id")
    key = F.when(k % 700 % 90 == 5, F.concat(F.lit("ld-again-"), F.floor(k / 1400).cast("string"))).otherwise(F.col("idempotency_key"))
    return rec.select(F.floor(k / 700).cast("long").alias("batch_id"), (k % 700).alias("position"), "side", key.alias("idempotency_key"), "txn_id", "row_id")


@query(_BATCH_SQL + "select * from acked")
def batch_ack(spark: SparkSession, d: str) -> DataFrame:
    return receipts.batch_acks(_entries(spark, d))


@query(_BATCH_SQL + "select batch_id, count(*) filter (where not duplicate) as accepted, count(*) filter (where duplicate) as duplicates from acked group by 1")
def batch_ack_totals(spark: SparkSession, d: str) -> DataFrame:
    return receipts.batch_ack_totals(receipts.batch_acks(_entries(spark, d)))


@query("select txn_id, currency || '-' || ((row_number() over (partition by currency order by received_at, row_id) - 1) // 1000)::varchar as batch_id, (row_number() over (partition by currency order by received_at, row_id) - 1) % 1000 as position from rec where side = 'ledger'")
def ledger_batches(spark: SparkSession, d: str) -> DataFrame:
    rows = receipts.batches(_rec(spark, d).filter("side = 'ledger'"), 1_000, ["received_at", "row_id"], "currency")
    return rows.select("txn_id", "batch_id", F.col("position").cast("long").alias("position"))


_WAIT_US = 2 * 86_400 * 1_000_000
_FLUSH_SQL = f""", listed as (
  select currency, list(epoch_us(received_at) order by received_at, row_id) as ts, list(txn_id order by received_at, row_id) as txns from lsub group by 1),
steps as (
  select currency, ts, txns, 1::bigint as i, ts[1] + {_WAIT_US} as deadline, 0::bigint as kept, 0::bigint as sent, null::varchar as txn_id, null::bigint as batch, null::bigint as position from listed
  union all
  select currency, ts, txns, i + 1, case when kept + 1 >= 5 or ts[i] >= deadline then ts[i] + {_WAIT_US} else deadline end, case when kept + 1 >= 5 or ts[i] >= deadline then 0 else kept + 1 end,
         case when kept + 1 >= 5 or ts[i] >= deadline then sent + 1 else sent end, txns[i], sent, kept
  from (select currency, ts, txns, i, case when kept > 0 and deadline <= ts[i] then deadline + {_WAIT_US} else deadline end as deadline, case when kept > 0 and deadline <= ts[i] then 0 else kept end as kept,
               case when kept > 0 and deadline <= ts[i] then sent + 1 else sent end as sent
        from steps where i <= len(ts)))
--result
select currency, txn_id, batch, position from steps where txn_id is not null"""


def flushed_batches(spark: SparkSession, d: str) -> DataFrame:
    """Ledger rows of each currency as a sender batches them: five at most, two days at most."""
    rows = flush.timed_batches(_sub(spark, d).filter("side = 'ledger'"), 5, _WAIT_US, ["received_at", "row_id"], "currency")
    return rows.select("currency", "txn_id", "batch", "position")


QUERIES["flushed_batches"] = flushed_batches
SQL["flushed_batches"] = BASE.replace("with o as", "with recursive o as", 1) + _FLUSH_SQL.replace("--result\n", "")


# --- scalars and notes --------------------------------------------------------------------


@query("select row_id, greatest(abs(amount) * 0.01, 10.0)::decimal(22,4) as tolerance from rec where side = 'gateway'", money=("tolerance",))
def tolerance(spark: SparkSession, d: str) -> DataFrame:
    return _rec(spark, d).filter("side = 'gateway'").select("row_id", money.tolerance(F.col("amount")).cast("decimal(22,4)").alias("tolerance"))


@query("select g_row_id, l_row_id, abs(epoch_us(l_occurred_at) - epoch_us(g_occurred_at)) as delta_us from cand")
def time_delta(spark: SparkSession, d: str) -> DataFrame:
    return matching.candidates(_rec(spark, d)).select("g_row_id", "l_row_id", times.time_delta_us(F.col("g_occurred_at"), F.col("l_occurred_at")).alias("delta_us"))


@query("select gateway_id, ledger_id, match_latency_ms from mres")
def match_latency(spark: SparkSession, d: str) -> DataFrame:
    return _stored(spark, d).filter("status in ('matched', 'amount_drift')").select("gateway_id", "ledger_id", "match_latency_ms")


@query("select gateway_id, ledger_id, notes from res")
def result_notes(spark: SparkSession, d: str) -> DataFrame:
    return _stored(spark, d).select("gateway_id", "ledger_id", "notes")


@query("select gateway_id, ledger_id, skew_ms, amount_delta from feed", money=("amount_delta",))
def skew_and_delta(spark: SparkSession, d: str) -> DataFrame:
    return _stored(spark, d).select("gateway_id", "ledger_id", "skew_ms", "amount_delta")


# --- contested assignment -----------------------------------------------------------------

_CONTESTED = """, cb as (
  select o_orderkey as k, 'GRP-' || (o_orderkey // 4)::varchar as txn_id, (['INR', 'USD', 'EUR', 'GBP'])[(o_orderkey // 4 % 4 + 1)::int] as currency,
         (1000 + 5 * (o_orderkey % 3))::decimal(18,2) as amount, timestamp '2024-01-01' + to_seconds(o_orderkey // 4 * 600 + o_orderkey % 4 * 11) as t0 from orders),
cg as (select k as row_id, txn_id, currency, amount, t0 as occurred_at, t0 + to_seconds(k % 7) as received_at from cb where k % 9 <> 2),
cl as (select k as row_id, txn_id, currency, (amount + 5 * (k % 2))::decimal(18,2) as amount, t0 + to_seconds(k * 3 % 5) as occurred_at, t0 + to_seconds(k % 5 + 1) as received_at from cb where k % 11 <> 5),
cp0 as (
  select g.txn_id, g.currency, g.row_id as g, l.row_id as l, g.received_at as gr, l.received_at as lr, g.amount as ga, l.amount as la,
         abs(epoch_us(l.occurred_at) - epoch_us(g.occurred_at)) as dt, abs(g.amount - l.amount) as da from cg g join cl l using (txn_id, currency)),
cp as (
  select * from (select *, case when ga = la then case when dt <= 2000000 then 0 else 1 end when da <= greatest(ga * 0.01, 10.0) then 2 end as rank from cp0 where dt <= 60000000)
  where rank is not null)
"""
_FOLD = """, ce as (
  select *, row_number() over (partition by txn_id, currency order by turn_at, turn_side, turn_id, rank, dt, da, other) as n from ({edges})),
walk as (
  select txn_id, currency, 0::bigint as n, []::bigint[] as gs, []::bigint[] as ls from (select distinct txn_id, currency from ce)
  union all
  select w.txn_id, w.currency, e.n, case when hit then list_append(w.gs, e.g) else w.gs end, case when hit then list_append(w.ls, e.l) else w.ls end
  from (select w.*, e.g, e.l, e.n as en, not list_contains(w.gs, e.g) and not list_contains(w.ls, e.l) as hit from walk w join ce e on e.txn_id = w.txn_id and e.currency = w.currency and e.n = w.n + 1) w,
       lateral (select w.g as g, w.l as l, w.en as n) e),
last as (select * from walk qualify row_number() over (partition by txn_id, currency order by n desc) = 1)
select txn_id, currency, unnest(gs) as g_row_id, unnest(ls) as l_row_id from last
"""
_ARRIVED = """select txn_id, currency, g, l, rank, dt, da, case when (gr, 0, g) > (lr, 1, l) then gr else lr end as turn_at, case when (gr, 0, g) > (lr, 1, l) then 0 else 1 end as turn_side,
case when (gr, 0, g) > (lr, 1, l) then g else l end as turn_id, case when (gr, 0, g) > (lr, 1, l) then l else g end as other from cp"""
_ALL = """select txn_id, currency, g, l, rank, dt, da, gr as turn_at, 0 as turn_side, g as turn_id, l as other from cp
union all select txn_id, currency, g, l, rank, dt, da, lr, 1, l, g from cp"""


def _contested_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = feeds.contested(feeds.spread(spark.read.parquet(f"{d}/orders.parquet")))
    return matching.classified(rows.withColumn("submissions", F.lit(1)))


@query(_CONTESTED + """select g as row_id, l as partner_id, case rank when 0 then 'exact' when 1 then 'time_drift' else 'amount_drift' end as match_layer
from cp qualify row_number() over (partition by g order by rank, dt, da, l) = 1""")
def best_counterparty(spark: SparkSession, d: str) -> DataFrame:
    return matching.best_counterparty(_contested_pairs(spark, d), "gateway")


def assign_contested(spark: SparkSession, d: str) -> DataFrame:
    return matching.assign(_contested_pairs(spark, d).select(*matching.CHOICE), "arrived").select("txn_id", "currency", "g_row_id", "l_row_id")


def assign_contested_all(spark: SparkSession, d: str) -> DataFrame:
    return matching.assign(_contested_pairs(spark, d).select(*matching.CHOICE), "all").select("txn_id", "currency", "g_row_id", "l_row_id")


for _f, _edges_sql in ((assign_contested, _ARRIVED), (assign_contested_all, _ALL)):
    QUERIES[_f.__name__] = _f
    SQL[_f.__name__] = BASE.replace("with o as", "with recursive o as", 1) + _CONTESTED + _FOLD.format(edges=_edges_sql)


def assign_swept(spark: SparkSession, d: str) -> DataFrame:
    """The contested feed, assigned by a sweep without pairs."""
    return sweepmerge.assign(feeds.contested(spark.read.parquet(f"{d}/orders.parquet"))).select("txn_id", "currency", "g_row_id", "l_row_id")


def assign_hot(spark: SparkSession, d: str) -> DataFrame:
    """The same where one transaction holds half of all rows: every other group of the feed."""
    rows = feeds.contested(spark.read.parquet(f"{d}/orders.parquet"))
    hot = F.floor(F.col("row_id") / 4) % 2 == 0
    one = rows.withColumns({"txn_id": F.when(hot, "GRP-hot").otherwise(F.col("txn_id")), "currency": F.when(hot, "INR").otherwise(F.col("currency"))})
    return sweepmerge.assign(one).select("txn_id", "currency", "g_row_id", "l_row_id")


QUERIES |= {"assign_swept": assign_swept, "assign_hot": assign_hot}
SQL["assign_swept"] = SQL["assign_contested"]
# the groups lie ten minutes apart, so no pair reaches from one to the next
SQL["assign_hot"] = SQL["assign_contested"].replace("select txn_id, currency, unnest(gs) as g_row_id, unnest(ls) as l_row_id from last", """select case when q % 2 = 0 then 'GRP-hot' else txn_id end as txn_id, case when q % 2 = 0 then 'INR' else currency end as currency, g_row_id, l_row_id
from (select txn_id, currency, replace(txn_id, 'GRP-', '')::bigint as q, unnest(gs) as g_row_id, unnest(ls) as l_row_id from last)""")


@query("""select side, n_results, count(*) as n_rows from (
  select 'gateway' as side, gateway_id, count(*) as n_results from res where status <> 'duplicate' and gateway_id is not null group by all
  union all select 'ledger', ledger_id, count(*) from res where status <> 'duplicate' and ledger_id is not null group by all) group by 1, 2""")
def active_results_per_row(spark: SparkSession, d: str) -> DataFrame:
    """How many rows have how many results that are not duplicate markers: one each."""
    active = _stored(spark, d).filter("status <> 'duplicate'")
    per = lambda s: active.filter(F.col(f"{s}_id").isNotNull()).groupBy(f"{s}_id").agg(F.count("*").alias("n_results")).groupBy("n_results").agg(F.count("*").alias("n_rows")).select(F.lit(s).alias("side"), "n_results", "n_rows")
    return per("gateway").unionByName(per("ledger"))


@query("select 'gateway' as side, g_row_id as row_id, count(*) as count from pairs group by 1, 2 having count(*) > 1")
def one_active_result_per_row(spark: SparkSession, d: str) -> DataFrame:
    found = lambda pairs: written(matching.assign(pairs.select(*matching.CHOICE)).select("g_row_id", "l_row_id"), "matches")
    return matching.crowded(found(_contested_pairs(spark, d))).unionByName(matching.crowded(found(_pairs(spark, d))))


# --- sweep, exceptions, closures ----------------------------------------------------------


@query("select side, row_id, received_at from stale")
def stale_pending(spark: SparkSession, d: str) -> DataFrame:
    rec = _rec(spark, d)
    return results.stale(results.pending(rec, _taken(rec)), as_of()).select("side", "row_id", "received_at")


@query("select gateway_id, ledger_id, status, match_layer, resolved_at, match_latency_ms, notes from bres")
def sweep_results(spark: SparkSession, d: str) -> DataFrame:
    rec = _rec(spark, d)
    return results.sweep(rec, _taken(rec), as_of())


@query("select gateway_id, ledger_id, status, match_layer, resolved_at, match_latency_ms, notes from bres")
def sweep_drain(spark: SparkSession, d: str) -> DataFrame:
    """Bounded passes over the oldest stale rows until none is left: what one pass settles."""
    rec = _rec(spark, d)
    found, drained = results.drain(rec, _taken(rec), as_of(), batch=1_000, max_passes=None)
    assert drained
    return found


_REMATCH_SQL = f"""select gateway_id, ledger_id, status, mres.match_layer, '{AS_OF}'::timestamp as resolved_at, greatest((epoch_us('{AS_OF}'::timestamp) - epoch_us(greatest(g_received_at, l_received_at))) // 1000, 0) as match_latency_ms, notes
from mres join pairs on g_row_id = gateway_id and l_row_id = ledger_id
where gateway_id % 19 = 4 and epoch_us('{AS_OF}'::timestamp) - epoch_us(least(g_received_at, l_received_at)) > 300000000
union all select gateway_id, ledger_id, status, match_layer, resolved_at, match_latency_ms, notes from bres"""


def _some_unmet(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Receipts, and their matches less those of rows whose message never came: pairs that only a sweep finds."""
    rec = written(_rec(spark, d), "receipts")
    return rec, written(_taken(rec).filter("g_row_id % 19 <> 4"), "matches")


@query(_REMATCH_SQL)
def sweep_rematches(spark: SparkSession, d: str) -> DataFrame:
    """A sweep over pending pairs and lone rows: it matches before it gives up."""
    return results.sweep(*_some_unmet(spark, d), as_of())


@query(_REMATCH_SQL)
def sweep_drain_rematches(spark: SparkSession, d: str) -> DataFrame:
    """The same by bounded passes."""
    found, drained = results.drain(*_some_unmet(spark, d), as_of(), batch=2_000, max_passes=None)
    assert drained
    return found


@query("""select 'gateway' as side, g_row_id as row_id, 2::bigint as count from pairs where g_row_id % 20 = 4 union all select 'ledger', l_row_id, 2 from pairs where l_row_id % 30 = 7""")
def planted_double_results(spark: SparkSession, d: str) -> DataFrame:
    """Rows with more than one match, where second ones were planted."""
    found = written(matching.assign(_pairs(spark, d).select(*matching.CHOICE)).select("g_row_id", "l_row_id"), "matches")
    far = 1 << 40
    planted = found.filter("g_row_id % 20 = 4").select("g_row_id", (F.col("l_row_id") + far).alias("l_row_id"))
    planted = planted.unionByName(found.filter("l_row_id % 30 = 7").select((F.col("g_row_id") + far).alias("g_row_id"), "l_row_id"))
    return matching.crowded(found.unionByName(planted))


@query("select side, row_id, received_at from stale where side = 'gateway' order by received_at, row_id limit 500")
def sweep_batch(spark: SparkSession, d: str) -> DataFrame:
    """The oldest 500 stale gateway rows: one bounded batch of the sweep."""
    return results.oldest(stale_pending(spark, d).filter("side = 'gateway'"), 500)


@query("select id, result_id, opened_at from exc")
def open_exceptions(spark: SparkSession, d: str) -> DataFrame:
    return results.exceptions(_stored(spark, d))


@query("select id, result_id, opened_at, closed_at, resolution_notes from exc2")
def resolve_exceptions(spark: SparkSession, d: str) -> DataFrame:
    return _exceptions(_stored(spark, d))


@query("""select c.exception_id, c.seq, case when e.id is null then 'not_found' when row_number() over (partition by exception_id order by c.closed_at, c.seq) = 1 then 'closed' else 'conflict' end as outcome
from clo c left join exc e on e.id = c.exception_id""")
def closure_outcomes(spark: SparkSession, d: str) -> DataFrame:
    numbered = _stored(spark, d)
    return results.closure_outcomes(results.exceptions(numbered), _closures(numbered))


def stream_closures(spark: SparkSession, d: str) -> DataFrame:
    """The same requests as a stream: of every third exception they come before the exception itself."""
    ensure_checkpoints(spark)
    at = shared_path(spark, "closures")
    numbered = _stored(spark, d)
    opened, asked = results.exceptions(numbered).select("id", "opened_at"), _closures(numbered).select("exception_id", "seq", "closed_at", "resolution_notes")
    # in the end the clock moves past all requests
    tick = spark.range(1).select(F.lit(None).cast("long").alias("exception_id"), F.lit(None).cast("long").alias("seq"), times.add_us(as_of(), F.lit(86_400_000_000)).alias("closed_at"), F.lit(None).cast("string").alias("resolution_notes"))
    arrivals = (
        (opened.filter("id % 3 <> 0"), asked.filter("exception_id % 3 = 0 and seq = 2")), (opened.filter("id % 3 = 0"), asked.filter("not (exception_id % 3 = 0 and seq = 2)")), (opened.limit(0), tick))
    for exceptions, requests in arrivals:
        exceptions.write.mode("append").parquet(f"{at}/opened")
        requests.write.mode("append").parquet(f"{at}/requests")
        found = closures.run_available(spark, f"{at}/opened", f"{at}/requests", f"{at}/out", f"{at}/checkpoints")
    return found.select("exception_id", "seq", "outcome")


QUERIES["stream_closures"] = stream_closures
SQL["stream_closures"] = SQL["closure_outcomes"]


# --- read path ----------------------------------------------------------------------------


@query("select * from feed", money=("gateway_amount", "ledger_amount", "amount_delta"))
def results_table(spark: SparkSession, d: str) -> DataFrame:
    """The results table, decided and written anew; later queries of the session read it."""
    path = _TABLES[spark.sparkContext.applicationId, d] = _build(spark, d)
    return store.load(spark, path)


@query("select * from feed", money=("gateway_amount", "ledger_amount", "amount_delta"))
def result_feed(spark: SparkSession, d: str) -> DataFrame:
    return _stored(spark, d)


@query("select gateway_id, ledger_id, status, notes from feed")
def replayed_results(spark: SparkSession, d: str) -> DataFrame:
    """Two batches of results, the second with all of the first in it: each result stands once."""
    path = shared_path(spark, "replayed-table")
    found = written(_results(spark, d), "results")
    store.save(found.filter("coalesce(gateway_id, ledger_id) % 3 = 1"), path)
    store.add(spark, path, found)
    store.add(spark, path, found)
    return store.load(spark, path).select("gateway_id", "ledger_id", "status", "notes")


@query("select id, status, txn_id from feed where id < (select max(id) - 120 from feed) order by id desc limit 51")
def feed_page(spark: SparkSession, d: str) -> DataFrame:
    """One page of 50 below a cursor, and the row that says there is another."""
    top = _stored(spark, d).agg(F.max("id") - 120).first()[0]
    return store.page(spark, _table(spark, d), 50, top).select("id", "status", "txn_id")


@query("select id, (row_number() over (order by id desc) - 1) // 50 as page from res")
def feed_pages(spark: SparkSession, d: str) -> DataFrame:
    return reads.page_numbers(_stored(spark, d).select("id"), 50).select("id", "page")


@query("select id, txn_id, gateway_amount, ledger_amount from feed where status = 'amount_drift' order by id desc limit 101", money=("gateway_amount", "ledger_amount"))
def status_filter(spark: SparkSession, d: str) -> DataFrame:
    return store.page(spark, _table(spark, d), 100, status="amount_drift").select("id", "txn_id", "gateway_amount", "ledger_amount")


@query("""select e.id, e.result_id, e.opened_at, e.closed_at, e.resolution_notes, f.status, f.txn_id, f.currency, f.gateway_amount, f.ledger_amount, f.skew_ms, f.amount_delta
from exc2 e join feed f on f.id = e.result_id where e.closed_at is null""", money=("gateway_amount", "ledger_amount", "amount_delta"))
def exception_feed(spark: SparkSession, d: str) -> DataFrame:
    numbered = _stored(spark, d)
    rows = reads.exception_feed(_exceptions(numbered), numbered, open_only=True)
    return rows.select("id", "result_id", "opened_at", "closed_at", "resolution_notes", "status", "txn_id", "currency", "gateway_amount", "ledger_amount", "skew_ms", "amount_delta")


@query("select e.id, f.status, f.txn_id, e.closed_at from exc2 e join feed f on f.id = e.result_id where e.id = (select min(id) from exc)")
def exception_lookup(spark: SparkSession, d: str) -> DataFrame:
    numbered = _stored(spark, d)
    least = results.exceptions(numbered).agg(F.min("id").alias("id"))
    return reads.exception_feed(_exceptions(numbered), numbered).join(F.broadcast(least), "id").select("id", "status", "txn_id", "closed_at")


def _stats(window: str, seconds: int) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        numbered = _stored(spark, d)
        return reads.stats(numbered, _exceptions(numbered), window, as_of())

    run.__name__ = f"stats_{window}"
    query(f"""select '{window}' as window, {seconds}::bigint as window_seconds, matched, matched_via_time_drift, unmatched_gateway_only, unmatched_ledger_only, duplicates, drift, latency_p50, latency_p95, latency_p99,
  open_exceptions, unmatched_gateway_only + unmatched_ledger_only as unmatched, matched + unmatched_gateway_only + unmatched_ledger_only + drift as total,
  case when matched + unmatched_gateway_only + unmatched_ledger_only + drift > 0 then matched / (matched + unmatched_gateway_only + unmatched_ledger_only + drift)::double else 0.0::double end as match_rate,
  (matched + unmatched_gateway_only + unmatched_ledger_only + drift) / {seconds}.0::double as throughput_tx_per_sec
from (select count(*) filter (where status = 'matched') as matched, count(*) filter (where match_layer = 'time_drift') as matched_via_time_drift,
  count(*) filter (where status = 'unmatched_gateway_only') as unmatched_gateway_only, count(*) filter (where status = 'unmatched_ledger_only') as unmatched_ledger_only,
  count(*) filter (where status = 'duplicate') as duplicates, count(*) filter (where status in ('amount_drift', 'time_drift')) as drift,
  quantile_cont(match_latency_ms::double, 0.5) filter (where status <> 'duplicate') as latency_p50, quantile_cont(match_latency_ms::double, 0.95) filter (where status <> 'duplicate') as latency_p95,
  quantile_cont(match_latency_ms::double, 0.99) filter (where status <> 'duplicate') as latency_p99
  from res where epoch_us('{AS_OF}'::timestamp) - epoch_us(resolved_at) <= {seconds}000000),
 (select count(*) filter (where closed_at is null) as open_exceptions from exc2)""")(run)


for _w, _s in (("1h", 3_600), ("24h", 86_400), ("7d", 604_800)):
    _stats(_w, _s)


def stats_rolled(spark: SparkSession, d: str) -> DataFrame:
    """The three windows from counts a minute, kept as two batches of results came in."""
    path = shared_path(spark, "minutes")
    numbered = _stored(spark, d)
    for batch in (numbered.filter("coalesce(gateway_id, ledger_id) % 3 = 1"), numbered.filter("coalesce(gateway_id, ledger_id) % 3 <> 1")):
        rollup.keep(batch, path)
    kept, exceptions = rollup.load(spark, path), _exceptions(numbered)
    one, *others = (rollup.stats(kept, numbered, exceptions, w, as_of()) for w in ("1h", "24h", "7d"))
    for rows in others:
        one = one.unionByName(rows)
    return one


QUERIES["stats_rolled"] = stats_rolled
SQL["stats_rolled"] = BASE + " union all ".join(f"select * from ({SQL[f'stats_{w}'][len(BASE):]})" for w in ("1h", "24h", "7d"))


@query("""select rank, coalesce(n, 0) as count, (sum(coalesce(n, 0)) over (order by rank desc))::bigint as carried_in, coalesce(n, 0) / (sum(coalesce(n, 0)) over ())::double as share
from (values (1, 'exact'), (2, 'time_drift'), (3, 'amount_drift'), (4, 'duplicate'), (5, 'unmatched_sweep')) v(rank, match_layer) left join (select match_layer, count(*) as n from res group by 1) using (match_layer)""")
def layer_cascade(spark: SparkSession, d: str) -> DataFrame:
    return reads.layer_cascade(_stored(spark, d))


@query("""select id, case when status = 'amount_drift' then sym || printf('%,.2f', gateway_amount::double) || ' ≠ ' || sym || printf('%,.2f', ledger_amount::double)
  when status = 'duplicate' then 'Repeat submission' when status = 'unmatched_gateway_only' then 'No ledger entry' when status = 'unmatched_ledger_only' then 'No gateway entry'
  else case when skew_ms >= 0 then '+' else '-' end || case when abs(skew_ms) < 1000 then abs(skew_ms)::varchar || 'ms' 
    when abs(skew_ms) < 60000 then case when abs(skew_ms) % 1000 in (125, 375, 625, 875) then ((abs(skew_ms) + 5) // 10 / 100.0)::decimal(20,2)::varchar else printf('%.2f', abs(skew_ms) / 1000.0::double) end || 's'
    else printf('%.1f', abs(skew_ms) / 60000.0::double) || 'm' end end as label
from (select *, case currency when 'INR' then '₹' when 'USD' then '$' when 'EUR' then '€' when 'GBP' then '£' else '¥' end as sym from feed)""")
def difference_label(spark: SparkSession, d: str) -> DataFrame:
    return _stored(spark, d).select("id", text.difference_label(F.col("status"), F.col("gateway_amount"), F.col("ledger_amount"), F.col("currency"), F.col("skew_ms")).alias("label"))


# --- metrics ------------------------------------------------------------------------------


@query("""select le, (select count(*) from mres where match_latency_ms / 1000.0 <= coalesce(le, 1e18)) as count
from (select unnest([0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 300.0]::double[]) as le union all select null)""")
def latency_histogram(spark: SparkSession, d: str) -> DataFrame:
    rows = _stored(spark, d).filter("status in ('matched', 'amount_drift')")
    return metrics.histogram(rows, F.col("match_latency_ms") / 1000)


@query("""select pct, (select match_latency_ms from (select match_latency_ms, row_number() over (order by match_latency_ms) - 1 as i from mres) where i = (select round_even(pct / 100.0 * (count(*) - 1), 0)::bigint from mres)) as value
from (values (50), (95), (99)) v(pct)""")
def nearest_rank_percentile(spark: SparkSession, d: str) -> DataFrame:
    rows = _stored(spark, d).filter("status in ('matched', 'amount_drift')")
    return metrics.nearest_rank(rows, "match_latency_ms")


@query("select (select count(*) from rec) as received, (select count(*) from pend) as pending, (select count(*) from stale) as overdue")
def backlog(spark: SparkSession, d: str) -> DataFrame:
    rec = _rec(spark, d)
    return metrics.backlog(rec, results.pending(rec, _taken(rec)), as_of(), DEFAULT.unmatched_after_s)


@query("select status, match_layer, count(*) as n, avg(match_latency_ms) as mean_latency_ms from res group by 1, 2")
def status_totals(spark: SparkSession, d: str) -> DataFrame:
    return metrics.status_totals(_stored(spark, d))


# --- messages -----------------------------------------------------------------------------


@query("select side as source, row_id, txn_id, submissions > 1 as is_duplicate, submissions::int as submissions from rec")
def message_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return messages.encode(_rec(spark, d)).select(messages.decode(F.col("message")).alias("m")).select("m.*")


@query("select side, row_id, idempotency_key from rec")
def message_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows that messages point to: all receipts, beside messages that point to no row."""
    rec = _rec(spark, d)
    asked = messages.encode(rec.unionByName(rec.withColumn("row_id", -1 - F.col("row_id"))))
    return messages.load(asked, rec).select("side", "row_id", "idempotency_key")


# --- validation ---------------------------------------------------------------------------

_RAW_SQL = """, raw as (
  select o_orderkey as k, case when o_orderkey % 41 = 0 then '  ' else 'key-' || o_orderkey end as idempotency_key,
    case when o_orderkey % 37 = 0 then '' else 'TXN-' || o_orderkey end as txn_id,
    (['100.00', '-3.40', '0.00', '100.005', 'abc', '12', '99999999999999999.00', '7.5'])[(o_orderkey % 8 + 1)::int] as amount,
    (['INR', 'usd', 'EUR', 'EURO', 'GBP'])[(o_orderkey % 5 + 1)::int] as currency,
    (['2026-03-14T09:30:00Z', '2026-03-14T15:00:00+05:30', '2026-03-14T09:30:00', '2026-13-14T09:30:00Z', '2026-03-14T09:30:00.250Z', '03/04/2026', '2026-03-14 09:30:00+00:00'])[(o_orderkey % 7 + 1)::int] as occurred_at,
    o_orderkey % 53 = 0 as extra from orders),
checked as (
  select *, case when extra then 'unknown field' when trim(idempotency_key) = '' then 'idempotency_key missing' when txn_id = '' then 'txn_id length'
    when not regexp_full_match(amount, '[+-]?0*\\d{1,16}(\\.\\d{1,2})?') then 'amount format' when amount::decimal(18,2) = 0 then 'amount zero'
    when not regexp_full_match(currency, '[A-Z]{3}') then 'currency format' when not regexp_full_match(occurred_at, '\\d{4}-\\d{2}-\\d{2}[T ]\\d{2}:\\d{2}(:\\d{2}(\\.\\d+)?)?(Z|[+-]\\d{2}:?\\d{2})') then 'occurred_at zone'
    when try_cast(occurred_at as timestamptz) is null then 'occurred_at value' end as reject_reason from raw)
"""


def _raw(spark: SparkSession, d: str) -> DataFrame:
    """Webhook bodies as JSON text, with faults dealt out by the order key."""
    k = F.col("o_orderkey")
    pick = lambda values: feeds.pick(values, F.pmod(k, F.lit(len(values))))
    body = F.struct(
        F.when(k % 37 == 0, "").otherwise(F.concat(F.lit("TXN-"), k.cast("string"))).alias("txn_id"), pick(["100.00", "-3.40", "0.00", "100.005", "abc", "12", "99999999999999999.00", "7.5"]).alias("amount"), pick(["INR", "usd", "EUR", "EURO", "GBP"]).alias("currency"),
        pick(["2026-03-14T09:30:00Z", "2026-03-14T15:00:00+05:30", "2026-03-14T09:30:00", "2026-13-14T09:30:00Z", "2026-03-14T09:30:00.250Z", "03/04/2026", "2026-03-14 09:30:00+00:00"]).alias("occurred_at"),
        F.concat(F.lit("REF-"), k.cast("string")).alias("gateway_ref"), F.when(k % 53 == 0, "x").alias("surprise"),
    )
    key = F.when(k % 41 == 0, "  ").otherwise(F.concat(F.lit("key-"), k.cast("string")))
    return spark.read.parquet(f"{d}/orders.parquet").select(k.alias("k"), key.alias("idempotency_key"), F.to_json(body).alias("payload"))


@query(_RAW_SQL + "--result\nselect k, txn_id, amount::decimal(18,2) as amount, currency, (epoch_us(occurred_at::timestamptz)) as occurred_us from checked where reject_reason is null", money=("amount",))
def validated_submissions(spark: SparkSession, d: str) -> DataFrame:
    rows = validate.validated(_raw(spark, d), "gateway").filter("reject_reason is null")
    return rows.select("k", "txn_id", F.col("amount_value").alias("amount"), "currency", F.unix_micros("occurred_value").alias("occurred_us"))


@query(_RAW_SQL + "select k, reject_reason from checked where reject_reason is not null")
def rejected_submissions(spark: SparkSession, d: str) -> DataFrame:
    return validate.validated(_raw(spark, d), "gateway").filter("reject_reason is not null").select("k", "reject_reason")


@query(_RAW_SQL + "select (k // 1200)::bigint as batch_id, count(*) as entries, count(reject_reason) as invalid, count(*) <= 1000 and count(reject_reason) = 0 as accepted from checked group by 1")
def batch_verdicts(spark: SparkSession, d: str) -> DataFrame:
    rows = validate.validated(_raw(spark, d), "gateway").withColumn("batch_id", F.floor(F.col("k") / 1200).cast("long"))
    return validate.batch_verdicts(rows)


_INTAKE_SQL = _RAW_SQL + """, asked as (
  select *, case when k % 10 = 7 then 'many-' || (k // 20000) when k % 3 = 0 then 'one-' || k else 'two-' || (k // 2) end as request_id from checked),
told as (select request_id, count(*) as entries, count(reject_reason) as invalid, count(*) <= 1000 and count(reject_reason) = 0 as accepted from asked group by 1)
"""


def _intake(spark: SparkSession, d: str) -> ingest.Intake:
    """The webhook bodies as ledger requests of one, two or very many entries, in two arrivals, the first of them replayed."""
    ensure_checkpoints(spark)
    at = shared_path(spark, "intake")
    k = F.col("k")
    request = F.when(k % 10 == 7, F.concat(F.lit("many-"), F.floor(k / 20_000).cast("string"))).when(k % 3 == 0, F.concat(F.lit("one-"), k.cast("string"))).otherwise(F.concat(F.lit("two-"), F.floor(k / 2).cast("string")))
    own = F.map_from_arrays(F.array(F.lit("entry_id"), F.lit("idempotency_key")), F.array(F.concat(F.lit("E-"), k.cast("string")), F.col("idempotency_key")))
    body = F.map_filter(F.from_json("payload", "map<string,string>"), lambda f, _: f != "gateway_ref")
    entry = F.struct(k.alias("k"), F.map_concat(body, own).alias("entry"))
    requests = _raw(spark, d).groupBy(request.alias("request_id")).agg(F.sort_array(F.collect_list(F.struct("k", F.to_json(entry["entry"]).alias("entry")))).alias("e"))
    lines = requests.select(F.concat(F.lit('{"request_id":"'), "request_id", F.lit('","entries":['), F.array_join(F.col("e.entry"), ","), F.lit("]}")).alias("value"), (F.crc32("request_id") % 2).alias("arrival"))
    for n in range(2):
        lines.filter(F.col("arrival") == n).select("value").write.text(f"{at}/in/arrival={n}")
        intake = ingest.run_available(spark, f"{at}/in", "ledger", f"{at}/out", f"{at}/checkpoint")
        if not n:
            intake(spark.read.text(f"{at}/in/arrival={n}"), 0)
    return intake


@query(_INTAKE_SQL + "select * from told")
def intake_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts on whole requests, taken in as a stream."""
    return _intake(spark, d).read(spark, "verdicts").select("request_id", "entries", "invalid", "accepted")


@query(_INTAKE_SQL + """select request_id, 'E-' || k as entry_id, coalesce(reject_reason, case when entries > 1000 then 'request size' when not accepted then 'another entry of the request' end) as reason,
case when accepted then amount end::double as amount, case when accepted then epoch_us(occurred_at::timestamptz) end as occurred_us from asked join told using (request_id)""")
def intake_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries taken in as a stream, and those that were not, with the reason."""
    intake = _intake(spark, d)
    took = intake.read(spark, "accepted").select("request_id", "entry_id", F.lit(None).cast("string").alias("reason"), F.col("amount_value").cast("double").alias("amount"), F.unix_micros("occurred_value").alias("occurred_us"))
    left = intake.read(spark, "rejected").select("request_id", F.get_json_object("payload", "$.entry_id").alias("entry_id"), "reason", F.lit(None).cast("double").alias("amount"), F.lit(None).cast("long").alias("occurred_us"))
    return took.unionByName(left)


# --- ground truth -------------------------------------------------------------------------


def _plan_of_orders(spark: SparkSession, d: str) -> DataFrame:
    """The derived feed as a plan in minor units: what its rules say was injected."""
    orders = spark.read.parquet(f"{d}/orders.parquet")
    g = feeds.gateway_submissions(orders).filter("row_id % 2 = 0").select((F.col("row_id") / 2).cast("long").alias("k"), "amount", F.col("currency").alias("g_currency"), F.col("occurred_at").alias("g_at"))
    led = feeds.ledger_submissions(orders).select(F.col("row_id").alias("k"), F.col("amount").alias("l_amount"), F.col("currency").alias("l_currency"), F.col("occurred_at").alias("l_at"))
    minor = lambda c: (F.col(c) * 100).cast("long")
    ms = lambda c: F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(c)) / 1000
    both = g.join(led, "k", "full")
    none = lambda c: F.col(c).isNull()
    return both.select(
        "k", minor("amount").alias("amount_minor"), minor("l_amount").alias("ledger_minor"), ms("g_at").cast("long").alias("occurred_ms"), ms("l_at").cast("long").alias("ledger_occurred_ms"), none("l_at").alias("dropped"), none("g_at").alias("absent"),
        F.col("g_currency").alias("currency"), F.col("l_currency").alias("ledger_currency"), ((F.col("k") % 33 == 7) & ~none("g_at")).alias("duplicate"),
    )


_PLAN_SQL = """, plan as (
  select coalesce(g.row_id // 2, l.row_id) as k, g.amount, l.amount as la, l.row_id is null as dropped, g.row_id is null as absent, g.currency <> l.currency as apart, abs(epoch_us(l.occurred_at) - epoch_us(g.occurred_at)) // 1000 as ms,
         g.row_id is not null and (g.row_id // 2) % 33 = 7 as duplicate
  from (select * from gsub where row_id % 2 = 0) g full join lsub l on l.row_id = g.row_id // 2),
v as (
  select *, case when dropped then 'g' when absent then 'l' when apart or ms > 60000 then 'b' when amount <> la and abs(amount - la) <= greatest(amount * 0.01, 10) then 'd' when amount <> la then 'b' when ms <= 2000 then 'e' else 't' end as v from plan),
truth as (
  select count(*) as planned, count(*) filter (where v = 'e') as matched_exact, count(*) filter (where v = 't') as matched_time_drift, count(*) filter (where v = 'd') as amount_drift,
         count(*) filter (where v in ('g', 'b')) as unmatched_gateway, count(*) filter (where v in ('l', 'b')) as unmatched_ledger, count(*) filter (where duplicate) as duplicates from v)
"""


@query(_PLAN_SQL + """select *, matched_exact + matched_time_drift as matched, matched_exact + matched_time_drift + amount_drift + unmatched_gateway + unmatched_ledger + duplicates as expected_results,
matched_exact + matched_time_drift + amount_drift + unmatched_gateway + unmatched_ledger as expected_active,
(matched_exact + matched_time_drift) / (matched_exact + matched_time_drift + amount_drift + unmatched_gateway + unmatched_ledger)::double as expected_match_rate from truth""")
def ground_truth(spark: SparkSession, d: str) -> DataFrame:
    return groundtruth.totals(_plan_of_orders(spark, d))


_DETECTED_SQL = _PLAN_SQL + """, det as (
  select count(*) filter (where match_layer = 'exact') as matched_exact, count(*) filter (where match_layer = 'time_drift') as matched_time_drift, count(*) filter (where status = 'amount_drift') as amount_drift,
         count(*) filter (where status = 'unmatched_gateway_only') as unmatched_gateway, count(*) filter (where status = 'unmatched_ledger_only') as unmatched_ledger, count(*) filter (where status = 'duplicate') as duplicates
  from res),
sides as (select t.{0}, {1} from truth t, det d)
"""
_KINDS = ("matched_exact", "matched_time_drift", "amount_drift", "unmatched_gateway", "unmatched_ledger", "duplicates")
_DETECTED_SQL = _DETECTED_SQL.format(", t.".join(_KINDS), ", ".join(f"d.{c} as d_{c}" for c in _KINDS))


def _compared_sql(lines: dict[str, tuple[str, ...]]) -> str:
    one = lambda name, parts: f"select '{name}' as category, {' + '.join(parts)} as injected, {' + '.join('d_' + p for p in parts)} as detected from sides"
    return _DETECTED_SQL + "select *, detected - injected as delta, detected = injected as agrees from (" + " union all ".join(one(k, v) for k, v in lines.items()) + ")"


def _injected_and_detected(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(truth, detected) of all orders, the second through the whole engine."""
    planned = _plan_of_orders(spark, d)
    with small_tasks(spark, _submitted(spark, d)):
        found = written(groundtruth.detected(results.reconcile(_sub(spark, d), as_of())), "detected")
        return written(groundtruth.totals(planned), "truth"), found


@query(_compared_sql({"matched": ("matched_exact", "matched_time_drift"), "amount drift": ("amount_drift",), "unmatched": ("unmatched_gateway", "unmatched_ledger"), "duplicates": ("duplicates",)}))
def verify_counts(spark: SparkSession, d: str) -> DataFrame:
    return groundtruth.verify(*_injected_and_detected(spark, d))


@query(_compared_sql({c: (c,) for c in _KINDS}))
def compare_to_truth(spark: SparkSession, d: str) -> DataFrame:
    return groundtruth.compare(*_injected_and_detected(spark, d))


# --- CSV import and text forms ------------------------------------------------------------

_AMOUNTS = ["1,204.00", "-3.4", ".5", "5.", "8.115", "abc", "", "0.00", "+12", "1 000.10", "-0.019", ".", "00042.5"]
_STAMPS = ["1773480600", "1773480600000", "2026-03-14 09:30:00", "2026-03-14T15:00:00+05:30", "2026-03-14", "03/04/2026", "2026-03-14T09:30", "2026-02-30", "", "2026-03-14T09:30:00.123456Z", "2026-03-14T09:30:00-0330"]
_CODES = ["inr", "Rs", "", "EUR", " usd "]
_CELLS_SQL = f""", cells as (
  select o_orderkey + 2 as line, case when o_orderkey % 29 = 0 then ' ' else 'TXN-' || o_orderkey end as txn, ({_AMOUNTS})[(o_orderkey % 13 + 1)::int] as amount, ({_STAMPS})[(o_orderkey % 11 + 1)::int] as stamp,
    ({_CODES})[(o_orderkey % 5 + 1)::int] as code, case when o_orderkey % 2 = 0 then 'K' || o_orderkey else '' end as key from orders),
n1 as (select *, regexp_replace(trim(amount), '[,\\s]', '', 'g') as a, trim(stamp) as s from cells),
n2 as (
  select *, case when regexp_full_match(a, '[+-]?(\\d+(\\.\\d*)?|\\.\\d+)') then
      (case when a[1] = '-' then -1 else 1 end) * (coalesce(nullif(regexp_extract(a, '^[+-]?(\\d*)', 1), ''), '0') || rpad(regexp_extract(a, '\\.(\\d*)$', 1)[1:2], 2, '0'))::bigint end as minor,
    case when regexp_full_match(s, '\\d{{10}}') then s::bigint * 1000 when regexp_full_match(s, '\\d{{13}}') then s::bigint
      when regexp_full_match(s, '\\d{{4}}-\\d{{2}}-\\d{{2}}') then epoch_ms(try_cast(s as date)::timestamp)
      when regexp_full_match(s, '\\d{{4}}-\\d{{2}}-\\d{{2}}[T ]\\d{{2}}:\\d{{2}}(:\\d{{2}})?(\\.\\d+)?(Z|[+-]\\d{{2}}:?\\d{{2}})?') then
        epoch_ms(try_cast(s[1:10] || ' ' || s[12:16] || coalesce(nullif(regexp_extract(s, '^.{{16}}(:\\d{{2}})', 1), ''), ':00') as timestamp))
        + coalesce(try_cast(rpad(regexp_extract(s, '\\.(\\d+)', 1)[1:3], 3, '0') as bigint), 0)
        - coalesce(case when regexp_matches(s, '[+-]\\d{{2}}:?\\d{{2}}$') and length(s) > 16 then (case when regexp_extract(s, '([+-])\\d{{2}}:?\\d{{2}}$', 1) = '-' then -1 else 1 end)
          * (regexp_extract(s, '[+-](\\d{{2}}):?\\d{{2}}$', 1)::int * 60 + regexp_extract(s, '[+-]\\d{{2}}:?(\\d{{2}})$', 1)::int) end, 0) * 60000 end as ms,
    case when trim(code) = '' then 'INR' else upper(trim(code)) end as cur from n1),
n3 as (
  select line, trim(txn) as txn_id, minor as amount_minor, cur as currency, ms as occurred_ms,
    case when trim(txn) = '' then 'empty transaction ID' when minor is null then 'amount "' || amount || '" is not a number' when minor = 0 then 'amount is zero'
      when ms is null then 'timestamp "' || stamp || '" is not ISO 8601 or an epoch value' when not regexp_full_match(cur, '[A-Z]{{3}}') then 'currency "' || cur || '" is not a 3-letter ISO 4217 code' end as reject_reason,
    case when trim(key) <> '' then trim(key) else 'gateway:' || trim(txn) || ':' || minor || ':' || ms end as idempotency_key from n2)
"""
_HEADERS = ["Transaction Ref", "Gross Amount", "Captured At", "Currency Code", "Idempotency Key"]


def _cells(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    pick = lambda values: feeds.pick(values, F.pmod(k, F.lit(len(values))))
    txn = F.when(k % 29 == 0, " ").otherwise(F.concat(F.lit("TXN-"), k.cast("string")))
    key = F.when(k % 2 == 0, F.concat(F.lit("K"), k.cast("string"))).otherwise("")
    return spark.read.parquet(f"{d}/orders.parquet").select((k + 2).alias("line"), F.array(txn, pick(_AMOUNTS), pick(_STAMPS), pick(_CODES), key).alias("cells"))


def _coerced(spark: SparkSession, d: str) -> DataFrame:
    return csvfile.coerce(_cells(spark, d), _HEADERS, csvfile.guess_mapping(_HEADERS), "gateway")


@query(_CELLS_SQL + "select line, amount_minor from n3")
def parse_minor(spark: SparkSession, d: str) -> DataFrame:
    return _coerced(spark, d).select("line", "amount_minor")


@query(_CELLS_SQL + "select line, occurred_ms from n3")
def parse_timestamp(spark: SparkSession, d: str) -> DataFrame:
    return _coerced(spark, d).select("line", "occurred_ms")


@query(_CELLS_SQL + "select line, txn_id, amount_minor, currency, occurred_ms, reject_reason from n3")
def coerce_rows(spark: SparkSession, d: str) -> DataFrame:
    return _coerced(spark, d).select("line", "txn_id", "amount_minor", "currency", "occurred_ms", "reject_reason")


@query(_CELLS_SQL + "select line as row, txn_id, amount_minor, currency, occurred_ms, reject_reason, line % 4 = 0 as ragged from n3")
def csv_file_rows(spark: SparkSession, d: str) -> DataFrame:
    """The cells through files: quotes, line breaks inside quotes, some records too wide."""
    path = shared_path(spark, "csv-cells")
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    number = F.concat(F.lit("row\n"), F.col("line").cast("string"))
    records = _cells(spark, d).select(F.concat(F.concat_ws(",", *(quoted(F.get("cells", F.lit(i))) for i in range(len(_HEADERS))), quoted(number)), F.when(F.col("line") % 4 == 0, ",more").otherwise("")).alias("value"))
    head = ",".join([*_HEADERS, "Row"]) + "\n"
    # each file is a header and many records
    n = 8
    files = records.withColumn("file", F.spark_partition_id() * n + F.pmod(F.xxhash64("value"), F.lit(n))).groupBy("file").agg(F.concat(F.lit(head), F.array_join(F.collect_list("value"), "\n")).alias("value"))
    files.select("value").write.option("maxRecordsPerFile", 1).text(path)
    cells, headers = csvfile.read_csv(spark, path)
    row = F.substring_index(F.get("cells", F.lit(len(_HEADERS))), "\n", -1).cast("long")
    rows = cells.withColumn("line", row)
    return csvfile.coerce(rows, headers, csvfile.guess_mapping(headers), "gateway").join(rows.select("line", "ragged"), "line").select(F.col("line").alias("row"), "txn_id", "amount_minor", "currency", "occurred_ms", "reject_reason", "ragged")


@query(_CELLS_SQL + """select line // 20000 as file, row_number() over (partition by line // 20000 order by line) + 1 as line, line as row, txn_id, amount_minor, currency, occurred_ms, reject_reason, line % 4 = 0 as ragged
from n3""")
def csv_split_rows(spark: SparkSession, d: str) -> DataFrame:
    """The cells through few large files, each read in splits of 64 KB: numbered as one reader would."""
    path = shared_path(spark, "csv-large")
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    number = F.concat(F.lit('row, ""\n'), F.col("line").cast("string"))
    record = F.concat(F.concat_ws(",", *(quoted(F.get("cells", F.lit(i))) for i in range(len(_HEADERS))), F.concat(F.lit('"'), number, F.lit('"'))), F.when(F.col("line") % 4 == 0, ",more").otherwise(""))
    blank = F.when(F.col("line") % 7 == 0, "\n,,").otherwise("")
    records = _cells(spark, d).select(F.floor(F.col("line") / 20_000).alias("part"), "line", F.concat(record, blank).alias("value"))
    heads = records.groupBy("part").agg(F.lit(-1).cast("long").alias("line"), F.lit(",".join([*_HEADERS, "Row"])).alias("value"))
    records.unionByName(heads).repartition("part").sortWithinPartitions("part", "line").select("part", "value").write.partitionBy("part").text(path)
    cells, headers = csvsplit.read_large_csv(spark, path, 64 << 10)
    row = F.substring_index(F.get("cells", F.lit(len(_HEADERS))), "\n", -1).try_cast("long")
    rows = cells.select(row.alias("line"), F.col("line").alias("number"), F.regexp_extract("file", r"part=(\d+)", 1).cast("long").alias("file"), "cells", "ragged")
    typed = csvfile.coerce(rows, headers, csvfile.guess_mapping(headers), "gateway", keep=("number", "file", "ragged"))
    return typed.select("file", F.col("number").alias("line"), F.col("line").alias("row"), "txn_id", "amount_minor", "currency", "occurred_ms", "reject_reason", "ragged")


@query(_CELLS_SQL + "select line, reject_reason from n3 where reject_reason is not null order by line limit 50")
def reported_rejects(spark: SparkSession, d: str) -> DataFrame:
    return csvfile.reported_rejects(_coerced(spark, d))


@query(_CELLS_SQL + "select line, idempotency_key from n3 where reject_reason is null")
def derive_key(spark: SparkSession, d: str) -> DataFrame:
    return csvfile.accepted(_coerced(spark, d)).select("line", "idempotency_key")


@query(_CELLS_SQL + """select idempotency_key[1:128] as entry_id, txn_id, (amount_minor / 100.0)::decimal(18,2)::varchar as amount, currency, strftime(make_timestamp(occurred_ms * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') as occurred_at, idempotency_key[1:255] as idempotency_key
from n3 where reject_reason is null""")
def ledger_payloads(spark: SparkSession, d: str) -> DataFrame:
    return csvfile.ledger_payload(csvfile.accepted(_coerced(spark, d)))


@query("""select k, (case when k % 2 = 0 then -1 else 1 end * planned)::varchar as decimal_text, case when k % 2 = 0 then '-' else '' end || printf('%,.2f', planned::double) as grouped,
strftime(t0, '%Y-%m-%d %H:%M:%S.%g') as stamp, strftime(t0, '%H:%M:%S.%g') as clock from o""")
def text_forms(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    minor = (F.col("planned") * 100).cast("long") * F.when(k % 2 == 0, -1).otherwise(1)
    return feeds._planned(spark.read.parquet(f"{d}/orders.parquet")).select("k", money.to_decimal_string(minor).alias("decimal_text"), money.format_minor(minor).alias("grouped"), times.format_timestamp(F.col("at")).alias("stamp"), times.format_clock(F.col("at")).alias("clock"))


@query(_CELLS_SQL + """select txn_id, (amount_minor / 100.0)::decimal(18,2)::varchar as amount, currency, strftime(make_timestamp(occurred_ms * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') as occurred_at, idempotency_key[1:128] as gateway_ref
from n3 where reject_reason is null""")
def gateway_payloads(spark: SparkSession, d: str) -> DataFrame:
    return csvfile.gateway_payload(csvfile.accepted(_coerced(spark, d)))


@query("""select k, k::varchar || case when k < 1000 then 'ms' else '' end as probe, (k * 7 / 100.0)::decimal(20,2)::varchar || '%' as percent,
case when k * 97 < 1024 then (k * 97)::varchar || ' B' when k * 97 < 1048576 then (k * 97 / 1024.0)::decimal(20,6)::decimal(20,1)::varchar || ' KB' else (k * 97 / 1048576.0)::decimal(20,6)::decimal(20,1)::varchar || ' MB' end as bytes,
'reason' || case when k % 3 = 0 then '' else ' — note ' || k end as resolution from o""")
def label_forms(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("k")).select(
        "k", F.concat(k.cast("string"), F.when(k < 1000, "ms").otherwise("")).alias("probe"), text.format_percent(k * F.lit("0.0007").cast("decimal(5,4)")).alias("percent"), text.format_bytes(k * 97).alias("bytes"),
        text.resolution_text(F.lit("reason"), F.when(k % 3 == 0, "  ").otherwise(F.concat(F.lit(" note "), k.cast("string")))).alias("resolution"),
    )


@query("select k, (planned * 1.0055)::decimal(18,2) as amount from o", money=("amount",))
def half_up_amounts(spark: SparkSession, d: str) -> DataFrame:
    rows = feeds._planned(spark.read.parquet(f"{d}/orders.parquet"))
    return rows.select("k", money.half_up(F.col("planned") * F.lit("1.0055").cast("decimal(5,4)")).alias("amount"))


@query("select side, row_id, submissions from pend")
def pending_receipts(spark: SparkSession, d: str) -> DataFrame:
    rec = _rec(spark, d)
    return results.pending(rec, _taken(rec)).select("side", "row_id", "submissions")


@query("select e.id, e.closed_at, e.resolution_notes, f.txn_id, f.status from exc2 e join feed f on f.id = e.result_id where e.closed_at is not null")
def closed_exceptions(spark: SparkSession, d: str) -> DataFrame:
    numbered = _stored(spark, d)
    rows = reads.exception_feed(_exceptions(numbered), numbered, open_only=False)
    return rows.select("id", "closed_at", "resolution_notes", "txn_id", "status")


@query("select f.id, f.status, f.txn_id, e.id as exception_id, e.closed_at from feed f left join exc2 e on e.result_id = f.id")
def feed_with_exceptions(spark: SparkSession, d: str) -> DataFrame:
    numbered = _stored(spark, d)
    exc = _exceptions(numbered).select(F.col("id").alias("exception_id"), "result_id", "closed_at")
    rows = numbered
    return rows.join(exc, rows["id"] == exc["result_id"], "left").select("id", "status", "txn_id", "exception_id", "closed_at")


_STREAM_SQL = SQL["assign_contested"]
_STREAM_SQL = _STREAM_SQL[: _STREAM_SQL.rindex("select txn_id, currency, unnest")] + """,
picked as (select unnest(gs) as g, unnest(ls) as l from last),
lone as (
  select row_id as gateway_id, null::bigint as ledger_id, 'unmatched_gateway_only' as status, received_at from cg where row_id not in (select g from picked)
  union all select null, row_id, 'unmatched_ledger_only', received_at from cl where row_id not in (select l from picked)),
-- a row breaks when the watermark, ten minutes behind the last receipt, has passed its wait
seen as (select max(received_at) as top from (select received_at from cg union all select received_at from cl))
select gateway_id, ledger_id, status from lone, seen where received_at + interval 300 seconds < top - interval 10 minutes
union all select p.g, p.l, case when cp.rank = 2 then 'amount_drift' else 'matched' end from picked p join cp on cp.g = p.g and cp.l = p.l
"""


def _streamed(spark: SparkSession, d: str, cfg: MatchConfig = DEFAULT) -> str:
    """The contested feed through the streaming matcher, in two arrivals cut in time; the folder of its files."""
    ensure_checkpoints(spark)
    at = shared_path(spark, "stream")
    rows = feeds.contested(spark.read.parquet(f"{d}/orders.parquet"))
    middle = rows.agg(F.expr("min(received_at) + (max(received_at) - min(received_at)) / 2").alias("cut")).first()["cut"]
    for part in (rows.filter(F.col("received_at") < F.lit(middle)), rows.filter(F.col("received_at") >= F.lit(middle))):
        part.write.mode("append").parquet(f"{at}/in")
        matcher.run_available(spark, f"{at}/in", SUBMISSION, f"{at}/out", f"{at}/checkpoints", cfg, files_per_batch=100_000)
    return at


def stream_matches(spark: SparkSession, d: str) -> DataFrame:
    """Matches and breaks of the stream."""
    return matcher.streamed_results(spark, f"{_streamed(spark, d)}/out").select("gateway_id", "ledger_id", "status")


def stream_pending(spark: SparkSession, d: str) -> DataFrame:
    """The rows that still wait in the stream's state, neither matched nor swept, where a row waits for a day."""
    return stream_state.pending(spark, f"{_streamed(spark, d, replace(DEFAULT, unmatched_after_s=86_400))}/checkpoints").select("side", "row_id", "received_at")


QUERIES["stream_pending"] = stream_pending
SQL["stream_pending"] = _STREAM_SQL[: _STREAM_SQL.rindex("select gateway_id, ledger_id, status from lone")] + """
select case when gateway_id is null then 'ledger' else 'gateway' end as side, coalesce(gateway_id, ledger_id) as row_id, received_at from lone, seen where received_at + interval 86400 seconds >= top - interval 10 minutes"""
QUERIES["stream_matches"] = stream_matches
SQL["stream_matches"] = _STREAM_SQL


#: Of the groups that occur well before the last third, a fifth comes late as a whole, and of a fifth the ledger rows do.
_LATE_SQL = _STREAM_SQL[: _STREAM_SQL.rindex(",\npicked as")] + """,
cut as (select max(k) // 4 // 3 as third from cb),
sides as (select row_id, 'gateway' as side, received_at from cg union all select row_id, 'ledger', received_at from cl),
come as (
  select *, row_id // 4 < 2 * third - 24 and row_id // 4 % 5 = 0 as late_group, row_id // 4 < 2 * third - 24 and row_id // 4 % 5 = 1 as late_ledger, row_id // 4 < 2 * third as early from sides, cut),
clock as (
  select max(received_at) filter (where early and not late_group and not (late_ledger and side = 'ledger')) - interval 10 minutes as before_late, max(received_at) - interval 10 minutes as last from come),
picked as (
  select g, l from (select unnest(gs) as g, unnest(ls) as l from last) join come on row_id = g and side = 'gateway' and not late_ledger),
-- a row waits from its receipt, or from its arrival if the clock was later
lone as (
  select side, row_id, case when late_group or (late_ledger and side = 'ledger') then greatest(received_at, before_late) else received_at end as since, last from come, clock
  where case when side = 'gateway' then row_id not in (select g from picked) else row_id not in (select l from picked) end)
select case when side = 'gateway' then row_id end as gateway_id, case when side = 'ledger' then row_id end as ledger_id, 'unmatched_' || side || '_only' as status from lone where since + interval 300 seconds < last
union all select p.g, p.l, case when cp.rank = 2 then 'amount_drift' else 'matched' end from picked p join cp on cp.g = p.g and cp.l = p.l
"""


def stream_late_arrivals(spark: SparkSession, d: str) -> DataFrame:
    """The contested feed in four arrivals, the third of which lies hours behind the stream's clock.

    Groups that come late as a whole still match. Where only the ledger rows do, the gateway rows
    have been swept, so that both sides are breaks; none is lost.
    """
    ensure_checkpoints(spark)
    at = shared_path(spark, "stream")
    rows = feeds.contested(spark.read.parquet(f"{d}/orders.parquet"))
    third = spark.read.parquet(f"{d}/orders.parquet").agg(F.floor(F.floor(F.max("o_orderkey") / 4) / 3)).first()[0]
    group = F.floor(F.col("row_id") / 4)
    late = (group < 2 * third - 24) & ((group % 5 == 0) | ((group % 5 == 1) & (F.col("side") == "ledger")))
    arrival = F.when(late, 2).when(group < third, 0).when(group < 2 * third, 1).otherwise(3)
    for n in range(4):
        rows.filter(arrival == n).write.mode("append").parquet(f"{at}/in")
        matcher.run_available(spark, f"{at}/in", SUBMISSION, f"{at}/out", f"{at}/checkpoints", files_per_batch=100_000)
    return matcher.streamed_results(spark, f"{at}/out").select("gateway_id", "ledger_id", "status")


QUERIES["stream_late_arrivals"] = stream_late_arrivals
SQL["stream_late_arrivals"] = _LATE_SQL


def flagship(spark: SparkSession, d: str, cfg: MatchConfig = DEFAULT) -> DataFrame:
    """Counts by status and layer of everything that the engine decides."""
    return recon_summary(spark, d)
