"""The streaming matcher: first receipts by a streaming aggregation, matches an epoch at a time.

Submissions of both sides arrive in micro-batches. First receipts are an aggregation whose state
never forgets a key. The matcher keeps the rows that wait as a table with a version an epoch: an
epoch joins its arrivals with them, gives each arrival its best partner in order of arrival, sweeps
rows that waited too long by the stream's clock, and writes what is left. All of it is joins and
aggregations, so no row or key costs a call into Python.
No row is dropped for being late: what comes behind the stream's clock waits from there on.
Output rows have the columns of results.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, MatchConfig
from ..functions.frames import make_dir, scratch, small_tasks, written
from ..functions.times import epoch_us
from ..operators import matching, results as result_ops
from ..operators.matching import layer_name
from .versions import Stepwise, Versions, run_to_end

SIDES = ("gateway", "ledger")
WAITING = "side string, row_id long, txn_id string, currency string, amount decimal(18,2), occurred_us long, received_us long, due_ms long"
MATCHED = "kind string, gateway_id long, ledger_id long, g_amount decimal(18,2), l_amount decimal(18,2), g_occurred_us long, l_occurred_us long, g_received_us long, l_received_us long, rank int, decided_us long"
FIRST = "side string, row_id long, idempotency_key string, txn_id string, amount decimal(18,2), currency string, occurred_us long, received_us long, received_ts timestamp, submissions long, is_first boolean"
DELAY_MS = 600_000
#: What a match says of its rows; pairs carry no more than this and what the assignment reads.
SAID = ("g_amount", "l_amount", "g_occurred_us", "l_occurred_us", "g_received_us", "l_received_us")


class Matcher(Stepwise):
    """The sink of a stream of first receipts (FIRST): writes MATCHED rows to out, keeps waiting rows under state.

    The stream's clock is the latest receipt of the epochs before, less delay_ms. A row waits from
    its receipt, or from its arrival if the clock was already later.
    backlog: receipts that a batch left pending, taken over when the stream first starts.
    """

    def __init__(self, out: str, state: str, cfg: MatchConfig = DEFAULT, delay_ms: int = DELAY_MS, backlog: DataFrame | None = None) -> None:
        self.sink, self.kept, self.cfg, self.backlog = Sink(out), Versions(state, delay_ms), cfg, backlog

    def _due(self, since_ms: Column) -> Column:
        return since_ms + F.lit(self.cfg.unmatched_after_s * 1000 + 1)

    def waiting(self, spark: SparkSession, version: int | None, clock_ms: int) -> DataFrame:
        """The rows (WAITING) that a version left."""
        if version is None and self.backlog is not None:
            rows = self.backlog.select("side", "row_id", "txn_id", "currency", "amount", epoch_us("occurred_at").alias("occurred_us"), epoch_us("received_at").alias("received_us"))
            return rows.withColumn("due_ms", self._due(F.floor(F.col("received_us") / 1000)))
        return self.kept.read(spark, "rows", version, WAITING).filter(F.col("due_ms") > clock_ms)

    def step(self, spark: SparkSession, batch: DataFrame | None, version: int) -> None:
        last, newest, before_ms = self.kept.before(spark, version)
        clock = self.kept.clock_after(newest)
        rows = self.waiting(spark, last, before_ms)
        with scratch(spark):
            found = None
            if batch is not None:
                arrived = batch.select("side", "row_id", "txn_id", "currency", "amount", "occurred_us", "received_us").withColumn("due_ms", self._due(F.greatest(F.floor(F.col("received_us") / 1000), F.lit(clock))))
                newest = max((x for x in (newest, batch.agg(F.max("received_us")).first()[0]) if x is not None), default=None)
                found = written(self._pairs(rows, arrived), "stream-matches")
                rows = _less(rows.unionByName(arrived), found)
            # rows that are due go out and are passed over when the version is read
            rows.select(*(c.split()[0] for c in WAITING.split(", "))).write.mode("overwrite").parquet(self.kept.at("rows", version))
            due = _lone(self.kept.read(spark, "rows", version, WAITING).filter(F.col("due_ms") <= clock))
            self.sink(due if found is None else found.unionByName(due), version)
        self.kept.commit(spark, version, newest, clock, "rows")

    def _pairs(self, waiting: DataFrame, arrived: DataFrame) -> DataFrame:
        """Matches of arrivals with rows that wait or arrived before them (MATCHED)."""
        # rows that wait came before all arrivals, whatever their receipts say
        turn = lambda rows, fresh: rows.withColumns({"fresh": F.lit(fresh), "occurred_at": _ts("occurred_us"), "received_at": _ts("received_us") if fresh else F.lit("0001-01-01").cast("timestamp_ntz")})
        pairs = matching.classified(turn(waiting, False).unionByName(turn(arrived, True)), self.cfg, ("occurred_us", "received_us", "fresh"))
        took = matching.assign(pairs.filter("g_fresh or l_fresh").select(*matching.CHOICE, *SAID), "arrived")
        return took.select(
            F.lit("match").alias("kind"), F.col("g_row_id").alias("gateway_id"), F.col("l_row_id").alias("ledger_id"), "g_amount", "l_amount", "g_occurred_us", "l_occurred_us", "g_received_us", "l_received_us",
            F.col("rank").cast("int").alias("rank"), F.greatest("g_received_us", "l_received_us").alias("decided_us"),
        )


def _less(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows that found does not match."""
    taken = found.select(F.explode(F.array(F.struct(F.lit("gateway").alias("side"), F.col("gateway_id").alias("row_id")), F.struct(F.lit("ledger").alias("side"), F.col("ledger_id").alias("row_id")))).alias("t")).select("t.*")
    return rows.join(taken, ["row_id", "side"], "left_anti")


def _lone(rows: DataFrame) -> DataFrame:
    """Rows that waited too long, as MATCHED rows."""
    of = lambda s, c: F.when(F.col("side") == s, F.col(c))
    both = lambda c: (of("gateway", c).alias(f"g_{c}"), of("ledger", c).alias(f"l_{c}"))
    return rows.select(
        F.col("side").alias("kind"), of("gateway", "row_id").alias("gateway_id"), of("ledger", "row_id").alias("ledger_id"), *both("amount"), *both("occurred_us"), *both("received_us"),
        F.lit(None).cast("int").alias("rank"), (F.col("due_ms") * 1000).alias("decided_us"),
    )


def _ts(us: str) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def as_results(raw: DataFrame, cfg: MatchConfig = DEFAULT) -> DataFrame:
    """The matcher's rows in the columns of results, notes and latency included."""
    named = raw.select("*", *(_ts(f"{s}_{c}_us").alias(f"{s}_{c}_at") for s in ("g", "l") for c in ("occurred", "received")), F.col("gateway_id").alias("g_row_id"), F.col("ledger_id").alias("l_row_id"), _ts("decided_us").alias("decided_at"))
    pairs = named.filter("kind = 'match'").withColumns({"match_layer": layer_name(F.col("rank")), "dt_us": F.abs(F.col("g_occurred_us") - F.col("l_occurred_us"))})
    lone = named.filter("kind <> 'match'").select(F.col("kind").alias("side"), F.coalesce("g_row_id", "l_row_id").alias("row_id"), F.coalesce("g_received_at", "l_received_at").alias("received_at"), "decided_at")
    return result_ops.match_results(pairs, cfg).unionByName(result_ops.breaks(lone, F.col("decided_at")))


def first_receipts(submissions: DataFrame) -> DataFrame:
    """A stream of submissions (SUBMISSION) to a stream of receipts (FIRST), to be read in update mode.

    A micro-batch gives a row for each key that it brings: the first submission ever, by
    micro-batch, receipt and id, how many there were so far, and whether the key is new.
    """
    timed = submissions.withColumns({"seen": F.current_timestamp(), "occurred_us": epoch_us("occurred_at"), "received_us": epoch_us("received_at")})
    first = F.min(F.struct("seen", "received_us", "row_id", "txn_id", "amount", "currency", "occurred_us")).alias("first")
    kept = timed.groupBy("side", "idempotency_key").agg(first, F.count("*").alias("submissions"))
    # in a stream the current instant is one for a micro-batch, also when that is replayed
    return kept.select(
        "side", "first.row_id", "idempotency_key", "first.txn_id", "first.amount", "first.currency", "first.occurred_us", "first.received_us",
        F.timestamp_micros("first.received_us").alias("received_ts"), "submissions", (F.col("first.seen") == F.current_timestamp()).alias("is_first"),
    )


class Sink:
    """Writes each micro-batch to a directory of its own; a replay overwrites the same one."""

    def __init__(self, path: str) -> None:
        self.path = path

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.path}/epoch={epoch}")

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path).drop("epoch")


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, so that it need not fit in memory.

    RocksDB does not count its rows, which would be a read before each write.
    """
    ours = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    }
    before = {c: spark.conf.get(c, None) for c in ours}
    for c, value in ours.items():
        spark.conf.set(c, value)
    try:
        yield
    finally:
        for c, value in before.items():
            spark.conf.unset(c) if value is None else spark.conf.set(c, value)


def run_available(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, cfg: MatchConfig = DEFAULT, files_per_batch: int = 1, backlog: DataFrame | None = None) -> None:
    """Reads what a directory of Parquet submissions holds now, and stops.

    Two queries, each with its own checkpoint: receipts, then matches over what they wrote.
    Rows of one micro-batch are put in order of receipt, so the files of one arrival should
    come in one micro-batch (files_per_batch), or in an order of their own.
    """
    with rocksdb(spark), small_tasks(spark):
        raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
        first = first_receipts(raw).writeStream.outputMode("update").option("checkpointLocation", f"{checkpoint}/receipts").foreachBatch(Sink(f"{out}/receipts")).trigger(availableNow=True).start()
        first.awaitTermination()
        make_dir(spark, f"{out}/receipts")
        stream = spark.readStream.schema(FIRST).option("maxFilesPerTrigger", max(64, files_per_batch)).parquet(f"{out}/receipts").filter("is_first")
        run_to_end(spark, stream, Matcher(f"{out}/matches", state_path(checkpoint), cfg, backlog=backlog), f"{checkpoint}/matches")


def state_path(checkpoint: str) -> str:
    """Where run_available's matcher keeps the rows that wait."""
    return f"{checkpoint}/waiting"


def streamed_results(spark: SparkSession, out: str, cfg: MatchConfig = DEFAULT) -> DataFrame:
    return as_results(Sink(f"{out}/matches").read(spark), cfg)
