"""Closing exceptions as a stream: opened exceptions and close requests meet an epoch at a time.

The first request in order of (closed_at, seq) closes an exception, later ones are conflicts, and
one for an exception that nobody opened is not found. A request is held until the stream's clock
has passed its instant, so requests that arrive out of order, or before their exception does, are
decided in their order. A request behind the clock is decided where it arrives; none is dropped.
Opened and closed exceptions are tables to which an epoch appends; held requests have a version an
epoch. An epoch is joins and one ranking, so no exception costs a call into Python.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.frames import empty, scratch, small_tasks, written
from ..functions.times import epoch_us
from .matcher import Sink
from .versions import Stepwise, Versions, run_to_end

OPENED = "id long, opened_at timestamp_ntz"
REQUEST = "exception_id long, seq long, closed_at timestamp_ntz, resolution_notes string"
OUTCOME = "exception_id long, seq long, closed_us long, resolution_notes string, outcome string"
HELD = "exception_id long, seq long, at_us long, notes string"


class Closer(Stepwise):
    """The sink of arrivals: writes OUTCOME rows to out, keeps what it knows under state."""

    def __init__(self, out: str, state: str, delay_ms: int = 600_000) -> None:
        self.sink, self.kept = Sink(out), Versions(state, delay_ms)

    def _known(self, spark: SparkSession, what: str, version: int) -> DataFrame:
        """Ids of exceptions that epochs before version opened or closed."""
        try:
            rows = spark.read.schema("exception_id long, version long").parquet(f"{self.kept.path}/{what}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return empty(spark, "exception_id long")
        return rows.filter(F.col("version") < version).select("exception_id")

    def step(self, spark: SparkSession, batch: DataFrame | None, version: int) -> None:
        last, newest, _ = self.kept.before(spark, version)
        clock = self.kept.clock_after(newest)
        due = F.floor(F.col("at_us") / 1000) + 1 <= clock
        held = self.kept.read(spark, "held", last, HELD)
        opened = self._known(spark, "opened", version)
        # what the clock has passed while it was held comes before what arrives behind the clock
        ready, later = [held.filter(due).withColumn("turn", F.lit(0))], [held.filter(~due)]
        with scratch(spark):
            if batch is not None:
                rows = written(batch, "closing")
                newest = max((x for x in (newest, rows.agg(F.max("at_us")).first()[0]) if x is not None), default=None)
                new = rows.filter("kind = 'opened'").select("exception_id").distinct()
                new.write.mode("overwrite").parquet(self.kept.at("opened", version))
                opened = opened.unionByName(new)
                asked = rows.filter("kind = 'close'").select("exception_id", "seq", "at_us", "notes")
                ready.append(asked.filter(due).withColumn("turn", F.lit(1)))
                later.append(asked.filter(~due))
            reduce(DataFrame.unionByName, later).write.mode("overwrite").parquet(self.kept.at("held", version))
            decided = written(self._decided(reduce(DataFrame.unionByName, ready), opened, self._known(spark, "closed", version)), "closed-now")
            decided.filter("outcome = 'closed'").select("exception_id").write.mode("overwrite").parquet(self.kept.at("closed", version))
            self.sink(decided, version)
        self.kept.commit(spark, version, newest, clock, "held")

    @staticmethod
    def _decided(ready: DataFrame, opened: DataFrame, closed: DataFrame) -> DataFrame:
        n = F.row_number().over(Window.partitionBy("exception_id").orderBy("turn", "at_us", "seq"))
        # an exception may be opened again; it is one row on either side
        flag = lambda ids, name: ids.groupBy("exception_id").agg(F.lit(True).alias(name))
        asked = ready.withColumn("n", n).join(flag(opened, "known"), "exception_id", "left").join(flag(closed, "done"), "exception_id", "left")
        outcome = F.when(F.col("known").isNull(), "not_found").when(F.col("done").isNotNull() | (F.col("n") > 1), "conflict").otherwise("closed")
        return asked.select("exception_id", "seq", F.col("at_us").alias("closed_us"), F.col("notes").alias("resolution_notes"), outcome.alias("outcome"))


def arrivals(opened: DataFrame, requests: DataFrame) -> DataFrame:
    """Streams of OPENED and REQUEST as one stream: kind, exception_id, seq, at_us, notes. A request without an exception id only moves the clock."""
    starts = opened.select(F.lit("opened").alias("kind"), F.col("id").alias("exception_id"), F.lit(None).cast("long").alias("seq"), epoch_us("opened_at").alias("at_us"), F.lit(None).cast("string").alias("notes"))
    asks = requests.select(F.when(F.col("exception_id").isNull(), "tick").otherwise("close").alias("kind"), "exception_id", "seq", epoch_us("closed_at").alias("at_us"), F.col("resolution_notes").alias("notes"))
    return starts.unionByName(asks)


def run_available(spark: SparkSession, opened: str, requests: str, out: str, checkpoint: str, delay_ms: int = 600_000) -> DataFrame:
    """Decides what the two folders of Parquet files hold now, and stops; all outcomes so far."""
    rows = arrivals(spark.readStream.schema(OPENED).parquet(opened), spark.readStream.schema(REQUEST).parquet(requests))
    with small_tasks(spark):
        run_to_end(spark, rows, Closer(out, f"{checkpoint}/closing", delay_ms), f"{checkpoint}/stream")
    return Sink(out).read(spark).withColumn("closed_at", F.timestamp_micros("closed_us").cast("timestamp_ntz")).drop("closed_us")
