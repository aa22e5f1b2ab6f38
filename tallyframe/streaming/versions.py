"""What a stream keeps between micro-batches, as tables: a version for each, and one when it is settled.

A version counts once its clock is written, which comes last. A replayed micro-batch starts from
the version before it and overwrites its own, so it adds nothing. Versions that no replay can
need are deleted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import empty, remove

CLOCK = "newest_us long, clock_ms long, version long"


class Versions:
    """Tables by name and version under a folder; a clock for each version that counts.

    The clock of a micro-batch is the newest instant of those before it, less delay_ms.
    """

    def __init__(self, path: str, delay_ms: int) -> None:
        self.path, self.delay_ms = path.rstrip("/"), delay_ms

    def at(self, what: str, version: int) -> str:
        return f"{self.path}/{what}/version={version}"

    def _clocks(self, spark: SparkSession) -> dict[int, tuple[int | None, int]]:
        try:
            rows = spark.read.schema(CLOCK).parquet(f"{self.path}/clock").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return {}
        return {r["version"]: (r["newest_us"], r["clock_ms"]) for r in rows}

    def before(self, spark: SparkSession, version: int | None = None) -> tuple[int | None, int | None, int]:
        """(version, newest_us, clock_ms) of the last one below version, or of the last of all."""
        known = {v: c for v, c in self._clocks(spark).items() if version is None or v < version}
        return (max(known), *known[max(known)]) if known else (None, None, 0)

    def clock_after(self, newest_us: int | None) -> int:
        return 0 if newest_us is None else max(0, newest_us // 1000 - self.delay_ms)

    def read(self, spark: SparkSession, what: str, version: int | None, schema: str) -> DataFrame:
        if version is None:
            return empty(spark, schema)
        return spark.read.schema(schema).parquet(self.at(what, version))

    def commit(self, spark: SparkSession, version: int, newest_us: int | None, clock_ms: int, *what: str) -> None:
        """what: names of the tables whose older versions go."""
        one = spark.range(1).select(F.lit(newest_us).cast("long").alias("newest_us"), F.lit(clock_ms).cast("long").alias("clock_ms"))
        one.coalesce(1).write.mode("overwrite").parquet(self.at("clock", version))
        last = self.before(spark, version)[0]
        for old in [v for v in self._clocks(spark) if last is not None and v < last]:
            for name in ("clock", *what):
                remove(spark, self.at(name, old))


class Stepwise:
    """A sink of micro-batches that keeps Versions: an even version for an epoch, the odd one behind it when settled."""

    kept: Versions

    def step(self, spark: SparkSession, batch: DataFrame | None, version: int) -> None:
        raise NotImplementedError

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        self.step(batch.sparkSession, batch, 2 * epoch)

    def settle(self, spark: SparkSession) -> None:
        """What the clock has passed with the last micro-batch; a second time it does nothing."""
        last = self.kept.before(spark)[0]
        if last is not None and last % 2 == 0:
            self.step(spark, None, last + 1)


def run_to_end(spark: SparkSession, stream: DataFrame, sink: Callable, checkpoint: str) -> None:
    stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start().awaitTermination()
    if isinstance(sink, Stepwise):
        sink.settle(spark)
