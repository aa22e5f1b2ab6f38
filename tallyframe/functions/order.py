"""Row numbers and running totals over a whole frame without gathering it in one task."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .frames import fresh, shared_dir, written


def ensure_checkpoints(spark: SparkSession) -> None:
    """Uses the session's own checkpoint folder; sets one only where there is none."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def placed(rows: DataFrame, order: list[Column | str], part: str, at: str | None = None) -> DataFrame:
    """rows range partitioned and sorted, kept so by a checkpoint, with partition and place."""
    ensure_checkpoints(rows.sparkSession)
    kept = rows.repartitionByRange(*order).sortWithinPartitions(*order).checkpoint()
    n = F.monotonically_increasing_id()
    named = {part: F.shiftright(n, 33), at: n.bitwiseAND((1 << 33) - 1)} if at else {part: F.shiftright(n, 33)}
    return kept.withColumns(named)


def _before(sizes: list[tuple], start: object) -> list[tuple]:
    out, total = [], start
    for part, size in sorted(sizes):
        out.append((part, total))
        total += size
    return out


def row_numbers(rows: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """rows with name, 1 .. n in the given order, which must tell all rows apart.

    A row's number is its place in its range partition plus the sizes of the partitions
    before, of which there are only as many as partitions.
    """
    part, at, before = (fresh(rows, c) for c in ("part", "at", "before"))
    # places are written with the rows: columns take less room than a checkpoint
    n = F.monotonically_increasing_id()
    known_places = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({part: F.shiftright(n, 33), at: n.bitwiseAND((1 << 33) - 1)}), "numbered")
    offsets = _before([(r[0], r[1]) for r in known_places.groupBy(part).count().collect()], 0)
    # as Arrow it is a local relation, which needs no call into Python
    known = rows.sparkSession.createDataFrame(pa.table({part: pa.array([p for p, _ in offsets], pa.int64()), before: pa.array([b for _, b in offsets], pa.int64())}))
    return known_places.join(F.broadcast(known), part).withColumn(name, F.col(before) + F.col(at) + 1).drop(part, at, before)


def running_totals(rows: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """rows with name, the sum of value (long) over all rows up to and with this one, in order."""
    part, at, before = (fresh(rows, c) for c in ("part", "at", "before"))
    known_places = placed(rows, [order], part, at)
    offsets = _before([(r[0], r[1]) for r in known_places.groupBy(part).agg(F.sum(value)).collect()], 0)
    known = rows.sparkSession.createDataFrame(offsets, f"{part} long, {before} long")
    here = F.sum(value).over(Window.partitionBy(part).orderBy(at))
    return known_places.withColumn(name, here).join(F.broadcast(known), part).withColumn(name, F.col(before) + F.col(name)).drop(part, at, before)
