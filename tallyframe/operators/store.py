"""The results table: results are decided and written once; feeds, pages and counts read it.

The table holds each result with its number and what both sides say (the columns of
``reads.feed``), in the order of the numbers, so that a page is a read of few row groups.
Numbers are dense: 1 .. n.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import written
from . import reads, results as result_ops


def _write(numbered: DataFrame, mode: str, path: str) -> None:
    # numbered rows lie in runs of numbers as they are read, so nothing is sorted again
    reads.shown(numbered).write.mode(mode).parquet(path)


def save(found: DataFrame, path: str) -> None:
    """Numbers results that carry what their rows say (reads.SIDES) and writes them to path."""
    _write(result_ops.numbered(found), "errorifexists", path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def add(spark: SparkSession, path: str, found: DataFrame) -> int:
    """Appends what the table may still take; how many results that were.

    Results whose rows have theirs already are no-ops, so a replayed batch adds none. The
    new numbers follow the largest one.
    """
    kept = load(spark, path)
    last = kept.agg(F.max("id")).first()[0] or 0
    # numbering reads its rows twice
    new = written(result_ops.append(kept, found), "new-results")
    n = new.count()
    if n:
        _write(result_ops.numbered(new).withColumn("id", F.col("id") + last), "append", path)
    return n


def page(spark: SparkSession, path: str, limit: int, cursor: int | None = None, status: str | None = None) -> DataFrame:
    """reads.page of the table; without a status the numbers of the page are known beforehand."""
    rows = load(spark, path)
    if status is None and cursor is not None:
        rows = rows.filter(F.col("id") >= cursor - limit - 1)
    return reads.page(rows, limit, cursor, status)
