"""One large CSV file read by many tasks, though records may hold line breaks inside quotes.

Spark cuts a text file into splits at line ends, but only what comes before a line tells whether
it begins inside quotes. Each line maps the two states (outside, inside) to two states; the maps
of a split's lines are composed where they lie, and the splits' maps, a few bits each, one after
the other. Then each split knows its true first state, and its lines are joined to records
without a shuffle. A record over a split's end is put together from the pieces of its splits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.frames import written
from .csvfile import header_names, sniff_delimiter

#: Splits' first states (two short keys and a bit each) that are broadcast at most.
BROADCAST_SPLITS = 1_000_000
#: Tasks that read the splits of a size that a caller names, about; a task takes several splits, one after the other.
TASKS = 400


def _after(line: Column, inside: bool, delimiter: str) -> Column:
    """Whether the line ends inside quotes, given whether it begins there.

    Quotes count where a cell begins with one; elsewhere they are text. What follows a closing
    quote up to the next delimiter is text as well.
    """
    sep = re.escape(delimiter)
    if inside:
        end = r'^(?:[^"]|"")*+"'
        return F.when(~line.rlike(end), True).otherwise(_after(F.concat(F.lit("x"), F.regexp_replace(line, end, "")), False, delimiter))
    closed = rf'(^|{sep})"(?:[^"]|"")*+"'
    return F.regexp_replace(line, closed, "$1x").rlike(rf'(^|{sep})"')


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each split, where its lines lead from outside and from inside."""
    out: dict[tuple, list[bool]] = {}
    for b in batches:
        for file, block, a, c in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            at = out.setdefault((file, block), [False, True])
            at[0], at[1] = (c if at[0] else a), (c if at[1] else a)
    rows = [(f, k, a, c) for (f, k), (a, c) in out.items()]
    if rows:
        kinds = (pa.string(), pa.int64(), pa.bool_(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["file", "block", "outside", "inside"])


PIECE = "file string, block long, place long, text string, open boolean, goes_on boolean"


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole records of each split, and the pieces at its ends: goes_on (its record began
    before) and open (its record ends later)."""
    key, lines, place, begun = None, [], 0, False
    out: list[tuple] = []
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_())

    def done(still_open: bool) -> None:
        nonlocal place, begun
        out.append((*key, place, "\n".join(lines), still_open, begun))
        lines.clear()
        place, begun = place + 1, False

    def batch() -> pa.RecordBatch:
        b = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=[c.split()[0] for c in PIECE.split(", ")])
        out.clear()
        return b

    for b in batches:
        for file, block, first, line, a, c in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
            if (file, block) != key:
                if lines:
                    done(True)
                key, place, begun, inside = (file, block), 0, first, first
            lines.append(line)
            inside = c if inside else a
            if not inside:
                done(False)
        if out:
            yield batch()
    if lines:
        done(True)
    if out:
        yield batch()


@contextmanager
def _split_size(spark: SparkSession, size: int | None) -> Iterator[None]:
    """Splits of this size; a task reads several, so that small splits are not a task each."""
    sizes = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.maxPartitionNum": str(TASKS)} if size else {}
    before = {name: spark.conf.get(name, None) for name in sizes}
    try:
        for name, value in sizes.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def _first_states(maps: DataFrame) -> DataFrame:
    """file, block, first: whether a split begins inside quotes. A row a split goes in."""
    by = Window.partitionBy("file").orderBy("block")
    # a split that leads both states to one forgets what came before; between such splits each
    # keeps the state or turns it round
    fixed = F.when(F.col("outside") == F.col("inside"), F.col("outside"))
    turns = F.when((F.col("outside") != F.col("inside")) & F.col("outside"), 1).otherwise(0)
    marked = maps.withColumns({"fixed": fixed, "turned": F.sum(turns).over(by)})
    last = marked.withColumns({"from": F.last("fixed", ignorenulls=True).over(by), "at": F.last(F.when(F.col("fixed").isNotNull(), F.col("turned")), ignorenulls=True).over(by)})
    end = F.coalesce("from", F.lit(False)) != ((F.col("turned") - F.coalesce("at", F.lit(0))) % 2 == 1)
    return last.withColumn("end", end).select("file", "block", F.coalesce(F.lag("end").over(by), F.lit(False)).alias("first"))


def read_large_csv(spark: SparkSession, path: str, split_bytes: int | None = None) -> tuple[DataFrame, list[str]]:
    """(cells, headers), as read_csv gives them, each file being read in as many tasks as it has splits.

    Lines end with LF or CR LF. split_bytes: the size of a split, else the session's. A record
    must fit in a row; its lines may lie in any number of splits.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    head = [r[0].rstrip("\r") for r in text.filter(F.trim("value") != "").limit(5).collect()]
    delimiter = sniff_delimiter(head)
    first = spark.read.option("lineSep", "\n").text(path).limit(1).collect()
    lines = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    led = {"outside": _after(F.col("value"), False, delimiter), "inside": _after(F.col("value"), True, delimiter)}
    with _split_size(spark, split_bytes):
        maps = written(lines.withColumns(led).drop("value").mapInArrow(_maps, "file string, block long, outside boolean, inside boolean"), "csv-maps")
        states = written(_first_states(maps), "csv-states")
        small = states.count() <= BROADCAST_SPLITS
        known = lines.withColumns(led).join(F.broadcast(states), ["file", "block"]) if small else _beside(lines.withColumns(led), states)
        pieces = written(known.select("file", "block", "first", "value", "outside", "inside").mapInArrow(_records, PIECE), "csv-pieces")
    names = header_names_of(head, delimiter) if first else []
    whole = pieces.filter("not open and not goes_on").select("file", "block", "place", "text")
    # pieces of one record: the open end of a split, whole splits inside the quotes, and a first piece
    ends = pieces.filter("open or goes_on")
    by = Window.partitionBy("file").orderBy("block", "place")
    starts = ends.withColumn("start", F.last(F.when(~F.col("goes_on"), F.struct("block", "place")), ignorenulls=True).over(by))
    joined = starts.groupBy("file", "start").agg(F.sort_array(F.collect_list(F.struct("block", "place", "text"))).alias("t")).select("file", "start.block", "start.place", F.array_join(F.col("t.text"), "\n").alias("text"))
    records = whole.unionByName(joined).withColumn("text", F.regexp_replace("text", r"\r$", ""))
    columns = [f"c{i}" for i in range(len(names))]
    schema = ", ".join(f"{c} string" for c in (*columns, "off_width"))
    how = {"sep": delimiter, "escape": '"', "nullValue": "\0", "emptyValue": "", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "off_width"}
    # one element, so that a record is parsed once
    parsed = records.select("file", "block", "place", F.explode(F.array(F.from_csv("text", schema, how))).alias("v"))
    cells = F.array(*(F.coalesce(F.col(f"v.{c}"), F.lit("")) for c in columns))
    found = parsed.select("file", "block", "place", cells.alias("cells"), F.col("v.off_width").isNotNull().alias("ragged")).filter(F.exists("cells", lambda c: F.trim(c) != ""))
    found = written(found, "csv-records")
    return _numbered(found).filter("line > 1").select("file", "line", "cells", "ragged"), names


def header_names_of(head: list[str], delimiter: str) -> list[str]:
    import csv
    import io

    return header_names(next(csv.reader(io.StringIO("\n".join(head)), delimiter=delimiter), []))


def _beside(lines: DataFrame, states: DataFrame) -> DataFrame:
    """lines with their split's first state, the splits being too many to broadcast."""
    n = F.monotonically_increasing_id()
    return lines.withColumn("n", n).join(states, ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "n").drop("n")


def _numbered(found: DataFrame) -> DataFrame:
    """line: a record's number in its file, from 1; splits are numbered by themselves and then offset."""
    in_split = F.row_number().over(Window.partitionBy("file", "block").orderBy("place"))
    sizes = found.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return found.withColumn("at", in_split).join(sizes.withColumn("before", before).drop("n"), ["file", "block"]).withColumn("line", F.col("before") + F.col("at"))
