"""Frames that are written to the folder all executors share, and joins that split hot keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A key with more than this share of the rows of a join is hot: at most 1 / HOT_SHARE keys are.
HOT_SHARE = 0.001
HOT_ROWS = 256
#: What a task reads of a shuffle, in packed bytes and in rows; unpacked and sorted it is about five times the bytes.
TASK_BYTES = 16 << 20
ROWS_A_TASK = 250_000
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    A temporary folder stands in where the session names none and all tasks run on this machine.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tallyframe-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def shared_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet into the shared folder and reads it back."""
    path = shared_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def make_dir(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)


@contextmanager
def scratch(spark: SparkSession, *keep: str) -> Iterator[None]:
    """Deletes, at its end, what was written inside it, but for paths whose name begins with keep."""
    before = len(_made)
    yield
    inside, _made[before:] = _made[before:], []
    for path in inside:
        if path.rsplit("/", 1)[-1].startswith(keep):
            _made.append(path)
        else:
            remove(spark, path)


@contextmanager
def small_tasks(spark: SparkSession, rows: int = 0) -> Iterator[None]:
    """Shuffles that run inside are read by tasks of TASK_BYTES at most, however large the input is.

    Adaptive execution packs partitions up to its advisory size, and cannot cut one that is larger,
    so there are at least enough partitions for rows. Neither setting is loosened.
    """
    size, parts = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.shuffle.partitions"
    before = {c: spark.conf.get(c) for c in (size, parts)}
    spark.conf.set(size, min(TASK_BYTES, spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before[size])))
    spark.conf.set(parts, max(int(before[parts]), -(-rows // ROWS_A_TASK)))
    try:
        yield
    finally:
        for c, value in before.items():
            spark.conf.set(c, value)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """No rows, planned without a call into Python."""
    return spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(schema)))


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df does not have."""
    taken, name, n = {c.lower() for c in df.columns}, base, 0
    while name.lower() in taken:
        n += 1
        name = f"{base}_{n}"
    return name


def spread_join(many: DataFrame, one: DataFrame, key: str, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """many joined with one (a row for each key) without gathering a hot key's rows.

    Rows of hot keys, of which there are at most 1 / HOT_SHARE, meet their rows of ``one`` by a
    broadcast; the rest is joined by a shuffle. many should be a written table, since it is
    counted first. counts: (key, n) if known. how: inner or left.
    """
    counts = counts if counts is not None else many.groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.filter((F.col("n") > max(HOT_ROWS, int(total * HOT_SHARE))) & F.col(key).isNotNull()).select(key)
    keys = [r[0] for r in hot.collect()]
    if not keys:
        return many.join(one, key, how)
    # a few keys in all, so the list and the broadcast are small
    is_hot = F.coalesce(F.col(key).isin(keys), F.lit(False))
    usual = many.filter(~is_hot).join(one.filter(~is_hot), key, how)
    return usual.unionByName(many.filter(is_hot).join(F.broadcast(one.filter(is_hot)), key, how))
