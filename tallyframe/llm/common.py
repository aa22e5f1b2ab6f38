"""Small helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import fresh, remove, scratch, shared_path, spread_join, written

__all__ = ["ascii_lower", "crc_mod", "fresh", "remove", "scratch", "shared_path", "spread_join", "table", "without", "written"]

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only; every other character stays."""
    return F.translate(c, _UPPER, _LOWER)


def crc_mod(doc_id: str, k: int) -> Column:
    """crc32 of the id's decimal text, modulo k (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % k


def without(docs: DataFrame, bad: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs less the documents of bad (doc_id, text_key): told apart by id and hash of the text."""
    a, b = fresh(docs, "bad_id"), fresh(docs, "bad_key")
    named = bad.select(F.col("doc_id").alias(a), F.col("text_key").alias(b)).distinct()
    return docs.join(named, F.col(id_col).eqNullSafe(F.col(a)) & (F.xxhash64(text_col) == F.col(b)), "left_anti")
