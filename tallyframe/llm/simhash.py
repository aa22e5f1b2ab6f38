"""SimHash near-duplicates through an inverted index of byte positions with count filtering.

A fingerprint has 8 bytes. Two fingerprints that differ in at most 4 bits differ in at most
4 bytes, so they share at least 4 of the 8 positional bytes: the guaranteed minimum. Lists
of a single positional byte would each hold 1/256 of all fingerprints; so the index is
keyed by three positions and their bytes. Of the 56 triples of positions 20 are enough for
every set of 4 positions to hold one of them (a Turan system), so no pair with 4 shared
bytes is missed. Within a list, the shared positional bytes of a pair are tallied, pairs
under the minimum are left, and the rest are verified bit by bit.

Only distinct fingerprints are indexed, so exact copies cost one aggregation. A list gives
out the links of a spanning forest, not all pairs: when a fingerprint is reached, it is
compared with those not reached yet. A list with more than ``BLOCK`` fingerprints is dealt
out to pairs of blocks, each of them a task's work of bounded size.

Defined results: null and empty texts have fingerprint zero and are linked like any other;
a text of fewer than ``SHINGLE`` words is one shingle; the component of documents that all
have a null id is null, otherwise null ids are passed over; repeated rows come out as often
as they went in; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, spread_join, without, written
from .graph import components

SHINGLE, SEED, MAX_BITS = 4, 42, 4
BYTES, MIN_SHARED = 8, 4
#: Fingerprints of one list that are compared in one task.
BLOCK = 4096
#: Runs up to this length are compared pair by pair.
SHORT_RUN = 8
CHUNK = 1 << 16


def position_triples() -> list[tuple[int, int, int]]:
    """20 triples of the 8 positions, one of them inside every set of 4 positions."""
    part = [0, 0, 0, 1, 1, 1, 2, 2]
    return [t for t in combinations(range(BYTES), 3) if _chosen([part[i] for i in t])]


def _chosen(parts: list[int]) -> bool:
    """All of one part, or two of a part and one of the next."""
    kinds = sorted(set(parts))
    if len(kinds) == 1:
        return True
    twice = max(kinds, key=parts.count)
    once = min(kinds, key=parts.count)
    return len(kinds) == 2 and once == (twice + 1) % 3


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash as a signed integer."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    buf, h = b" ".join(words), xxhash.xxh64_digest
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    k = min(SHINGLE, len(words))
    n = len(words) - k + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        cut = slice(at, min(n, at + CHUNK))
        digests = [h(buf[s:e], SEED) for s, e in zip(starts[cut].tolist(), ends[k - 1 :][cut].tolist(), strict=True)]
        bits = np.unpackbits(np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "text_key": b["text_key"], "fp": np.fromiter(map(fingerprint, b["text"]), np.int64, len(b))})

    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id long, text_key long, fp long")


def shared_bytes(xor: np.ndarray) -> np.ndarray:
    """The tally of positional bytes that two fingerprints share, from their exclusive or."""
    return (xor.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)


def linked(xor: np.ndarray) -> np.ndarray:
    out = shared_bytes(xor) >= MIN_SHARED  # count filter
    # verification; bitwise_count takes the absolute value of signed numbers
    out[out] = np.bitwise_count(xor[out].view(np.uint64)) <= MAX_BITS
    return out


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the fingerprints of a list into its components."""
    left, out = np.unique(fps), []
    while len(left) > 1:
        root, left = left[0], left[1:]
        queue = [root]
        while queue and len(left):
            near = linked(left ^ queue.pop())
            if near.any():
                found = left[near]
                left = left[~near]
                out += [(int(root), int(x)) for x in found]
                queue += list(found)
    return out


def _links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by (key, pair); runs of one list are compared, across batches too."""
    held: tuple[np.ndarray, ...] = tuple(np.empty(0, np.int64) for _ in range(3))

    def links(key: np.ndarray, pair: np.ndarray, fp: np.ndarray) -> pd.DataFrame:
        a, b = [], []
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])]) if len(key) else np.empty(0, np.int64)
        sizes = np.diff(np.r_[starts, len(key)])
        run = np.repeat(np.arange(len(starts)), sizes)
        short = np.repeat(sizes <= SHORT_RUN, sizes)
        for d in range(1, SHORT_RUN):
            i = np.flatnonzero(short[:-d] & (run[:-d] == run[d:])) if len(run) > d else np.empty(0, np.int64)
            if len(i):
                ok = linked(fp[i] ^ fp[i + d])
                a.append(fp[i][ok])
                b.append(fp[i + d][ok])
        for s, n in zip(starts[sizes > SHORT_RUN], sizes[sizes > SHORT_RUN], strict=True):
            if got := forest(fp[s : s + n]):
                x, y = zip(*got, strict=True)
                a.append(np.array(x, np.int64))
                b.append(np.array(y, np.int64))
        empty = np.empty(0, np.int64)
        return pd.DataFrame({"a": np.concatenate(a) if a else empty, "b": np.concatenate(b) if b else empty})

    for batch in batches:
        now = [np.concatenate([h, batch[c].to_numpy(np.int64)]) for h, c in zip(held, ("key", "pair", "fp"), strict=True)]
        if not len(now[0]):
            continue
        last = (now[0] == now[0][-1]) & (now[1] == now[1][-1])
        yield links(*(x[~last] for x in now))
        held = tuple(x[last] for x in now)
    yield links(*held)


def postings(fps: DataFrame) -> DataFrame:
    """fp under each of its 20 keys: the triple's number and the three bytes."""
    byte = lambda i: F.shiftrightunsigned("fp", 8 * i).bitwiseAND(255)
    key: list[Column] = []
    for t, (i, j, k) in enumerate(position_triples()):
        key.append(F.lit(t << 24) + byte(i) * 65536 + byte(j) * 256 + byte(k))
    return fps.select("fp", F.explode(F.array(*key)).alias("key"))


def links(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """a, b: links that connect all distinct fingerprints within MAX_BITS of each other."""
    posted = postings(fps)
    large = posted.groupBy("key").count().filter(F.col("count") > block).select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    dealt = posted.join(large, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = (F.least("mine", "other") * F.col("blocks") + F.greatest("mine", "other")).cast("long")
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = dealt.select("key", pair.alias("pair"), "fp").repartition(n, "key", "pair").sortWithinPartitions("key", "pair")
    return spread.mapInPandas(_links, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, fp, root (a fingerprint), component_id (the smallest document id that
    links reach) for every document."""
    marked = written(fingerprints(docs, id_col, text_col), "fingerprints")
    reps = written(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct-fingerprints")
    roots = components(links(reps.select("fp")))
    placed = written(reps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "placed-fingerprints")
    least = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_fp = written(spread_join(placed, least, "root").select("fp", "root", "component_id"), "components")
    return spread_join(marked, by_fp, "fp").select("doc_id", "text_key", "fp", "root", "component_id")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return first_of_each(docs, written(near_duplicates(docs, id_col=id_col, text_col=text_col), "near-duplicates"), id_col=id_col, text_col=text_col)


def first_of_each(docs: DataFrame, found: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group (root in found), with all its columns: the one with the smallest id.

    Documents are told apart by id and text hash. Null ids come last; of equal ids the
    smallest text hash stays, and of wholly repeated rows one.
    """
    each = written(found.groupBy("root", "doc_id", "text_key").agg(F.count("*").alias("rows")), "documents-by-group")
    first = each.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")).alias("first"))
    judged = spread_join(each, first, "root").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key")))
    kept = without(docs, judged.filter("not stays"), id_col, text_col)
    repeated = judged.filter("stays and rows > 1")
    name = fresh(docs, "text_key")
    # copies of one row among those that stay: few, as each stands for a group
    marked = kept.withColumn(name, F.xxhash64(text_col))
    a, b = fresh(marked, "kept_id"), fresh(marked, "kept_key")
    twice = repeated.select(F.col("doc_id").alias(a), F.col("text_key").alias(b)).distinct()
    same = F.col(id_col).eqNullSafe(F.col(a)) & (F.col(name) == F.col(b))
    again = marked.join(twice, same, "left_semi").dropDuplicates([id_col, name])
    return marked.join(twice, same, "left_anti").unionByName(again).drop(name)
