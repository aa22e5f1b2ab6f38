"""Near-duplicates for the pipeline: SimHash's index, then MinHash, give candidates; shingles verify them.

Texts with the same set of five-word shingles are one node. Nodes whose fingerprints are equal, or
linked by SimHash's inverted index (``simhash.links``), are the first candidates. Since texts at
``SIMILARITY`` are often more bits apart than the index reaches, a node also has ``BANDS`` keys, each made of
``ROWS`` minima of its shingles' hashes (MinHash); pairs that share a key are candidates and
are verified by the exact similarity of their sets. A pair of similarity s shares no key
with probability (1 - s^ROWS)^BANDS: 2 in a million at ``SIMILARITY``, less above. Both kinds of
candidates go through the same exact check.

A key's list is not compared pair by pair: first its members meet the list's least node,
then, in lists where that leaves several components, the members of different components
whose minima agree in ``LEAST_AGREED`` places (six standard deviations below SIMILARITY)
meet each other, and the links of a spanning forest are given out. Such lists are dealt out
to pairs of blocks, each of bounded size.

Defined results: words are parted by white space and lower-cased (ASCII); null and empty
texts have no shingle and are copies of each other; a text of fewer than ``SHINGLE`` words
is one shingle; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread_join, written
from .graph import components
from .simhash import fingerprint, first_of_each, links as near_fingerprints

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 25, 4
LEAST_AGREED = 56
#: Shingles of a list's block; one task compares two blocks.
BLOCK = 1 << 20
CHUNK = 1024
_h = xxhash.xxh64_intdigest
_MUL = np.array([[_h(b"mul%d" % i) | 1] for i in range(BANDS * ROWS)], np.uint64)
_ADD = np.array([[_h(b"add%d" % i)] for i in range(BANDS * ROWS)], np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingles' hashes, in order."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    buf = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    k = min(SHINGLE, len(words))
    n = len(words) - k + 1
    return np.unique(np.fromiter((_h(buf[s:e]) for s, e in zip(starts[:n].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, n))


def minima(hashes: np.ndarray) -> np.ndarray:
    out = np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
    for at in range(0, len(hashes), CHUNK):
        np.minimum(out, ((hashes[at : at + CHUNK] * _MUL + _ADD) >> np.uint64(32)).min(axis=1).astype(np.uint32), out=out)
    return out


def _keys(hashes: np.ndarray) -> np.ndarray:
    if not len(hashes):
        return np.empty(0, np.int64)
    raw, width = minima(hashes).tobytes(), 4 * ROWS
    return np.array([_h(raw[i * width : (i + 1) * width], i) for i in range(BANDS)], np.uint64).view(np.int64)


def marks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, node (hash of the set of shingles), keys, fp (SimHash) of every document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [shingles(t) for t in b["text"]]
            node = np.fromiter((_h(x.tobytes()) for x in found), np.uint64, len(b)).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "text_key": b["text_key"], "node": node, "keys": [_keys(x) for x in found], "fp": np.fromiter(map(fingerprint, b["text"]), np.int64, len(b))})

    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id long, text_key long, node long, keys array<long>, fp long")


def _sets(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [shingles(t) for t in b["text"]]
            yield pd.DataFrame({"node": b["node"], "hashes": [x.view(np.int64) for x in found], "minima": [minima(x).tobytes() for x in found]})

    return texts.select("node", "text").mapInPandas(run, "node long, hashes array<long>, minima binary")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs a, b whose sets of shingles reach SIMILARITY."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("hashes").alias(f"{x}_set"))
    both = F.size(F.array_intersect("a_set", "b_set"))
    joined = pairs.join(side("b"), "b").join(side("a"), "a")
    return joined.filter(both / (F.size("a_set") + F.size("b_set") - both) >= SIMILARITY).select("a", "b")


def _across(rows: pd.DataFrame) -> pd.DataFrame:
    """Links that join the components of a list (or of two of its blocks) that are similar."""
    node, comp, sets = rows["node"].to_numpy(), rows["comp"].to_numpy().copy(), list(rows["hashes"])
    least = np.stack([np.frombuffer(x, np.uint32) for x in rows["minima"]])
    a, b = [], []
    for i in range(len(node) - 1):
        j = i + 1 + np.flatnonzero(comp[i + 1 :] != comp[i])
        for k in j[(least[j] == least[i]).sum(axis=1) >= LEAST_AGREED]:
            if comp[k] == comp[i]:
                continue
            both = len(np.intersect1d(sets[i], sets[k], assume_unique=True))
            if both / (len(sets[i]) + len(sets[k]) - both) >= SIMILARITY:
                comp[comp == comp[k]] = comp[i]
                a.append(node[i])
                b.append(node[k])
    return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def by_fingerprint(reps: DataFrame) -> DataFrame:
    """a, b: candidate pairs of nodes (node, fp): of one fingerprint, or of two that SimHash's index links.

    A fingerprint's nodes meet its least one, which stands for it in links, so there are fewer pairs than nodes and links.
    """
    heads = written(reps.groupBy("fp").agg(F.min("node").alias("head"), F.count("*").alias("n")), "fingerprint-heads")
    same = spread_join(reps.select("fp", "node"), heads.select("fp", "head"), "fp", counts=heads.select("fp", "n")).filter("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    of = lambda x: heads.select(F.col("fp").alias(f"{x}_fp"), F.col("head").alias(x))
    near = written(near_fingerprints(heads.select("fp")), "fingerprint-links").select(F.col("a").alias("a_fp"), F.col("b").alias("b_fp"))
    return written(same.unionByName(near.join(of("a"), "a_fp").join(of("b"), "b_fp").select("a", "b")), "fingerprint-pairs")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, by_minima: bool = True) -> DataFrame:
    """doc_id, text_key, root (a node) for every document; near copies have one root.

    by_minima: False for the candidates of SimHash alone.
    """
    marked = written(marks(docs, id_col, text_col), "shingle-marks")
    reps = written(marked.groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("rep"), F.first("keys").alias("keys"), F.min_by("fp", F.struct("doc_id", "text_key")).alias("fp")), "distinct-shingle-sets")
    near = by_fingerprint(reps.select("node", "fp"))
    posted = reps.filter(F.lit(by_minima)).select("node", F.explode("keys").alias("key"))
    heads = written(posted.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("last"), F.count("*").alias("n")).filter("head <> last").drop("last"), "shared-heads")
    listed = written(spread_join(posted, heads.drop("n"), "key", counts=heads.select("key", "n")), "shared-keys")
    met = listed.select("node").unionByName(near.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    wanted = reps.join(met, "node", "left_semi").select("node", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_key").alias("rep_key"))
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    same = F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.xxhash64("text") == F.col("rep_key"))
    texts = plain.join(wanted, same).select("node", "text").dropDuplicates(["node"])
    sets = written(_sets(texts), "shingle-sets")

    members = listed.filter("node <> head")
    pairs = near.unionByName(members.select(F.col("head").alias("a"), F.col("node").alias("b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = written(verified(pairs.distinct(), sets), "shingle-links")
    roots = written(components(links), "shingle-roots")
    # pairs with a list's head are settled; the rest may still join components
    placed = members.select("key", "node").join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
    placed = placed.join(sets.select("node", F.size("hashes").alias("n")), "node")
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.sum("n").alias("n")).filter("lo <> hi")
    dealt = placed.join(mixed.select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "key").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.least("mine", "other") * F.col("blocks") + F.greatest("mine", "other")
    met = dealt.select("key", pair.alias("pair"), "node", "comp").join(sets, "node")
    more = written(met.groupBy("key", "pair").applyInPandas(_across, "a long, b long").distinct(), "shingle-links")
    if not more.isEmpty():
        roots = components(links.unionByName(more))
    return spread_join(marked.drop("keys", "fp"), roots, "node", "left").select("doc_id", "text_key", F.coalesce("root", "node").alias("root"))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of near copies, as ``simhash.first_of_each`` chooses it."""
    return first_of_each(docs, written(near_duplicates(docs, id_col=id_col, text_col=text_col), "near-duplicates"), id_col=id_col, text_col=text_col)
