"""Benchmark decontamination with DataFrame functions only.

The benchmark's n-grams (windows of ``n`` normalised words; a shorter item is one window)
are hashed; documents are split into words, a window is hashed at every word, and the
hashes are looked up in the benchmark's hash set. A hit counts only when the words of both
windows are the same. One pass over the texts: no text is shuffled, only hits are.

The set is broadcast when it has at most ``broadcast_windows`` windows and BROADCAST_BYTES
bytes, both measured before. A larger one is dealt out to blocks of hashes alone, each
broadcast in a pass of its own over the texts; what they hit is written, and verified by a
join of the windows that were hit, in which windows of very many documents are split off.

Defined results: null and empty texts have no words and no hits; an empty benchmark hits
nothing; repeated documents are judged each by itself; repeated items all count; items
with a null id count as item ``null``; other columns are not read by ``mark`` and pass
through ``drop`` and ``strip`` unchanged, whatever their names. A window is as long as its
words, so very long texts and words cost time in proportion to their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, fresh, spread_join, without, written

#: Letters a-z, digits and everything beyond ASCII, after lower-casing.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
WINDOW = 10
BROADCAST_WINDOWS, BROADCAST_BYTES = 1_000_000, 256 << 20
_HEAD = 0  # the hash under which each document's own row is kept


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def benchmark_windows(bench: DataFrame, n: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """key, size, gram, items: each distinct window with the items that hold it."""
    items = bench.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), words_of(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    long = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))), lambda i: F.slice("w", i, n))
    grams = items.select("item", F.explode(long).alias("g"))
    return grams.groupBy(F.size("g").alias("size"), F.array_join("g", " ").alias("gram"), F.xxhash64("g").alias("key")).agg(F.collect_set("item").alias("items"))


def mark(docs: DataFrame, bench: DataFrame, *, n: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """One row per document: doc_id, text_key, n_words, hits (word number, window size), items."""
    grams = written(benchmark_windows(bench, n), "benchmark-windows")
    size_of = F.octet_length("gram") + F.aggregate("items", F.lit(0).cast("long"), lambda a, i: a + F.octet_length(i) + 16) + 64
    sizes, total, weight = [], 0, 0
    for r in grams.groupBy("size").agg(F.count("*").alias("n"), F.sum(size_of).alias("bytes")).collect():  # n rows at most
        sizes.append(r["size"])
        total, weight = total + r["n"], weight + r["bytes"]
    sizes = sorted(sizes, reverse=True) or [n]
    named = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), words_of(F.col(text_col)).alias("w"))
    if total <= broadcast_windows and weight <= BROADCAST_BYTES:
        return _marked_at_once(named, grams, sizes)
    return _marked_in_blocks(named, grams, sizes, -(-total // max(1, broadcast_windows)))


def _marked_at_once(named: DataFrame, grams: DataFrame, sizes: list[int]) -> DataFrame:
    head = named.sparkSession.range(1).select(F.lit(0).alias("size"), F.lit("").alias("gram"), F.lit(_HEAD).cast("long").alias("key"), F.array().cast("array<string>").alias("items"))
    table = grams.select("size", "gram", "key", "items").unionByName(head).withColumnsRenamed({"size": "g_size", "key": "g_key"})
    split = named.withColumn("row", F.monotonically_increasing_id())
    # row 0 of each document stands for the document, row p for the window from word p on
    at = split.select("doc_id", "text_key", "row", "w", F.size("w").alias("n_words"), F.posexplode(F.array_prepend("w", F.lit(""))).alias("p", "word")).drop("word")
    at = _of_sizes(at, sizes)
    at = at.filter(F.when(F.col("p") == 0, F.col("size") == sizes[0]).otherwise(F.col("p") + F.col("size") - 1 <= F.col("n_words")))
    first = F.greatest("p", F.lit(1))
    at = at.withColumn("key", F.when(F.col("p") == 0, F.lit(_HEAD).cast("long")).otherwise(F.xxhash64(F.slice("w", first, F.col("size")))))
    same = F.array_join(F.slice("w", first, F.when(F.col("p") == 0, 0).otherwise(F.col("size"))), " ") == F.col("gram")
    hits = at.join(F.broadcast(table), (F.col("key") == F.col("g_key")) & same, "inner")
    hit = F.when(F.col("p") > 0, F.struct(F.col("p").alias("at"), F.col("size").alias("size")))
    return hits.groupBy("row", "doc_id", "text_key", "n_words").agg(F.array_sort(F.collect_list(hit)).alias("hits"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items")).drop("row")


def _of_sizes(at: DataFrame, sizes: list[int]) -> DataFrame:
    return at.withColumn("size", F.explode(F.array(*map(F.lit, sizes)))) if len(sizes) > 1 else at.withColumn("size", F.lit(sizes[0]))


def _marked_in_blocks(named: DataFrame, grams: DataFrame, sizes: list[int], blocks: int) -> DataFrame:
    """Documents with the same id and text are one here; each row gets the result."""
    at = named.filter(F.size("w") > 0).select("doc_id", "text_key", "w", F.posexplode("w").alias("p", "word")).drop("word")
    at = _of_sizes(at, sizes).filter(F.col("p") + F.col("size") <= F.size("w"))
    window = F.slice("w", F.col("p") + 1, F.col("size"))
    at = at.withColumn("key", F.xxhash64(window))
    met = None
    for block in range(blocks):
        # at most about broadcast_windows numbers
        keys = grams.filter(F.pmod(F.hash("key"), F.lit(blocks)) == block).select(F.col("key").alias("g_key"), F.col("size").alias("g_size")).distinct()
        one = at.join(F.broadcast(keys), (F.col("key") == F.col("g_key")) & (F.col("size") == F.col("g_size"))).select("doc_id", "text_key", (F.col("p") + 1).alias("p"), "size", "key", F.array_join(window, " ").alias("gram"))
        met = one if met is None else met.unionByName(one)
    met = written(met.distinct(), "windows-met")
    known = met.select("key", "size", "gram").distinct().join(grams, ["key", "size", "gram"]).withColumnsRenamed({"size": "g_size", "gram": "g_gram"})
    hits = spread_join(met, written(known, "windows-known"), "key").filter((F.col("size") == F.col("g_size")) & (F.col("gram") == F.col("g_gram")))
    hits = written(hits.select("doc_id", "text_key", F.struct(F.col("p").alias("at"), "size").alias("hit"), "items"), "window-hits")
    who = ["doc_id", "text_key"]
    of_hits = hits.groupBy(*who).agg(F.array_sort(F.collect_set("hit")).alias("hits"))
    of_items = hits.select(*who, F.explode("items").alias("item")).distinct().groupBy(*who).agg(F.collect_list("item").alias("items"))
    found = of_hits.join(of_items.withColumnsRenamed({"doc_id": "i_id", "text_key": "i_key"}), F.col("doc_id").eqNullSafe(F.col("i_id")) & (F.col("text_key") == F.col("i_key"))).select(F.col("doc_id").alias("f_id"), F.col("text_key").alias("f_key"), "hits", "items")
    all_ = named.select("doc_id", "text_key", F.size("w").alias("n_words"))
    joined = all_.join(found, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("text_key") == F.col("f_key")), "left")
    none = F.array().cast("array<struct<at:int,size:int>>")
    return joined.select(*who, "n_words", F.coalesce("hits", none).alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def hit_words(hits: Column) -> Column:
    """Words inside any of the windows (sorted by their first word)."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda a, h: F.struct((a["n"] + F.greatest(F.lit(0), h["at"] + h["size"] - F.greatest(a["end"], h["at"]))).alias("n"), F.greatest(a["end"], h["at"] + h["size"]).alias("end"))
    return F.aggregate(hits, start, step, lambda a: a["n"])


def digest(marked: DataFrame) -> DataFrame:
    n_hit = hit_words(F.col("hits")).cast("long")
    return marked.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def drop(docs: DataFrame, bench: DataFrame, *, n: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that hold no benchmark window, with all their columns.

    Documents are told apart by id and text hash; only those of contaminated ones are joined.
    """
    return without(docs, mark(docs, bench, n=n, id_col=id_col, text_col=text_col).filter(F.size("hits") > 0), id_col, text_col)


def strip(docs: DataFrame, bench: DataFrame, *, n: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with every hit word, and what separates it from the word before, removed."""
    a, b, c = (fresh(docs, x) for x in ("bad_id", "bad_key", "bad_words"))
    bad = mark(docs, bench, n=n, id_col=id_col, text_col=text_col).filter(F.size("hits") > 0).select(F.col("doc_id").alias(a), F.col("text_key").alias(b), F.col("hits").alias(c)).distinct()
    joined = docs.join(bad, F.col(id_col).eqNullSafe(F.col(a)) & (F.xxhash64(text_col) == F.col(b)), "left")
    # piece k is word k with what stands before it; a last piece may hold no word
    upper = WORD.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")
    gap = GAP.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")
    pieces = F.regexp_extract_all(text_col, F.lit(f"{gap}*{upper}|{gap}+$"), F.lit(0))
    kept = F.filter(pieces, lambda _, i: ~F.exists(c, lambda h: (i + 1 >= h["at"]) & (i + 1 < h["at"] + h["size"])))
    text = F.when(F.col(c).isNull(), F.col(text_col)).otherwise(F.ltrim(F.array_join(kept, "")))
    return joined.withColumn(text_col, text).select(*docs.columns)
