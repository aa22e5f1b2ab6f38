"""Filter interaction audit: what five filters remove together, in every order, and whose doing it is.

Each document is reduced to the set of filters that it fails. From counts of those sets all 32
coalition removals follow (a coalition removes what any of its filters fails), and from these:
the documents a filter removes at a place in an order are a difference of two coalitions, and
the Shapley values solve the kernel-weighted least squares under the efficiency constraint, whose
normal equations are solved in rationals.

Defined results: a null text is empty and fails A alone (no word, no distinct word, no character)
unless it is also a copy. Filter E compares whole texts by their SHA-256. Of copies, all rows
with the smallest doc_id pass; a row without a doc_id is never a copy and makes none. A row that
occurs several times counts as often. A document is good (toxic) if any of its labels says so;
labels without a doc_id are of no document. A null lang is the part named by the empty string. No
documents, no rows. Columns other than doc_id, text and lang are not read.

At scale: the texts are read once and never shuffled; what moves is a digest, an id and a few
numbers a document, summed before each shuffle, so that a group of copies, however large, moves
once per task. The join with labels is by doc_id, where Spark splits a hot key by itself.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

FILTERS = "ABCDE"
#: The filter that compares with other documents; the others look at one text.
COPIES = FILTERS.index("E")
ALL = (1 << len(FILTERS)) - 1

SPACE = r"[\x20\x09-\x0D]+"
MIN_WORDS = 100
MIN_DISTINCT_PCT = 80
MAX_UPPER_PCT = 10
SYMBOLS = r"[#$%&*|]"


def text_failures(text: Column) -> Column:
    """The filters A to D that a text fails, as bits (A is 1)."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    upper = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    failed = [n < MIN_WORDS, distinct * 100 < n * MIN_DISTINCT_PCT, upper * 100 > F.length(text) * MAX_UPPER_PCT, text.rlike(SYMBOLS)]
    return sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(failed)), F.lit(0))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, failed (the bits of all failed filters), n, good, toxic: a row for each set that occurs."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("copy_of"), text_failures(text).alias("failed"))
    rows = rows.groupBy("doc_id", "copy_of", "failed", "part").agg(F.count("*").alias("n"))
    said = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = rows.join(said, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    group = ["copy_of", "failed", "part", "good", "toxic"]
    rows = rows.groupBy(*group).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least"))
    # a group of copies has now at most four rows for each part
    first = F.col("least") == F.min("least").over(Window.partitionBy("copy_of"))
    rows = rows.withColumn("passes", F.col("nameless") + F.when(first, F.col("n_least")).otherwise(0))
    both = F.array(F.struct("failed", F.col("passes").alias("n")), F.struct(F.col("failed").bitwiseOR(1 << COPIES).alias("failed"), (F.col("n") - F.col("passes")).alias("n")))
    rows = rows.select("part", "good", "toxic", F.explode(both).alias("c")).filter("c.n > 0")
    count = lambda when: F.sum(F.when(when, F.col("c.n")).otherwise(0))
    return rows.groupBy("part", F.col("c.failed").alias("failed")).agg(F.sum("c.n").alias("n"), count(F.col("good")).alias("good"), count(F.col("toxic")).alias("toxic"))


def coalitions(cells: DataFrame) -> DataFrame:
    """part, coalition, n_docs, removed, good, toxic: what each of the 32 sets of filters removes, zeros included."""
    each = cells.withColumn("coalition", F.explode(F.sequence(F.lit(0), F.lit(ALL))))
    hit = F.col("failed").bitwiseAND(F.col("coalition")) != 0
    return each.groupBy("part", "coalition").agg(F.sum("n").alias("n_docs"), *[F.sum(F.when(hit, F.col(c)).otherwise(0)).alias("removed" if c == "n" else c) for c in ("n", "good", "toxic")])


def solved(matrix: list[list[Fraction]], right: list[list[Fraction]]) -> list[list[Fraction]]:
    """X of matrix X = right, by elimination in rationals."""
    n, rows = len(matrix), [list(a) + list(b) for a, b in zip(matrix, right, strict=True)]
    for k in range(n):
        p = next(i for i in range(k, n) if rows[i][k])
        rows[k], rows[p] = rows[p], rows[k]
        rows[k] = [x / rows[k][k] for x in rows[k]]
        for i in range(n):
            if i != k and rows[i][k]:
                rows[i] = [x - rows[i][k] * y for x, y in zip(rows[i], rows[k], strict=True)]
    return [r[n:] for r in rows]


def shapley_weights(m: int = len(FILTERS)) -> list[list[Fraction]]:
    """For each player the weights of all coalitions' values (the empty one is worth nothing).

    Minimises the squared errors of an additive game, weighted by the Shapley kernel, where the
    players' shares must sum to the value of all. The normal equations with their multiplier are
    linear in the values, so they are solved once with a unit value for each coalition.
    """
    full = (1 << m) - 1
    inner = range(1, full)
    kernel = {s: Fraction(m - 1, comb(m, k) * k * (m - k)) for s in inner for k in [s.bit_count()]}
    has = lambda s, i: s >> i & 1
    normal = [[sum(kernel[s] * has(s, i) * has(s, j) for s in inner) for j in range(m)] + [Fraction(1)] for i in range(m)]
    normal.append([Fraction(1)] * m + [Fraction(0)])
    right = [[kernel.get(s, Fraction(0)) * has(s, i) for s in range(full + 1)] for i in range(m)]
    right.append([Fraction(s == full) for s in range(full + 1)])
    return solved(normal, right)[:m]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step; shapley is summed over all orders."""
    spark = docs.sparkSession
    table = written(coalitions(cells(docs, labels)), "coalitions")  # 32 rows a part
    orders = list(permutations(range(len(FILTERS))))
    bits = lambda which: sum(1 << i for i in which)
    steps = [("".join(FILTERS[i] for i in o), k + 1, o[k], bits(o[:k]), bits(o[: k + 1]), 1 << o[k], ALL ^ 1 << o[k], ALL) for o in orders for k in range(len(o))]
    steps = spark.createDataFrame(steps, "filter_order string, step int, filter int, before int, after int, alone int, others int, every int")
    weights = [(i, s, int(w * len(orders))) for i, row in enumerate(shapley_weights()) for s, w in enumerate(row) if w]
    weights = spark.createDataFrame(weights, "filter int, coalition int, weight long")
    shares = table.join(F.broadcast(weights), "coalition").groupBy("part", "filter").agg(F.sum(F.col("weight") * F.col("removed")).alias("shapley"))

    values = table.groupBy("part").agg(F.max("n_docs").alias("n_docs"), F.map_from_entries(F.collect_list(F.struct("coalition", F.struct("removed", "good", "toxic")))).alias("of"))
    out = table.select("part", F.col("coalition").alias("after")).join(F.broadcast(steps), "after").join(shares, ["part", "filter"]).join(values, "part")
    value = lambda coalition, what="removed": F.col("of")[F.col(coalition)][what]
    here = value("after") - value("before")
    return out.select(
        "part", "filter_order", "step", (F.col("n_docs") - value("after")).alias("kept"), here.alias("removed"), (value("alone") - here).alias("redundant"), (value("every") - value("others")).alias("unique_fails"),
        (value("after", "good") - value("before", "good")).alias("good_lost"), (value("after", "toxic") - value("before", "toxic")).alias("toxic_lost"), "shapley",
    )
