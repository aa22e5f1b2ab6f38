"""URL filters: a sort-merge range join of urls with nested host/path rules.

A host is turned round, label by label (``a.example.net`` -> ``net.example.a.``), so that
a host and all its subdomains are one interval of the sorted keys. Rules and urls are put
in the same order and range partitioned; in each partition one sweep holds a stack of the
rules whose interval is open, never more than one chain of nested hosts.

Partitions are cut on (key, hash of the url), so one host with a third of all urls is
spread over as many partitions as its share asks for. A rule is copied to each partition
that its interval touches, so no partition needs to know what came before it.

Defined results
* null url, or no ``://``: host and path are empty and no rule fits.
* several rules fit: the longest host + path wins, then the longer host, then ``block``.
* a rule's path is compared as it stands: ``net/`` does not fit ``http://example.net``,
  whose path is empty.
* repeated rows and null ids come out as often as they went in; an empty table gives none.
* columns other than the id and the url are not read, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower

RULE_SCHEMA = "verdict string, host string, path string"
#: The rules that the query judges by.
BASE_RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
#: Keys sampled for each partition boundary; they balance the partitions and decide nothing.
SAMPLES_PER_PARTITION = 64


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, RULE_SCHEMA)


def parse_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, and the sort key with its salt."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = ascii_lower(F.regexp_extract(url, parts, 1))
    return pages.select(F.col(id_col).alias("page_id"), host.alias("host"), F.regexp_extract(url, parts, 2).alias("path"), F.hex(F.xxhash64(url, F.col(id_col))).alias("salt")).withColumn(
        "key", F.concat(F.array_join(F.reverse(F.split("host", r"\.")), "."), F.lit("."))
    )


def _boundaries(urls: DataFrame, partitions: int) -> list[str]:
    """At most partitions - 1 keys that cut the urls into like shares."""
    rows = urls.count()
    if not rows or partitions < 2:
        return []
    share = min(1.0, SAMPLES_PER_PARTITION * partitions / rows)
    near = urls if share == 1.0 else urls.sample(share, seed=7)
    # a bounded sample: about SAMPLES_PER_PARTITION keys for each partition
    keys = sorted(r[0] for r in near.select(F.concat("key", F.lit("\0"), "salt")).collect())
    return sorted({keys[len(keys) * i // partitions] for i in range(1, partitions)}) if keys else []


def _fitting(stack: list, path: str) -> tuple[str | None, str | None]:
    best = None
    for prefix, rules, lengths in stack:
        for n in lengths:
            if n <= len(path) and (hit := rules.get(path[:n])):
                rank = (len(prefix) - 1 + n, len(prefix))
                if best is None or rank > best[0]:
                    best = (rank, hit)
                break
    return best[1] if best else (None, None)


def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by (part, key, rules first); the stack holds the open intervals."""
    stack: list = []
    part = None
    for batch in batches:
        out = []
        for p, key, kind, page_id, host, path, verdict in zip(batch.part, batch.key, batch.kind, batch.page_id, batch.host, batch.path, batch.verdict, strict=True):
            if p != part:
                stack, part = [], p
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind:
                rule, said = _fitting(stack, path)
                out.append((page_id, host, path, rule, said))
                continue
            if not stack or stack[-1][0] != key:
                stack.append((key, {}, []))
            _, rules, lengths = stack[-1]
            if path not in rules:
                lengths.append(len(path))
                lengths.sort(reverse=True)
            if rules.get(path, ("", ""))[1] != "block":
                rules[path] = (host + path, verdict)
        got = pd.DataFrame(out, columns=["page_id", "host", "path", "rule", "said"])
        yield got.astype({"page_id": "Int64"})


def judge_urls(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow", partitions: int | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule (null: none fits), verdict."""
    spark = pages.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    urls = parse_urls(pages, id_col, url_col)
    bounds = _boundaries(urls, n)

    @F.pandas_udf("int")
    def part_of(key: pd.Series, salt: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(bounds, k + "\0" + s) for k, s in zip(key, salt, strict=True)], dtype="int32")

    @F.pandas_udf("array<int>")
    def parts_of(key: pd.Series) -> pd.Series:
        return pd.Series([list(range(bisect_right(bounds, k), bisect_left(bounds, k[:-1] + "/") + 1)) for k in key])

    clean = rules.select(F.lit(None).cast("long").alias("page_id"), ascii_lower(F.coalesce("host", F.lit(""))).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").filter("host != ''")
    opens = clean.withColumn("key", F.concat(F.array_join(F.reverse(F.split("host", r"\.")), "."), F.lit("."))).withColumn("part", F.explode(parts_of("key")))
    asked = urls.withColumn("part", part_of("key", "salt"))
    cols = ["part", "key", "kind", "page_id", "host", "path", "verdict"]
    both = opens.withColumn("kind", F.lit(0)).select(cols).unionByName(asked.withColumns({"kind": F.lit(1), "verdict": F.lit(None).cast("string")}).select(cols))
    swept = both.repartitionByRange(n, "part").sortWithinPartitions("part", "key", "kind").mapInPandas(sweep, "page_id long, host string, path string, rule string, said string")
    return swept.select("page_id", "host", "path", "rule", F.coalesce("said", F.lit(default)).alias("verdict"))
