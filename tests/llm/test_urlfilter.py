from __future__ import annotations

import random
import re

from tallyframe.llm import urlfilter


def slow(url, rules):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S) if url and "://" in url else None
    host, path = (re.sub("[A-Z]", lambda x: x.group().lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), len(h), said == "block", h + p, said) for said, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def test_against_brute_force(spark):
    rng = random.Random(7)
    hosts = ["net", "example.net", "a.example.net", "x-example.net", "example.com", "org", "b.org", "EXAMPLE.NET", "example.net:80", "", "a..net", ".net"]
    urls = [None, "", "no scheme", "a://b://c/d", "http://net", "http://net/", "ftp://é.net/ü?x#y", "http://net?/x"] + [f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/en/x', '/de/y?q', '/fr/#z', '/EN/'])}" for _ in range(500)]
    rules = [*urlfilter.BASE_RULES, ("block", "a.example.net", "/en/"), ("allow", "a.example.net", "/en/x"), ("allow", "net", "/en/x"), ("block", "net", "/en/x"), ("block", "b.org", "/"), ("allow", "org", "")]
    pages = spark.createDataFrame([(i % 400, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    want = sorted(((i % 400, *slow(u, rules)) for i, u in enumerate(urls)), key=str)
    for n in (1, 7):
        got = urlfilter.judge_urls(pages, urlfilter.rules_frame(spark, rules), partitions=n).collect()
        assert sorted(map(tuple, got), key=str) == want


def test_one_hot_host_is_spread(spark):
    pages = spark.range(2_000).selectExpr("id as page_id", "concat('http://hot.example.net/en/', id) as url")
    bounds = urlfilter._boundaries(urlfilter.parse_urls(pages), 8)
    assert len(bounds) == 7  # though there is one host only
    got = urlfilter.judge_urls(pages, urlfilter.rules_frame(spark, urlfilter.BASE_RULES), partitions=8)
    assert got.filter("rule = 'example.net/en/' and verdict = 'allow'").count() == 2_000


def test_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    rules = urlfilter.rules_frame(spark, urlfilter.BASE_RULES)
    assert urlfilter.judge_urls(none, rules).count() == 0
    some = spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string")
    assert tuple(urlfilter.judge_urls(some, rules.limit(0)).first()) == (1, "a.net", "/x", None, "allow")
