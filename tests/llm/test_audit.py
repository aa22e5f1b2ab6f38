"""Filter interaction audit against plain loops over documents and orders."""

from __future__ import annotations

import re
from fractions import Fraction
from itertools import permutations
from math import factorial

from tallyframe.llm import audit

SCHEMA = "doc_id long, text string, lang string, part string, n int, removed int"


def slow(docs, labels):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, _ in docs]
    fails = []
    for (i, t, _), w in zip(docs, words, strict=True):
        t = t or ""
        copy = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)
        tests = (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), copy)
        fails.append({f for f, bad in zip("ABCDE", tests, strict=True) if bad})
    said = lambda i, k: i is not None and any(r[0] == i and r[k] == 1 for r in labels)
    out, share = {}, {}
    for part in {lang or "" for _, _, lang in docs}:
        here = [n for n, d in enumerate(docs) if (d[2] or "") == part]
        for order in permutations("ABCDE"):
            left = set(here)
            for step, f in enumerate(order, 1):
                gone = {n for n in left if f in fails[n]}
                left -= gone
                share[part, f] = share.get((part, f), 0) + len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(f in fails[n] for n in here) - len(gone), sum(fails[n] == {f} for n in here), sum(said(docs[n][0], 1) for n in gone), sum(said(docs[n][0], 2) for n in gone)]
    return {k: (*v, share[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def fast(spark, docs, labels):
    rows = [(*d, "clash", 1, 2) for d in docs]
    got = audit.audit(spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")).collect()
    out = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in got}
    assert len(out) == len(got)
    return out


LONG = " ".join(f"w{i}" for i in range(120))


def test_audit_over_nulls_copies_repeats_and_ties(spark):
    docs = [
        (1, LONG, "en"), (2, LONG, "de"), (3, LONG, "en"), (3, LONG, "en"), (1, LONG, "de"), (1, LONG, "en"), (None, LONG, "en"), (None, LONG, "en"),
        (4, None, "en"), (5, "", None), (6, "", ""), (7, " \t\n\v\f\r ", "de"), (8, "A" * 5, "en"), (9, "# " + LONG, "en"), (10, "w " * 40_000, "en"),
        (11, "ÄÖ " + LONG.upper(), None), (12, "\U0001f600 " * 150, "fr"), (13, LONG + " B" * 13, "fr"), (3, "another text of the same id", "en"), (14, "AB cdefgh ijklmnopqr", "en"),
    ]
    labels = [(1, 1, 0, "x"), (1, 0, 0, "x"), (3, 1, 1, None), (None, 1, 1, "x"), (8, None, 1, "x"), (9, 0, None, "x"), (99, 1, 1, "x")]
    assert fast(spark, docs, labels) == slow(docs, labels)


def test_audit_over_a_group_of_copies_with_most_rows(spark):
    docs = [(i, LONG, ("en", "de")[i % 2]) for i in range(3000)] + [(i, f"{i} # words", "en") for i in range(3000, 3200)]
    labels = [(i, i % 3 % 2, i % 7 % 2, "") for i in range(0, 3200, 5)]
    got = fast(spark, docs, labels)
    assert got["en", "EABCD", 1] == (1 + 200, 1499, 0, 1499, sum(i % 3 % 2 for i in range(10, 3000, 10)), sum(i % 7 % 2 for i in range(10, 3000, 10)), 1499 * 120)
    assert got["de", "EABCD", 1][:2] == (0, 1500)


def test_audit_over_no_documents_and_no_labels(spark):
    docs, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(docs, labels).collect() == []
    assert len(audit.audit(spark.createDataFrame([(1, "a", None, "", 0, 0)], SCHEMA), labels).collect()) == 600


def test_least_squares_give_the_shapley_weights():
    for m in (2, 3, 5):
        for i, row in enumerate(audit.shapley_weights(m)):
            for s, w in enumerate(row):
                k = s.bit_count()
                want = Fraction(0)
                if s:
                    want = Fraction(factorial(k - 1) * factorial(m - k), factorial(m)) if s >> i & 1 else -Fraction(factorial(k) * factorial(m - k - 1), factorial(m))
                assert w == want
