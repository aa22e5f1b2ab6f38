from __future__ import annotations

import hashlib
import re

from tallyframe.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = [(1, "Alpha beta, gamma delta epsilon zeta eta theta iota kappa lambda mu."), (10, "short item"), (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (3, None), (4, "..."), (5, "short item")]


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def slow(text, items):
    w, hit, found = words(text), set(), set()
    for i, t in items:
        b = words(t)
        n = min(10, len(b))
        for s in range(len(b) - n + 1 if b else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == b[s : s + n]:
                    hit |= set(range(p, p + n))
                    found.add(str(i))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def frames(spark, docs):
    extra = [(50, "xx ALPHA beta gamma delta epsilon zeta eta theta iota kappa lambda mu yy"), (51, "a short, ITEM a short item short"), (52, "alpha beta gamma delta epsilon zeta eta theta iota"), (53, "short item")]
    more = spark.createDataFrame([(i, t, "en", "s", 1, 0, "x", 0.1) for i, t in extra], docs.schema)
    return docs.unionByName(more), spark.createDataFrame(ITEMS, "item_id long, text string")


def test_against_brute_force(spark, docs):
    all_, bench = frames(spark, docs)
    want = sorted(((r["doc_id"], *slow(r["text"], ITEMS)) for r in all_.collect()), key=str)
    for limit in (1_000_000, 2, 0):  # at once, and in blocks
        rows = decontam.digest(decontam.mark(all_, bench, broadcast_windows=limit)).collect()
        got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in rows), key=str)
        assert got == want
        assert all(r["contaminated"] == (r["n_hit"] > 0) for r in rows)


def test_removal(spark, docs):
    all_, bench = frames(spark, docs)
    left = decontam.drop(all_, bench)
    assert left.columns == all_.columns
    assert left.count() == docs.count() + 1 and left.filter("doc_id = 52").count() == 1
    cut = {r["doc_id"]: r["text"] for r in decontam.strip(all_, bench).collect() if r["doc_id"] in (50, 51, 52, 53)}
    assert cut[50] == "xx yy" and words(cut[51]) == ["a", "a", "short"] and cut[53] == ""
    assert cut[52] == "alpha beta gamma delta epsilon zeta eta theta iota"


def test_empty(spark, docs, no_docs):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontam.mark(no_docs, bench).count() == 0
    none = decontam.digest(decontam.mark(docs, bench.limit(0)))
    assert none.count() == docs.count() and none.filter("contaminated").isEmpty()


def test_one_passage_in_half_of_all_documents(spark):
    """In blocks, with the broadcast of joins off: the hot window is split, and clashing names stay."""
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(i, f"start {i} {passage} end" if i % 2 else f"clean text number {i}", 1, 2, 3, "x", "y") for i in range(900)] + [(None, passage, 1, 2, 3, "x", "y"), (7, "one more of this id", 1, 2, 3, "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bad_id int, bad_key int, bad_words int, key string, gram string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = sorted(((i, *slow(t, ITEMS)) for i, t, *_ in rows), key=str)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = decontam.digest(decontam.mark(docs, bench, broadcast_windows=1)).collect()
        assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in got), key=str) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    left = decontam.drop(docs, bench)
    assert left.columns == docs.columns and left.count() == 451
    assert decontam.strip(docs, bench).columns == docs.columns


def test_very_long_text(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = spark.createDataFrame([(1, "word " * 200_000 + "short item " + "x" * 100_000)], "doc_id long, text string")
    r = decontam.digest(decontam.mark(docs, bench)).first()
    assert (r["n_words"], r["n_hit"], r["n_items"]) == (200_003, 2, 2)
