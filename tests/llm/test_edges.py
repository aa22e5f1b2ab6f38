"""Whole pipeline and whole verdicts on awkward tables: empty, null, repeated, very long, with clashing names."""

from __future__ import annotations

import math
from collections import Counter

import corpus_pipeline
import pytest

from tallyframe.llm import packing, quality, simhash, similar
from tallyframe.llm.common import written
from tallyframe.llm.queries import tokenizer_path


def stages(spark, docs, labels, bench, path):
    labels.write.parquet(f"{path}/labels.parquet")
    bench.write.parquet(f"{path}/benchmark.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, path), f"edges-{name}")
        out[name] = docs
    return out


def others(spark, *, empty):
    labels = spark.createDataFrame([(1, 1, 0), (None, None, None), (5, 0, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "and runs away from")], "item_id long, text string")
    return (labels.limit(0), bench.limit(0)) if empty else (labels, bench)


CLASHING = ["bad_id", "bad_key", "text_key", "kept_id", "kept_key", "votes", "terms", "root", "node", "hits", "ids", "start", "key", "stays"]


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_over_nulls_repeats_and_clashing_names(spark, docs, tmp_path, empty):
    wide = docs.select("*", *[docs["row"].alias(c) for c in CLASHING])
    labels, bench = others(spark, empty=empty)
    got = stages(spark, wide, labels, bench, str(tmp_path))
    for name in [n for n, _ in corpus_pipeline.STAGES[:-1]]:
        assert got[name].columns == wide.columns
    kept = [r["row"] for r in got["near_duplicates"].collect()]
    # 0 and 1 are copies; the null, the empty and the blank text (2, 3, 5) are copies as well
    assert sorted(kept) == [0, 2, 4, 6, 7, 8, 9, 10, 11, 12]
    lost = set(kept) - {r["row"] for r in got["decontamination"].collect()}
    assert lost == (set() if empty else {0})
    assert got["packing"].select("doc_id").distinct().count() == got["personal_data"].select("doc_id").distinct().count()


def test_pipeline_over_no_documents(spark, no_docs, tmp_path):
    got = stages(spark, no_docs, *others(spark, empty=True), str(tmp_path))
    assert all(df.count() == 0 for df in got.values())


def slow_distances(text, ref):
    """Jensen-Shannon distances by plain sums over a reference's classes and words."""
    shares, index, words = ref

    def distance(p, q):
        total = 0.0
        for x, y in zip(p, q, strict=True):
            m = (x + y) / 2
            total += (x * math.log2(x / m) if x else 0.0) + (y * math.log2(y / m) if y else 0.0)
        return math.sqrt(max(0.0, total / 2))

    found = Counter(text.encode().lower().split())
    n = sum(found.values())
    known = [found[w] for w in index]
    counts = quality.class_counts(text.encode())
    return distance([c / sum(counts) for c in counts], shares), distance([c / n for c in (*known, n - sum(known))], words)


def test_verdict_of_quality_against_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    refs = quality.references(table)
    assert refs
    texts = {r["doc_id"]: (r["text"] or "", r["lang"] or "") for r in table.collect()}
    verdicts = Counter()
    for r in quality.judge(table, refs).collect():
        text, lang = texts[r["doc_id"]]
        n, near = len(text.encode().split()), None
        if lang in refs and n >= quality.MIN_WORDS and len(text) >= quality.MIN_CHARS:
            near = min((slow_distances(text, ref) for ref in refs.values()), key=sum)
            assert near == pytest.approx((r["class_distance"], r["word_distance"]))
        limits = [floor + slope / math.sqrt(n) for floor, slope in (quality.CLASS_LIMIT, quality.WORD_LIMIT)] if n else []
        far = near is not None and any(d > limit for d, limit in zip(near, limits, strict=True))
        assert r["kept"] == (not r["base_failed"] and not far)
        verdicts[r["kept"]] += 1
    assert verdicts[True] > verdicts[False] > 0


def test_very_long_texts(spark):
    words = " ".join(f"w{i % 5003}" for i in range(300_000))
    table = spark.createDataFrame([(1, words, "en"), (2, words, "en"), (3, "x" * 2_000_000, "en")], "doc_id long, text string, lang string")
    judged = {r["doc_id"]: r for r in quality.judge(table, quality.references(table)).collect()}
    assert judged[1]["n_words"] == 300_000 == judged[1]["n_repeat_words"] and judged[3]["word_chars"] == 2_000_000
    pieces = packing.digest(packing.pack(table, tokenizer_path)).collect()
    for i in (1, 2, 3):
        mine = sorted((r["start"], r["length"], r["doc_tokens"]) for r in pieces if r["doc_id"] == i)
        assert [s for s, _, _ in mine] == [sum(n for _, n, _ in mine[:k]) for k in range(len(mine))]
        assert sum(n for _, n, _ in mine) == mine[0][2]
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(table).collect()} == {1: 1, 2: 1, 3: 3}
    assert sorted(r["doc_id"] for r in similar.one_of_each(table).collect()) == [1, 3]
