from __future__ import annotations

import random

import corpus_pipeline
from tallyframe.llm import similar


def near_copies():
    """Texts with copies of which a growing share of the words is changed, and chains of copies."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = []
    for i in range(60):
        words = [word() for _ in range(rng.choice([30, 120, 400]))]
        texts.append(" ".join(words))
        for _ in range(5):
            for at in rng.sample(range(len(words)), rng.randint(1, max(1, len(words) // 40))):
                words = [*words[:at], word(), *words[at + 1 :]] if i % 2 else words[:at] + words[at + 1 :]
            texts.append(" ".join(words))
    return [*texts, "", None, "two words", "Two  WORDS", texts[0].upper()]


def slow_roots(texts):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if not sets[i] | sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    return root


def test_pairs_of_similarity_four_fifths_are_joined_as_by_brute_force(spark):
    texts = near_copies()
    want = slow_roots(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block in (similar.BLOCK, 300):
        groups = {}
        for r in similar.near_duplicates(docs, block=block).collect():
            groups.setdefault(r["root"], []).append(r["doc_id"])
        got = {i: min(g) for g in groups.values() for i in g}
        assert [got[i] for i in range(len(texts))] == want
    kept = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert kept == sorted(set(want)) and 1 < len(kept) < len(texts) / 2


def test_fingerprints_within_four_bits_give_candidates_that_are_checked(spark):
    texts = near_copies()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    near = similar.near_duplicates(docs, by_minima=False)
    nodes = {r["node"]: r["fp"] for r in similar.marks(docs).collect()}
    bits = lambda a, b: ((nodes[a] ^ nodes[b]) & (2**64 - 1)).bit_count()
    pairs = [(r["a"], r["b"]) for r in similar.by_fingerprint(spark.createDataFrame(list(nodes.items()), "node long, fp long")).collect()]
    root = {n: n for n in nodes}
    for a, b in pairs:
        old, new = max(root[a], root[b]), min(root[a], root[b])
        root = {n: new if r == old else r for n, r in root.items()}
    assert all(root[a] == root[b] for a in nodes for b in nodes if bits(a, b) <= 4)
    groups = {}
    for r in near.collect():
        groups.setdefault(r["root"], set()).add(r["doc_id"])
    whole = slow_roots(texts)
    # SimHash alone joins some of what is similar, and nothing else
    assert all(len({whole[i] for i in g}) == 1 for g in groups.values())
    assert len(set(whole)) < len(groups) < len(set(nodes))


def test_empty(spark, no_docs):
    assert similar.near_duplicates(no_docs).count() == 0 and similar.one_of_each(no_docs).count() == 0
