from __future__ import annotations

import random
import re

import numpy as np
import xxhash

from tallyframe.llm import graph, simhash


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_roots(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def slow_components(fps, ids):
    roots, least = slow_roots(fps), {}
    for r, i in zip(roots, ids, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return [least.get(r) for r in roots]


def test_fingerprints_and_components_against_brute_force(spark, docs):
    rng = random.Random(2)
    base = ["".join(rng.choice("abcde") for _ in range(4)) for _ in range(120)]
    rows = [(100 + i, " ".join([w if rng.random() > 0.004 * (i % 6) else "zz" for w in base])) for i in range(60)]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    texts = [(r["doc_id"], r["text"]) for r in both.collect()]
    fps = [slow_fingerprint(t) for _, t in texts]
    want = sorted(zip([i for i, _ in texts], [f"{f:016x}" for f in fps], slow_components(fps, [i for i, _ in texts]), strict=True), key=str)
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.digest(simhash.near_duplicates(both)).collect()), key=str)
    assert got == want
    kept = sorted((str(r["doc_id"]), slow_fingerprint(r["text"])) for r in simhash.one_of_each(both).collect())
    root_of = dict(zip(fps, slow_roots(fps), strict=True))
    assert len(kept) == len(set(root_of.values())) == len({root_of[f] for _, f in kept})  # two groups hold an id 10


def test_triples_meet_every_set_of_four():
    from itertools import combinations

    triples = simhash.position_triples()
    assert len(triples) == 20
    assert all(any(set(t) <= set(f) for t in triples) for f in combinations(range(8), 4))


def test_large_lists_lose_no_link(spark):
    """Lists above the block size are dealt out; the components stay those of brute force."""
    rng = np.random.default_rng(4)
    seed = int(rng.integers(0, 2**62))
    fps = sorted({seed ^ sum(1 << int(b) for b in rng.integers(0, 62, rng.integers(0, 9))) for _ in range(400)})
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    roots = {r["node"]: r["root"] for r in graph.components(simhash.links(frame, block=16)).collect()}
    want = slow_components(fps, fps)
    assert [roots.get(f, f) for f in fps] == want
    small = {r["node"]: r["root"] for r in graph.components(simhash.links(frame)).collect()}
    assert small == roots


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 2000 + i) for i in range(30)] + [(5, 5), (77, 78), (78, 77)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[2000 + i] == 1000 for i in range(30)) and got[78] == 77
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty(spark, no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.one_of_each(no_docs).count() == 0
