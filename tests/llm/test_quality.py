from __future__ import annotations

import random
import re

import numpy as np

from tallyframe.llm import quality


def slow_repeats(words, n=8):
    seen = {}
    for i in range(len(words) - n + 1):
        seen.setdefault(tuple(words[i : i + n]), []).append(i)
    return len({j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + n)})


def test_repeated_words_against_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        w = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 40))]
        assert quality.repeated_words(w) == slow_repeats(w)
    assert quality.repeated_words([b"x"] * 9) == 9 and quality.repeated_words([b"x"] * 8) == 0


def test_counts_against_brute_force(spark, docs):
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect() if r["doc_id"] != 10}
    for r in quality.judge(docs, {}).collect():
        if r["doc_id"] not in texts:
            continue
        t = texts[r["doc_id"]]
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = t.split("\n")
        dups = sum(1 for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:i])
        rep = slow_repeats(words)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dups, rep)
        assert r["base_failed"] == (len(words) < 20 or 100 * rep > 30 * len(words))
        assert r["kept"] == (not r["base_failed"])


def test_distance_is_a_metric_of_shares():
    p, q = np.array([0.5, 0.5, 0.0]), np.array([0.0, 0.0, 1.0])
    assert quality.js_distance(p, p) == 0.0 and abs(quality.js_distance(p, q) - 1.0) < 1e-12


def test_strange_text_is_rejected_and_plain_text_kept(spark):
    rng = random.Random(1)
    syll = ["ta", "ri", "mo", "len", "sha", "ve", "un", "dor"]
    word = lambda: rng.choice(["the", "of", "and", "to"]) if rng.random() < 0.4 else "".join(rng.choice(syll) for _ in range(3))
    rows = [(i, " ".join(word() for _ in range(150)), "en") for i in range(200)]
    odd = [(1000, " ".join(w.upper() + "!!" for w in rows[0][1].split()), "en"), (1001, " | ".join("".join(rng.choice(syll) for _ in range(3)) for _ in range(150)), "en"), (1002, "too short to judge", "en")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in quality.judge(docs, quality.references(docs)).collect()}
    assert all(got[i]["kept"] for i in range(200))
    assert not got[1000]["kept"] and not got[1001]["kept"]
    assert got[1002]["base_failed"] and got[1002]["language"] is None


def test_every_language_has_its_reference_and_rare_ones_are_not_judged_by_others(spark):
    rng = random.Random(5)
    vocab = {f"l{k:02}": ["".join(chr(97 + (k + rng.randrange(6)) % 26) for _ in range(4)) for _ in range(40)] for k in range(20)}
    text = lambda k, n=120: " ".join(rng.choice(vocab[k]) for _ in range(n))
    rows = [(100 * i + j, text(k), k) for i, k in enumerate(vocab) for j in range(12 if i < 18 else 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    refs = quality.references(docs)
    assert sorted(refs) == sorted(vocab)[:18]
    got = quality.judge(docs, refs).collect()
    assert len(got) == len(rows) and all(r["kept"] for r in got)
    assert all(r["language"] == (f"l{r['doc_id'] // 100:02}" if r["doc_id"] < 1800 else None) for r in got)


def test_empty(spark, no_docs):
    assert quality.judge(no_docs, quality.references(no_docs)).count() == 0
