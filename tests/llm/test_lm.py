from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tallyframe.llm import lm
from tallyframe.llm.queries import piece_vocabulary_path


def slow_marginal(word, v, pieces, lp):
    a = [1.0] + [0.0] * len(word)
    for j in range(1, len(word) + 1):
        for i in range(j):
            if word[i:j] in pieces:
                a[j] += a[i] * math.exp(lp[pieces[word[i:j]]])
            elif j == i + 1:
                a[j] += a[i] * (math.exp(lp[v.byte]) / 256) ** len(word[i:j].encode())
    return math.log(a[-1])


def test_marginals_and_expected_counts():
    import sentencepiece

    v = lm.vocabulary(piece_vocabulary_path())
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_vocabulary_path())
    usable = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)) and -sp.get_score(i) < 1e8]
    pieces = {p: i for i, p in enumerate(usable)}
    words = ["▁the", "▁thereaté", "▁𝄞x中", "▁", "▁qzqzqz", "a", "▁" + "internationalisation中é" * 5, "▁" + "x" * 99]
    got = lm.log_marginals(words, v.start[None], v)
    for w, g in zip(words, got[:, 0], strict=True):
        assert g == pytest.approx(slow_marginal(w, v, pieces, v.start), rel=1e-12)
    # the expected uses of a piece are the slope of the log probability in its log weight
    uses = lm.expected_counts(words, np.ones((len(words), 1)), v.start, v)[0]
    for p in ("er", "▁the", "a"):
        up = v.start.copy()
        up[pieces[p]] += 1e-5
        slope = (lm.log_marginals(words, up[None], v) - got).sum() / 1e-5
        assert uses[pieces[p]] == pytest.approx(slope, rel=1e-3, abs=1e-6)


def test_base_against_brute_force(spark, docs, no_docs):
    rows = docs.select("doc_id", "text").collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) + ["</end>"]
    c = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = c.total(), len(c)
    want = sorted(((i, held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 6)) for i, t in rows), key=str)
    got = lm.score(docs, piece_vocabulary_path).collect()
    assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got), key=str) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert lm.score(no_docs, piece_vocabulary_path).count() == 0


def test_rare_words_are_joined_to_the_same_scores(spark, docs, monkeypatch):
    key = lambda r: (str(r["doc_id"]), r["n_tokens"])
    whole = sorted(lm.score(docs, piece_vocabulary_path).collect(), key=key)
    monkeypatch.setattr(lm, "FREQUENT", 3)
    for a, b in zip(whole, sorted(lm.score(docs, piece_vocabulary_path).collect(), key=key), strict=True):
        assert a["score"] == pytest.approx(b["score"]) and a["base_score"] == pytest.approx(b["base_score"]) and a["n_known"] == b["n_known"]


def test_long_words_are_walked_in_chunks_to_the_same_sums(monkeypatch):
    v = lm.vocabulary(piece_vocabulary_path())
    words = ["▁" + "theinternationalé中" * 6, "▁" + "abcdefgh" * 13]
    one = np.ones((2, 1))
    sums, uses = lm.log_marginals(words, v.start[None], v), lm.expected_counts(words, one, v.start, v)
    monkeypatch.setattr(lm, "CHUNK", 7)
    assert lm.log_marginals(words, v.start[None], v) == pytest.approx(sums, rel=1e-12)
    assert lm.expected_counts(words, one, v.start, v) == pytest.approx(uses, abs=1e-9)
    monkeypatch.setattr(lm, "LONG_WORD", 1000)  # side by side
    assert lm.log_marginals(words, v.start[None], v) == pytest.approx(sums, rel=1e-12)
    assert lm.expected_counts(words, one, v.start, v) == pytest.approx(uses, abs=1e-9)
    assert math.isfinite(lm.log_marginals(["▁" + "y" * 100_000], v.start[None], v)[0, 0])


@pytest.mark.parametrize("edges", [True, False])
def test_score_against_enumerated_segmentations(spark, edges):
    """The whole score, from training to mixture, by listing every segmentation of every word."""
    import sentencepiece

    texts = [(i, t, lang) for i, (t, lang) in enumerate([("the cat the hat", "en"), ("le chat é", "fr"), ("hat cat", "en"), ("the ct 中", "en"), (None, "fr"), ("le the", None)])]
    v = lm.vocabulary(piece_vocabulary_path())
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_vocabulary_path())
    usable = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)) and -sp.get_score(i) < 1e8]
    ids = {p: i for i, p in enumerate(usable)}

    def ways(w):
        """Every segmentation as {piece: uses}, with what its spelled bytes cost beside them."""
        if not w:
            yield Counter(), 0
        for n in range(1, len(w) + 1):
            step = Counter({ids[w[:n]]: 1}) if w[:n] in ids else Counter({v.byte: len(w[:1].encode())}) if n == 1 else None
            if step is not None:
                for rest, spelled in ways(w[n:]):
                    yield step + rest, spelled + step[v.byte]

    prob = lambda way, p: math.prod(p[i] ** k for i, k in way[0].items()) / 256 ** way[1]
    tokens = lambda t: (t or "").lower().split() + [""]
    train = [(t, lang or "") for i, t, lang in texts if zlib.crc32(str(i).encode()) % 5 != 1]
    langs = [x for x, _ in sorted(Counter(x for _, x in train).items(), key=lambda kv: (-kv[1], kv[0]))]
    used = [Counter(w for t, x in train if x == lang for w in tokens(t)) for lang in langs] + [Counter()]
    start = np.exp(v.start)
    pooled = start
    for _ in range(lm.PASSES):
        n = np.zeros((len(used), v.size))
        for k, c in enumerate(used):
            for w, times in c.items():
                if not w:
                    n[k, v.end] += times
                    continue
                every = list(ways("▁" + w))
                p = np.array([prob(x, pooled) for x in every])
                for x, share in zip(every, p / p.sum(), strict=True):
                    for i, uses in x[0].items():
                        n[k, i] += times * share * uses
        pooled = n.sum(axis=0) + lm.PRIOR * v.size * start
        pooled /= pooled.sum()
    mixed = n + lm.PRIOR * 1000 * pooled
    mixed /= mixed.sum(axis=1, keepdims=True)
    share = np.array([c.total() + 1.0 for c in used])
    want = {}
    for i, t, _ in texts:
        total = 0.0
        for k, c in enumerate(used):
            one = share[k] / share.sum()
            known = c.total() / max(c.total() + len(c), 1)
            for w in tokens(t):
                lattice = sum(prob(x, mixed[k]) for x in ways("▁" + w)) if w else mixed[k, v.end]
                one *= known * c[w] / max(c.total(), 1) + (1 - known) * lattice if edges else lattice
            total += one
        want[i] = math.log10(total)
    got = {r["doc_id"]: r["score"] for r in lm.score(spark.createDataFrame(texts, "doc_id long, text string, lang string"), piece_vocabulary_path, word_edges=edges).collect()}
    assert got == pytest.approx(want, rel=1e-9)


def test_a_text_of_one_very_long_word(spark):
    docs = spark.createDataFrame([(0, "q" * 50_000, "en"), (2, "word " * 50_000, "en")], "doc_id long, text string, lang string")
    assert all(math.isfinite(r["score"]) for r in lm.score(docs, piece_vocabulary_path).collect())


def test_each_of_ten_languages_has_a_model(spark, monkeypatch):
    words = {lang: [f"{a}{lang}{b}" for a in "bcdf" for b in ("a", "eg", "ion")] for lang in "qwzxvjkghy"}
    rows = [(100 * n + i, " ".join(words[lang][(i * k) % 12] for k in range(1, 15)), lang) for n, lang in enumerate(words) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    total = lambda: {r["doc_id"]: r["score"] for r in lm.score(docs, piece_vocabulary_path).collect()}
    apart = total()
    monkeypatch.setattr(lm, "LANGUAGE_SHARE", 2.0)
    pooled = total()
    for n in range(10):
        mine = [i for i, *_ in rows if i // 100 == n]
        assert sum(apart[i] for i in mine) > sum(pooled[i] for i in mine)
