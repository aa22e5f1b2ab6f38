"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

1. Terms. Some of the labelled training documents (``TERM_SHARE``, by a hash of their id; no
   later step reads their labels) give terms, words and word beginnings, that are far more
   frequent in toxic ones. About ``MAX_LABELLED`` labelled rows are read at most, chosen by
   a hash as well; the bound is part of the method, and all terms of that sample are kept.
2. Voters. The terms fall into ``LEXICONS`` lexicon voters, by how strong their evidence is
   and by whether clean documents hold them too; the fixed lexicons of ``GIVEN_LEXICONS`` owe nothing to labels; pattern voters look at insult
   frames, density of terms, shouting and symbol noise. Each votes toxic or not on every text.
3. Label model. How often each pattern of votes occurs is counted over every document. An
   EM with a latent class estimates each voter's accuracy and, along a tree of the most
   dependent pairs, the correlations between voters. The labels that gave no terms are
   its start, and their rows are known in it, each counted once like any other.
4. Classifier. A logistic regression on the terms that a document holds and on the pattern
   values learns the label model's posteriors of about ``MAX_FIT`` documents outside the
   held-out fold, chosen by a hash, labelled or not. It sees no label.

The features of all documents come from one pass and are written once; scoring reads them.
Labels are learned only from rows outside the held-out fold, and labels, language, source
and id are never inputs of a score.

Defined results: null and empty texts have no term and get the classifier's lowest class of
evidence, its intercept; without toxic training labels every score is 0; repeated rows and
null ids are scored each by itself; contradictory labels of one id count as toxic; an empty
table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, without, written

MAX_LABELLED, MAX_FIT = 60_000, 60_000
#: The share of the labelled sample that gives terms; the rest anchors the label model.
TERM_SHARE = 0.75
#: A term must stand in this many toxic documents, in few clean ones, and be this much likelier
#: (natural log of the likelihood ratio) under its own toxic share than under the overall one.
MIN_DOCS, MAX_CLEAN_SHARE = 3, 0.02
BEGINNINGS = (3, 4, 5, 6, 7)
#: Lexicons part terms by their evidence (at least so much), first those of toxic documents only.
TIERS = (9.0, 20.0, 50.0, 150.0)
LEXICONS = 2 * len(TIERS)
PATTERNS = ("two_terms", "dense_terms", "insult_frame", "shouting", "symbols")
#: Words of contempt in four languages, by theme.
GIVEN_LEXICONS = {
    "mind": "idiot idiots moron morons stupid dumb fool imbecile clown loser losers idiota imbécil estúpido tonto crétin imbécile débile dummkopf trottel blöd depp",
    "worth": "pathetic worthless useless disgusting despicable inútil patético asqueroso minable pitoyable dégoûtant wertlos erbärmlich widerlich",
    "filth": "trash scum garbage filth vermin pig basura escoria mierda ordure racaille merde abschaum dreck müll",
    "threat": "kill murder strangle matar asesinar crève tuer töten ermorden",
}
VOTERS = LEXICONS + len(GIVEN_LEXICONS) + len(PATTERNS)
THRESHOLD = 0.3
EM_ROUNDS = 50
WORD = re.compile(r"[^\W\d_]+")
#: Words that often stand before an insult.
FRAME_WORDS = {"you", "the", "a", "such", "this", "that", "un", "une", "le", "la", "el", "una", "du", "der", "die", "ein", "eine"}


def terms_of(text: str | None) -> Counter:
    """Lower-cased words (letters only), and their beginnings marked by a star."""
    return Counter(WORD.findall(text.lower())) if text else Counter()


def beginnings(word: str) -> list[str]:
    return [word[:n] + "*" for n in BEGINNINGS if len(word) > n]


_GIVEN = {w: i for i, words in enumerate(GIVEN_LEXICONS.values()) for w in words.split()}


def labelled_sample(labels: DataFrame, max_rows: int = MAX_LABELLED, folds: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, toxic, gives_terms of about max_rows labelled documents, or all, outside the held-out fold.

    The rows whose id hashes below the share that is wanted: no sort, and the same rows each
    time. The number varies by the root of max_rows only. A second hash deals out gives_terms.
    """
    known = labels.filter("toxic is not null and doc_id is not null").filter(crc_mod("doc_id", folds) != held_out)
    each = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("gives_terms", share_of(F.lit("terms"), F.col("doc_id")) < TERM_SHARE)
    n = each.count()
    return each if n <= max_rows else each.filter(share_of(F.lit("labels"), F.col("doc_id")) < max_rows / n)


def share_of(*what: Column) -> Column:
    """A hash as a share of one."""
    return F.pmod(F.xxhash64(*what), F.lit(1 << 31)) / float(1 << 31)


def _document_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per-task sums of documents that hold a term: (term, clean, toxic)."""
    held = (Counter(), Counter())
    n = [0, 0]

    def flush() -> pd.DataFrame:
        terms = list(set().union(*held))
        out = pd.DataFrame({"term": pd.Series([*terms, ""], dtype=object), "clean": [*(held[0][t] for t in terms), n[0]], "toxic": [*(held[1][t] for t in terms), n[1]]})
        for h in held:
            h.clear()
        n[:] = [0, 0]
        return out

    for b in batches:
        for text, toxic in zip(b["text"], b["toxic"], strict=True):
            words = set(terms_of(text))
            words.update([x for w in words for x in beginnings(w)])
            held[int(toxic > 0)].update(words)
            n[int(toxic > 0)] += 1
        if sum(map(len, held)) >= 400_000:
            yield flush()
    yield flush()


def toxic_terms(docs: DataFrame, sample: DataFrame) -> dict[str, int]:
    """The terms, strongest first, with their lexicons. docs: doc_id, text; sample: doc_id, toxic.

    Each stands in MIN_DOCS documents of the bounded sample, which bounds their number.
    """
    seen = docs.filter("text is not null").join(F.broadcast(sample), "doc_id")  # sample is bounded
    counts = seen.select("text", "toxic").mapInPandas(_document_terms, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = written(counts, "toxic-terms")
    total = counts.filter("term = ''").first()
    if total is None or not total["toxic"]:
        return {}
    base = total["toxic"] / (total["toxic"] + total["clean"])
    n = F.col("toxic") + F.col("clean")
    own = F.col("toxic") / n
    evidence = F.col("toxic") * F.log(own / base) + F.col("clean") * F.when(F.col("clean") > 0, F.log((1 - own) / max(1 - base, 1e-9))).otherwise(0.0)
    strong = counts.filter((F.col("term") != "") & (F.col("toxic") >= MIN_DOCS) & (F.col("clean") <= MAX_CLEAN_SHARE * total["clean"]) & (own > base))
    rows = strong.withColumn("evidence", evidence).filter(F.col("evidence") >= TIERS[0]).select("term", "evidence", "clean").collect()
    tier = lambda r: sum(r["evidence"] >= t for t in TIERS) - 1 + len(TIERS) * (r["clean"] > 0)
    return {r["term"]: tier(r) for r in sorted(rows, key=lambda r: (-r["evidence"], r["term"]))}


def _values(text: str | None, index: dict[str, int], lexicon: list[int]) -> tuple[list[int], int]:
    """Numbers of the terms that a text holds, and its votes as bits."""
    words = terms_of(text)
    found: set[int] = set()
    uses, given = 0, 0
    for w, n in words.items():
        hits = [index[x] for x in (w, *beginnings(w)) if x in index]
        found.update(hits)
        uses += n * bool(hits)
        if w in _GIVEN:
            given |= 1 << _GIVEN[w]
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    symbols = sum(text.count(c) for c in "#*$%&|<>") if text else 0
    total, framed = sum(words.values()), False
    if found:
        before = None
        for m in WORD.finditer(text.lower()):
            w = m.group()
            if before in FRAME_WORDS and any(x in index for x in (w, *beginnings(w))):
                framed = True
                break
            before = w
    upper = int(((raw >= 65) & (raw <= 90)).sum())
    patterns = (uses >= 2, uses > 0 and uses * 100 >= total, framed, upper * 3 > len(raw) > 0, symbols * 20 > len(text or "") > 0)
    votes = given << LEXICONS
    for i in found:
        votes |= 1 << lexicon[i]
    for j, p in enumerate(patterns, VOTERS - len(PATTERNS)):
        votes |= int(p) << j
    return sorted(found), votes


def features(docs: DataFrame, terms: dict[str, int]) -> DataFrame:
    """doc_id, held_out, terms (numbers), votes (bits) of every document, in one pass."""
    # terms of the bounded sample
    shared = docs.sparkSession.sparkContext.broadcast(({t: i for i, t in enumerate(terms)}, list(terms.values())))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [_values(t, *shared.value) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "text_key": b["text_key"], "held_out": b["held_out"], "terms": pd.Series([g[0] for g in got], dtype=object), "votes": np.array([g[1] for g in got], np.int32)})

    return docs.mapInPandas(run, "doc_id long, text_key long, held_out boolean, terms array<int>, votes int")


class LabelModel:
    """Latent class with voters that depend on it and on one other voter (a tree)."""

    def __init__(self, votes: np.ndarray, weight: np.ndarray, given: np.ndarray) -> None:
        """votes: (patterns, voters) of 0 and 1, with their weights; given: a class, or -1 where
        it is latent. The start is the given rows' rates."""
        self.votes, self.weight, self.given = votes, weight, given
        rate = lambda c: ((weight * (given == c))[:, None] * votes).sum(axis=0) / max(weight[given == c].sum(), 1)
        rates = np.clip(np.stack([rate(0), rate(1)]), 0.005, 0.95)
        self.parent = np.full(votes.shape[1], -1)
        self.prior = float(np.clip(weight[given == 1].sum() / weight[given >= 0].sum(), 1e-3, 0.5))
        self.table = np.repeat(rates.T[:, None, :], 2, axis=1)  # voter, parent's vote, class
        for i in range(EM_ROUNDS):
            post = np.where(given >= 0, given, self.posterior(votes))
            if i in (5, 15):
                self.parent = self._tree(post)
            self._fit(post)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        log = np.log(np.tile([1 - self.prior, self.prior], (len(votes), 1)))
        for v, p in enumerate(self.parent):
            rate = self.table[v][votes[:, p] if p >= 0 else np.zeros(len(votes), int)]
            log += np.log(np.where(votes[:, [v]] == 1, rate, 1 - rate))
        top = log.max(axis=1, keepdims=True)
        e = np.exp(log - top)
        return (e / e.sum(axis=1, keepdims=True))[:, 1]

    def _fit(self, post: np.ndarray) -> None:
        by_class = np.stack([self.weight * (1 - post), self.weight * post], axis=1)
        self.prior = float(np.clip((by_class[:, 1].sum() + 1) / (by_class.sum() + 2), 1e-4, 0.5))
        for v, p in enumerate(self.parent):
            for u in (0, 1):
                rows = self.votes[:, p] == u if p >= 0 else np.ones(len(self.votes), bool)
                n, k = by_class[rows].sum(axis=0), by_class[rows & (self.votes[:, v] == 1)].sum(axis=0)
                self.table[v, u] = (k + 0.5) / (n + 1.0)

    def _tree(self, post: np.ndarray) -> np.ndarray:
        """Chow-Liu: the spanning tree of greatest mutual information given the class."""
        k = self.votes.shape[1]
        info = np.zeros((k, k))
        for w in (self.weight * (1 - post), self.weight * post):
            share = w.sum() / self.weight.sum()
            for a in range(k):
                for b in range(a):
                    joint = np.array([[w[(self.votes[:, a] == x) & (self.votes[:, b] == y)].sum() for y in (0, 1)] for x in (0, 1)]) + 0.25
                    joint /= joint.sum()
                    alone = joint.sum(axis=1, keepdims=True) * joint.sum(axis=0, keepdims=True)
                    info[a, b] += share * float((joint * np.log(joint / alone)).sum())
        info += info.T
        parent, inside = np.full(k, -1), [0]
        while len(inside) < k:
            a, b = max(((a, b) for a in inside for b in range(k) if b not in inside), key=lambda e: info[e])
            parent[b] = a
            inside.append(b)
        return parent

    def accuracies(self) -> np.ndarray:
        """Of each voter: how often its vote is the latent class."""
        post = self.posterior(self.votes)
        right = np.where(self.votes == 1, post[:, None], 1 - post[:, None])
        return (right * self.weight[:, None]).sum(axis=0) / self.weight.sum()


def _bits(votes: np.ndarray) -> np.ndarray:
    return (votes[:, None] >> np.arange(VOTERS)) & 1


def fit_label_model(feats: DataFrame, sample: DataFrame) -> LabelModel | None:
    """The patterns of votes, over every document, are at most 2 ** VOTERS rows."""
    seen = feats.groupBy("votes").count().collect()
    votes, weight = np.array([r["votes"] for r in seen], np.int64), np.array([r["count"] for r in seen], float)
    anchors = sample.filter("not gives_terms").select("doc_id", "toxic")
    known = feats.filter("not held_out").select("doc_id", "votes").join(F.broadcast(anchors), "doc_id").groupBy("votes", "toxic").count().collect()
    if not seen or not known:
        return None
    given = np.array([-1] * len(seen) + [int(r["toxic"] > 0) for r in known])
    votes = np.concatenate([votes, np.array([r["votes"] for r in known], np.int64)])
    weight = np.concatenate([weight, np.array([r["count"] for r in known], float)])
    return LabelModel(_bits(votes), weight, given)


def fit_linear(x: list[np.ndarray], patterns: np.ndarray, target: np.ndarray, width: int, rounds: int = 300, l2: float = 1.0) -> tuple[np.ndarray, float]:
    """Logistic regression with soft targets on sparse 0/1 features, by accelerated descent."""
    rows = np.repeat(np.arange(len(x)), [len(a) for a in x])
    cols = np.concatenate(x) if len(x) else np.empty(0, np.int64)
    k = width + patterns.shape[1]
    w, b = np.zeros(k), float(np.log((target.mean() + 1e-4) / (1 - target.mean() + 1e-4)))
    # a step for each feature after how often it occurs, so that rare terms learn as well
    size = np.bincount(cols, minlength=width)[:width]
    size = np.concatenate([size, patterns.sum(axis=0)]) + l2
    speed = np.zeros(k)
    for _ in range(rounds):
        z = b + np.bincount(rows, weights=w[cols], minlength=len(x)) + patterns @ w[width:]
        r = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        g = np.concatenate([np.bincount(cols, weights=r[rows], minlength=width)[:width], patterns.T @ r]) + l2 * w
        speed = 0.8 * speed - 0.5 * g / size
        w += speed
        b -= 0.5 * float(r.mean()) * 4
    return w, b


def score(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED, max_fit: int = MAX_FIT, folds: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, text_key (hash of the text), held_out, score, predicted for every document."""
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), (crc_mod(id_col, folds) == held_out).alias("held_out"), F.col(text_col).alias("text"))
    sample = written(labelled_sample(labels, max_labelled, folds, held_out), "toxic-labels")
    terms = toxic_terms(plain.select("doc_id", "text"), sample.filter("gives_terms").select("doc_id", "toxic"))
    feats = written(features(plain, terms), "toxic-features")
    model = fit_label_model(feats, sample) if terms else None
    if model is None:
        return feats.select("doc_id", "text_key", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    free = feats.filter("not held_out")
    n = free.count()
    # bounded: about max_fit rows of a few numbers each
    fit = free.filter(share_of(F.lit("fit"), F.col("doc_id"), F.col("text_key")) < min(1.0, max_fit / max(n, 1))).select("terms", "votes").toPandas()
    w, b = fit_classifier(model, [np.array(t, np.int64) for t in fit["terms"]], fit["votes"].to_numpy(np.int64), len(terms))
    shared = spark.sparkContext.broadcast((w, b))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, intercept = shared.value
        for batch in batches:
            z = intercept + _bits(batch["votes"].to_numpy(np.int64))[:, -len(PATTERNS) - len(GIVEN_LEXICONS) :] @ weights[len(terms) :]
            z += np.fromiter((weights[np.asarray(t, np.int64)].sum() for t in batch["terms"]), float, len(batch))
            s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "text_key": batch["text_key"], "held_out": batch["held_out"], "score": s, "predicted": (s >= THRESHOLD).astype(np.int32)})

    return feats.mapInPandas(run, "doc_id long, text_key long, held_out boolean, score double, predicted int")


def fit_classifier(model: LabelModel, terms: list[np.ndarray], votes: np.ndarray, width: int) -> tuple[np.ndarray, float]:
    """Weights and intercept learned from the label model's posteriors."""
    bits = _bits(votes)
    return fit_linear(terms, bits[:, LEXICONS:].astype(float), model.posterior(bits), width)


def drop_toxic(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are not predicted toxic, with all their columns, whatever their names."""
    return without(docs, score(docs, labels, id_col=id_col, text_col=text_col).filter("predicted = 1"), id_col, text_col)
