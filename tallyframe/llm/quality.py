"""Quality rules: repetition and symbol counts, and divergence from language references.

A language reference is two histograms over every document of that language: shares of
character classes, and shares of its most common words (all other words are one more bin).
Words are lower-cased (ASCII). A document is compared with each reference by Jensen-Shannon
distance; the nearest one counts, of equally near ones that of the language with most words
(then the first by name). Short documents are not judged by divergence (``MIN_CHARS``, ``MIN_WORDS``), since
their histograms say little, nor are documents whose own language has no reference.

Counting the corpus is one pass that sends per-task sums of distinct words; judging is a
second pass without a shuffle.

Defined results: null and empty texts have no words, so they fail the base rule; documents
without a language are counted under the empty name; an empty table gives no rows;
repeated rows and null ids are judged each by itself; a reference needs ``MIN_REFERENCE``
words, and without one for a document's language the verdict is that of the base rule.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

CLASSES = ("lower", "upper", "digit", "space", "line", "stop", "quote", "symbol", "bracket", "mark", "control", "other")
SYMBOLS = "#*$%&|<>"
COMMON_WORDS = 100
MIN_REFERENCE = 1_000
MIN_CHARS, MIN_WORDS = 200, 50
#: Largest Jensen-Shannon distances (base 2, 0 to 1), as floor + slope / sqrt(words): what
#: chance alone adds to the distance of a histogram falls with the root of its counts.
CLASS_LIMIT, WORD_LIMIT = (0.22, 0.6), (0.36, 1.6)
FLUSH_WORDS = 400_000
DIGEST_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, language string, class_distance double, word_distance double"


def _class_table() -> np.ndarray:
    """Class of each byte; bytes inside a multi-byte character have none."""
    t = np.full(256, CLASSES.index("mark"))
    for name, chars in (("lower", "abcdefghijklmnopqrstuvwxyz"), ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("digit", "0123456789"), ("space", " \t"), ("line", "\n\r\v\f"), ("stop", ".,;:!?"), ("quote", "'\"`"), ("symbol", SYMBOLS), ("bracket", "()[]{}")):
        t[[ord(c) for c in chars]] = CLASSES.index(name)
    t[[*range(9), *range(14, 32), 127]] = CLASSES.index("control")
    t[128:192] = len(CLASSES)
    t[192:] = CLASSES.index("other")
    return t


CLASS_OF = _class_table()


def class_counts(raw: bytes) -> np.ndarray:
    return np.bincount(CLASS_OF[np.frombuffer(raw, np.uint8)], minlength=len(CLASSES) + 1)[: len(CLASSES)]


def repeated_words(words: list[bytes], n: int = 8) -> int:
    """Words inside n-word windows (n a power of two) that occur twice or more."""
    if len(words) <= n:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    if len(numbers) > len(words) - 1:
        return 0
    step = 1
    while step < n:  # ids of windows of twice the length, exact at each step
        pairs = ids[:-step] * (len(words) + 1) + ids[step:]
        ids = np.unique(pairs, return_inverse=True)[1]
        step *= 2
    twice = np.bincount(ids)[ids] > 1
    if not twice.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def dup_lines(text: str) -> int:
    seen: set[str] = set()
    n = 0
    for line in text.split("\n"):
        if line.strip(" \t\r\v\f"):
            n += line in seen
            seen.add(line)
    return n


def js_distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row by row; a bin that is zero on both sides adds nothing."""
    m = (p + q) / 2
    part = lambda a: (a * np.log2(np.divide(a, m, out=np.ones_like(m), where=a > 0))).sum(axis=1)
    return np.sqrt(np.maximum(0.0, (part(p) + part(q)) / 2))


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    return float(js_distances(p[None], q[None])[0])


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per-task sums: (lang, word or class, count); classes are told by the prefix."""
    words: dict[str, Counter] = {}
    classes: dict[str, np.ndarray] = {}

    def flush() -> pd.DataFrame:
        rows = [(lang, "w", w.decode("utf-8", "replace"), n) for lang, c in words.items() for w, n in c.items()]
        rows += [(lang, "c", CLASSES[i], int(n)) for lang, c in classes.items() for i, n in enumerate(c) if n]
        words.clear()
        classes.clear()
        return pd.DataFrame(rows, columns=["lang", "kind", "what", "n"])

    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            raw = text.encode("utf-8", "replace")
            classes[lang] = classes.get(lang, 0) + class_counts(raw)
            words.setdefault(lang, Counter()).update(raw.lower().split())
        if sum(map(len, words.values())) >= FLUSH_WORDS:
            yield flush()
    yield flush()


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, tuple[np.ndarray, dict[bytes, int], np.ndarray]]:
    """For each language with MIN_REFERENCE words: class shares, its common words, their shares.

    The driver gets at most COMMON_WORDS + classes counts a language.
    """
    plain = docs.select(F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts = written(plain.mapInPandas(_count, "lang string, kind string, what string, n long").groupBy("lang", "kind", "what").agg(F.sum("n").alias("n")), "quality-counts")
    known = counts.filter("kind = 'w'").groupBy("lang").agg(F.sum("n").alias("total")).filter(F.col("total") >= MIN_REFERENCE)
    known = written(known, "quality-languages")
    totals = known.orderBy(F.desc("total"), "lang").collect()
    classes: dict[str, np.ndarray] = {}
    for lang, what, n in counts.filter("kind = 'c'").join(known, "lang").select("lang", "what", "n").collect():
        classes.setdefault(lang, np.zeros(len(CLASSES)))[CLASSES.index(what)] = n
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "what"))
    # Spark keeps each task's first COMMON_WORDS of a language before the shuffle
    common = counts.filter("kind = 'w'").withColumn("place", place).filter(F.col("place") <= COMMON_WORDS).join(known, "lang")
    top: dict[str, list] = {}
    for r in sorted(common.select("lang", "what", "n", "place").collect(), key=lambda r: r["place"]):
        top.setdefault(r["lang"], []).append(r)
    out = {}
    for lang, total in totals:
        shares = np.array([r["n"] for r in top[lang]] + [0], float)
        shares[-1] = total - shares.sum()
        out[lang] = (classes[lang] / classes[lang].sum(), {r["what"].encode(): i for i, r in enumerate(top[lang])}, shares / total)
    return out


class Stacked:
    """All references as matrices, a language a row, with one index of all their words."""

    def __init__(self, refs: dict[str, tuple[np.ndarray, dict[bytes, int], np.ndarray]]) -> None:
        self.langs = list(refs)
        self.classes = np.array([classes for classes, _, _ in refs.values()])
        width = max(len(words) for _, _, words in refs.values())
        self.words = np.zeros((len(refs), width))
        self.bins: dict[bytes, list[tuple[int, int]]] = {}
        for row, (_, index, words) in enumerate(refs.values()):
            # other words lie in the last column whatever the number of common ones
            self.words[row, : len(words) - 1], self.words[row, -1] = words[:-1], words[-1]
            for w, i in index.items():
                self.bins.setdefault(w, []).append((row, i))

    def nearest(self, raw: bytes, words: list[bytes]) -> tuple[str, float, float]:
        """The nearest reference, by the mean of both distances."""
        classes = class_counts(raw).astype(float)
        h = np.zeros_like(self.words)
        for w, n in Counter(words).items():
            for at in self.bins.get(w, ()):
                h[at] = n
        h[:, -1] = len(words) - h.sum(axis=1)
        by_class = js_distances(np.broadcast_to(classes / classes.sum(), self.classes.shape), self.classes)
        by_word = js_distances(h / len(words), self.words)
        best = int(np.argmin(by_class + by_word))
        return self.langs[best], float(by_class[best]), float(by_word[best])


def judge(docs: DataFrame, refs: dict, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", class_limit: tuple[float, float] = CLASS_LIMIT, word_limit: tuple[float, float] = WORD_LIMIT) -> DataFrame:
    """One row per document: base counts, verdict, nearest language and both distances."""
    names = [x.split()[0] for x in DIGEST_SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stacked = Stacked(refs) if refs else None
        for batch in batches:
            rows = []
            for doc_id, text, own in zip(batch["doc_id"], batch["text"], batch["lang"], strict=True):
                text = text or ""
                raw = text.encode("utf-8", "replace")
                words = raw.split()
                n, repeats = len(words), repeated_words(words)
                blanks = sum(raw.count(c) for c in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r"))
                failed = n < 20 or 100 * repeats > 30 * n
                lang = by_class = by_word = None
                if stacked and own in refs and n >= MIN_WORDS and len(text) >= MIN_CHARS:
                    lang, by_class, by_word = stacked.nearest(raw, raw.lower().split())
                kept = not failed and (lang is None or all(d <= floor + slope / n**0.5 for d, (floor, slope) in ((by_class, class_limit), (by_word, word_limit))))
                rows.append((doc_id, n, len(text) - blanks, sum(text.count(c) for c in SYMBOLS), dup_lines(text), repeats, failed, kept, lang, by_class, by_word))
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64", "class_distance": "float64", "word_distance": "float64"})

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang")).mapInPandas(run, DIGEST_SCHEMA)
