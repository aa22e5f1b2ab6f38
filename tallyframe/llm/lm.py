"""LM scoring: a subword lattice over an existing vocabulary, marginalised over segmentations.

The pieces of a public tokenizer's vocabulary and their scores are given; the scores (merge
ranks) become starting weights. A word is a lattice of all the ways to cut it into pieces;
a forward recursion in log space sums them. Passes of expected counts over the corpus
(forward-backward on each distinct word, weighted by its count) turn the starting weights
into piece probabilities, for each language of the training documents. A word of the
training documents is one more edge, from its start to its end, weighted by its count. A text's probability
is the mixture over languages of the product over its words and its end, so a document's
own language column is never an input of its score.

The corpus is counted once, per task, then by word. Every distinct word's lattice is summed
once, in the table of words, and not once for each document. The most frequent words
(``FREQUENT``, a fixed number) are held by every task with their values; only the rarer
words of a document are joined with the table, on the word, so no key is hot.

A character that no piece holds is spelled in bytes, each a 256th of the byte piece. Words
of one length are summed side by side; a word of more than ``LONG_WORD`` characters is
walked by itself, ``CHUNK`` characters at a time, over all its segmentations as well.

The whole-word edges can be left out (``word_edges``): the lattice of pieces alone then
carries the score.

Defined results: null and empty texts hold the end token alone; an empty table gives no
rows; repeated rows and null ids are scored each by itself; documents without a language
train the pooled language, as do those of a language with less than ``LANGUAGE_SHARE`` of the
training text; without any training document weights stay the starting ones.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache
from itertools import compress, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, written

MARK = "▁"
#: Held by every task: at most this many words with their counts and log probabilities.
FREQUENT = 100_000
#: A language with this share of the training text or more has models of its own; so at most
#: 1 / LANGUAGE_SHARE languages have, and the text of all others is one more.
LANGUAGE_SHARE = 0.001
#: Held by every task at most: log probabilities of frequent words, a column for each language.
FREQUENT_CELLS = 1_000_000
LONG_WORD, CHUNK = 64, 4096
FLUSH_WORDS = 300_000
#: Words of the table that a task sums together.
GATHERED = 60_000
HASH_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Cells of the lattices that are summed at once.
LATTICE_CELLS = 1 << 21
#: Expected-count passes over the table of words, and the prior count that a piece keeps.
PASSES, PRIOR = 2, 0.05
LOG10 = math.log(10.0)


class Vocabulary:
    """Pieces with starting log weights: a Zipf law over the vocabulary's own ranks.

    Substrings are looked up by a 64-bit hash, in a sorted table for each length.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        usable = [(sp.id_to_piece(i), -sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)) and -sp.get_score(i) < 1e8]
        self.byte, self.end = len(usable), len(usable) + 1
        self.size = len(usable) + 2
        rank = np.array([r for _, r in usable] + [len(usable), 1.0])
        weight = 1.0 / (rank + 10.0)
        self.start = np.log(weight / weight.sum())
        by_length: dict[int, list[int]] = {}
        for i, (p, _) in enumerate(usable):
            by_length.setdefault(len(p), []).append(i)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n, ids in by_length.items():
            h = np.zeros(len(ids), np.uint64)
            for c in code_points([usable[i][0] for i in ids], n).T:
                h = h * HASH_BASE + c
            order = np.argsort(h)
            self.tables[n] = h[order], np.array(ids, np.int32)[order]


def code_points(words: list[str], n: int) -> np.ndarray:
    """(words, n): the code points of words of n characters."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), n).astype(np.uint64)


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _lattices(words: list[str], v: Vocabulary) -> Iterator[tuple[np.ndarray, dict[int, np.ndarray], np.ndarray]]:
    """Words of one length at a time: their numbers; for each piece length that occurs the piece
    that starts at each place (-1: none); and the UTF-8 bytes of each character. Arrays are
    (places, words), so that a place of all words lies together."""
    groups: dict[int, list[int]] = {}
    for at, w in enumerate(words):
        groups.setdefault(len(w), []).append(at)
    for n, every in groups.items():
        step = max(1, LATTICE_CELLS // (n * min(n, max(v.tables))))
        for rows in (np.array(every[i : i + step]) for i in range(0, len(every), step)):
            chars = np.ascontiguousarray(code_points([words[i] for i in rows], n).T)
            h = np.zeros_like(chars)
            pieces = {1: np.full(chars.shape, -1)}
            for size in range(1, min(n, max(v.tables)) + 1):
                h = h[: n - size + 1] * HASH_BASE + chars[size - 1 :]
                if size in v.tables:
                    keys, ids = v.tables[size]
                    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                    found = keys[at] == h
                    if found.any():
                        pieces[size] = np.where(found, ids[at], -1)
            yield rows, pieces, 1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000)


def _weights(pieces: dict[int, np.ndarray], sizes: np.ndarray, logp: np.ndarray, v: Vocabulary) -> dict[int, np.ndarray]:
    """Log weights of the edges; a character without a piece is its bytes, each a 256th of one."""
    out = {n: np.where(p >= 0, logp[p], -np.inf) for n, p in pieces.items()}
    out[1] = np.where(pieces[1] >= 0, out[1], sizes * (logp[v.byte] - math.log(256)))
    return out


def _log_sum(terms: list[np.ndarray]) -> np.ndarray:
    t = np.stack(terms)
    top = t.max(axis=0)
    return top + np.log(np.exp(t - top).sum(axis=0))


def _forward(w: dict[int, np.ndarray], n: int) -> list[np.ndarray]:
    """alpha[j]: log probability of the first j characters over all their segmentations."""
    alpha = [np.zeros(w[1].shape[1])]
    for j in range(1, n + 1):
        alpha.append(_log_sum([alpha[j - size] + w[size][j - size] for size in w if size <= j]))
    return alpha


def _long_edges(chars: np.ndarray, lo: int, hi: int, lp: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, hi - lo): log weights and pieces of the edges that start at lo .. hi - 1."""
    most = max(v.tables)
    near = chars[lo : min(len(chars), hi + most)].astype(np.uint64)
    weight, piece = np.full((most, hi - lo), -np.inf), np.full((most, hi - lo), -1)
    h = np.zeros(hi - lo, np.uint64)
    for size in range(1, most + 1):
        k = min(hi - lo, len(near) - size + 1)
        if k <= 0:
            break
        h = h[:k] * HASH_BASE + near[size - 1 : size - 1 + k]
        if size in v.tables:
            keys, ids = v.tables[size]
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            p = np.where(keys[at] == h, ids[at], -1)
            piece[size - 1, :k], weight[size - 1, :k] = p, np.where(p >= 0, lp[p], -np.inf)
    c = near[: hi - lo]
    spelled = (1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)) * (lp[v.byte] - math.log(256))
    weight[0] = np.where(piece[0] >= 0, weight[0], spelled)
    return weight, piece


def long_forward(chars: np.ndarray, lp: np.ndarray, v: Vocabulary) -> np.ndarray:
    """alpha of one word: each place passes its sum on to the places that its edges reach."""
    n, most = len(chars), max(v.tables)
    alpha = np.full(n + most + 1, -np.inf)
    alpha[0] = 0.0
    for lo in range(0, n, CHUNK):
        hi = min(n, lo + CHUNK)
        weight, _ = _long_edges(chars, lo, hi, lp, v)
        for i, w in enumerate(weight.T, lo):
            alpha[i + 1 : i + 1 + most] = np.logaddexp(alpha[i + 1 : i + 1 + most], alpha[i] + w)
    return alpha[: n + 1]


def long_uses(chars: np.ndarray, lp: np.ndarray, v: Vocabulary) -> np.ndarray:
    """Expected uses of each piece in one word, from its end to its start."""
    n, most = len(chars), max(v.tables)
    alpha = long_forward(chars, lp, v)
    beta = np.full(n + most + 1, -np.inf)
    beta[n] = 0.0
    total = np.zeros(v.size)
    for lo in range((n - 1) // CHUNK * CHUNK, -1, -CHUNK):
        hi = min(n, lo + CHUNK)
        weight, piece = _long_edges(chars, lo, hi, lp, v)
        for i in range(hi - 1, lo - 1, -1):
            t = weight[:, i - lo] + beta[i + 1 : i + 1 + most]
            beta[i] = t.max() + math.log(np.exp(t - t.max()).sum())
        after = np.lib.stride_tricks.sliding_window_view(beta[lo + 1 : hi + most], most).T
        uses = np.exp(alpha[lo:hi] + weight + after - alpha[n])
        held = piece >= 0
        total += np.bincount(piece[held], weights=uses[held], minlength=v.size)
        c = chars[lo:hi]
        total[v.byte] += (uses[0] * (1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)))[~held[0]].sum()
    return total


def _by_length(words: list[str]) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Places of the words that are summed side by side, and the long ones with their characters."""
    usual = np.array([i for i, w in enumerate(words) if len(w) <= LONG_WORD], np.int64)
    return usual, [(i, code_points([w], len(w))[0]) for i, w in enumerate(words) if len(w) > LONG_WORD]


def log_marginals(words: list[str], logp: np.ndarray, v: Vocabulary) -> np.ndarray:
    """(words, languages): log probability of each word over all its segmentations."""
    out = np.zeros((len(words), len(logp)))
    usual, long = _by_length(words)
    for rows, pieces, sizes in _lattices([words[i] for i in usual], v):
        for k, lp in enumerate(logp):
            out[usual[rows], k] = _forward(_weights(pieces, sizes, lp, v), len(sizes))[-1]
    for i, chars in long:
        out[i] = [long_forward(chars, lp, v)[-1] for lp in logp]
    return out


def expected_counts(words: list[str], counts: np.ndarray, lp: np.ndarray, v: Vocabulary) -> np.ndarray:
    """(languages, pieces): expected uses of each piece, given (words, languages) counts."""
    total = np.zeros((counts.shape[1], v.size))
    usual, long = _by_length(words)
    for i, chars in long:
        total += counts[i][:, None] * long_uses(chars, lp, v)
    counts = counts[usual]
    for rows, pieces, sizes in _lattices([words[i] for i in usual], v):
        n, w = len(sizes), _weights(pieces, sizes, lp, v)
        alpha = np.array(_forward(w, n))
        beta = [np.zeros(len(rows))]  # beta[-1 - i]: of what follows the first i characters
        for i in range(n - 1, -1, -1):
            beta.append(_log_sum([beta[n - i - size] + w[size][i] for size in w if size <= n - i]))
        after = np.array(beta[::-1]) - alpha[n]
        pieces_of, uses_of, words_of_them = [], [], []
        for size, p in pieces.items():
            place, row = np.nonzero((p >= 0) | (size == 1))
            piece = p[place, row]
            uses = np.exp(alpha[place, row] + w[size][place, row] + after[place + size, row])
            if size == 1:
                spelled = piece < 0
                piece, uses = np.where(spelled, v.byte, piece), np.where(spelled, uses * sizes[place, row], uses)
            pieces_of.append(piece)
            uses_of.append(uses)
            words_of_them.append(row)
        piece, uses, row = np.concatenate(pieces_of), np.concatenate(uses_of), np.concatenate(words_of_them)
        for k in range(counts.shape[1]):
            n_k = counts[rows, k]
            if n_k.any():
                total[k] += np.bincount(piece, weights=uses * n_k[row], minlength=v.size)
    return total


def gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches of the table of words put together, so that more words of one length are summed at once."""
    held, rows, chars = [], 0, 0
    for b in batches:
        held.append(b)
        rows, chars = rows + len(b), chars + b["word"].str.len().sum()
        if rows >= GATHERED or chars >= GATHERED * 16:
            yield pd.concat(held, ignore_index=True)
            held, rows, chars = [], 0, 0
    if held:
        yield pd.concat(held, ignore_index=True)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split()


def corpus_counts(docs: DataFrame, langs: list[str]) -> DataFrame:
    """word, n_0 .. n_K, held_out: training uses by language (the last pools the rest), and other uses.

    Every word has a row. The empty word stands for the ends of training texts.
    """
    place = {x: i for i, x in enumerate(langs)}
    names = [*(f"n_{i}" for i in range(len(langs) + 1)), "held_out"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[Counter] = [Counter() for _ in names]

        def flush() -> Iterator[pd.DataFrame]:
            every = list(set().union(*held))
            for at in range(0, len(every), 50_000):
                some = every[at : at + 50_000]
                yield pd.DataFrame({"word": pd.Series([w.decode() for w in some], dtype=object)} | {c: np.fromiter(map(h.get, some, repeat(0)), np.int64, len(some)) for c, h in zip(names, held, strict=True)})
            for h in held:
                h.clear()

        for b in batches:
            for text, lang, train in zip(b["text"], b["lang"], b["train"], strict=True):
                words = words_of(text)
                if train:
                    h = held[place.get(lang, len(langs))]
                    h.update(words)
                    h[b""] += 1
                else:
                    held[-1].update(words)
            if sum(map(len, held)) >= FLUSH_WORDS:
                yield from flush()
        yield from flush()

    got = docs.mapInPandas(run, ", ".join(["word string", *(f"{c} long" for c in names)]))
    return got.groupBy("word").agg(*(F.sum(c).alias(c) for c in names))


def piece_log_probabilities(words: DataFrame, names: list[str], vocabulary_path: Callable[[], str]) -> np.ndarray:
    """(languages, pieces) log probabilities from PASSES passes of expected counts.

    The segmentations of a word are weighed by the pieces of all languages together, and its
    expected pieces are counted for each language. What a task sends is a table of the fixed
    vocabulary, and so is what the driver gets.
    """
    v = vocabulary(vocabulary_path())
    pooled = v.start
    n = np.zeros((len(names), v.size))
    trained = words.filter(sum((F.col(c) for c in names[1:]), F.col(names[0])) > 0).select("word", *names)
    for _ in range(PASSES):
        now = words.sparkSession.sparkContext.broadcast(pooled)

        def run(batches: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
            voc = vocabulary(vocabulary_path())
            total = np.zeros((len(names), voc.size))
            for b in gathered(batches):
                counts = b[names].to_numpy(float)
                total[:, voc.end] += counts[(b["word"] == "").to_numpy()].sum(axis=0)
                filled = (b["word"] != "").to_numpy()
                total += expected_counts([MARK + w for w in b["word"] if w], counts[filled], now.value, voc)
            k, piece = np.nonzero(total)
            yield pd.DataFrame({"k": k, "piece": piece, "n": total[k, piece]})

        n[:] = 0.0
        for r in trained.mapInPandas(run, "k int, piece int, n double").groupBy("k", "piece").agg(F.sum("n").alias("n")).collect():
            n[r["k"], r["piece"]] = r["n"]
        every = n.sum(axis=0) + PRIOR * v.size * np.exp(v.start)
        pooled = np.log(every / every.sum())
    # each language leans on the pieces of all, and all on the vocabulary's own weights
    mixed = n + PRIOR * 1_000 * np.exp(pooled)
    return np.log(mixed / mixed.sum(axis=1, keepdims=True))


def word_values(words: DataFrame, names: list[str], logp: np.ndarray, used: np.ndarray, distinct: np.ndarray, vocabulary_path: Callable[[], str], word_edges: bool = True) -> DataFrame:
    """word, c, uses, lp_0 .. lp_K: its natural log probability in each language; uses: in all rows.

    used and distinct: training tokens, and different ones, by language. The lattice's
    pieces get the share of new words among tokens (Witten-Bell), the whole-word edges the rest.
    """
    now = words.sparkSession.sparkContext.broadcast(logp)
    known = used / np.maximum(used + distinct, 1.0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        voc = vocabulary(vocabulary_path())
        for b in gathered(batches):
            lp = np.zeros((len(b), len(names)))
            lp[(b["word"] != "").to_numpy()] = log_marginals([MARK + w for w in b["word"] if w], now.value, voc)
            lp[(b["word"] == "").to_numpy()] = now.value[:, voc.end]
            with np.errstate(divide="ignore"):
                whole = np.log(known * b[names].to_numpy(float) / np.maximum(used, 1.0))
            if word_edges:
                lp = np.logaddexp(whole, lp + np.log1p(-known))
            c = b[names].to_numpy().sum(axis=1)
            yield pd.DataFrame({"word": b["word"].astype(object), "c": c, "uses": c + b["held_out"].to_numpy()} | {f"lp_{i}": x for i, x in enumerate(lp.T)})

    return words.mapInPandas(run, ", ".join(["word string, c long, uses long", *(f"lp_{i} double" for i in range(len(names)))]))


def score(docs: DataFrame, vocabulary_path: Callable[[], str], *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5, held_out_fold: int = 1, word_edges: bool = True) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every document."""
    spark = docs.sparkSession
    held_out = crc_mod(id_col, folds) == held_out_fold
    plain = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), held_out.alias("held_out"))
    by = written(plain.filter("not held_out").groupBy("lang").agg(F.count("*").alias("count"), F.sum(F.length("text")).alias("chars")), "languages")
    chars = by.agg(F.sum("chars")).first()[0] or 0
    langs = [r[0] for r in by.filter((F.col("chars") > 0) & (F.col("chars") >= LANGUAGE_SHARE * chars)).orderBy(F.desc("count"), "lang").collect()]
    names = [f"n_{i}" for i in range(len(langs) + 1)]
    words = written(corpus_counts(plain.select("text", "lang", (~F.col("held_out")).alias("train")), langs), "words")
    c = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    sums = words.agg(F.coalesce(F.sum(c), F.lit(0)).alias("N"), F.count_if(c > 0).alias("V"), *(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names), *(F.count_if(F.col(n) > 0).alias(f"d{n}") for n in names)).first()
    n_train, distinct = sums["N"], sums["V"]
    share = np.array([sums[n] for n in names], float)
    log_share = np.log((share + 1.0) / (share + 1.0).sum())
    logp = piece_log_probabilities(words, names, vocabulary_path)
    values = written(word_values(words, names, logp, share, np.array([sums[f"d{n}"] for n in names], float), vocabulary_path, word_edges), "word-values")
    base_of = lambda count: np.log10((count + 0.5) / (n_train + 0.5 * (distinct + 1)))

    lps = [f"lp_{i}" for i in range(len(names))]
    # an eighth of an octave of counts to a bin, so a few hundred bins whatever the corpus
    bins = values.groupBy(F.floor(F.log2("uses") * 8).cast("int").alias("bin")).count().collect()
    least, room = None, min(FREQUENT, FREQUENT_CELLS // len(names))
    for r in sorted(bins, key=lambda r: -r["bin"]):
        room -= r["count"]
        if room < 0:
            break
        least = r["bin"]
    often = values.filter(F.floor(F.log2("uses") * 8) >= least) if least is not None else values.limit(0)
    top = often.collect()  # FREQUENT rows at most
    frequent = spark.sparkContext.broadcast(({r["word"].encode(): i for i, r in enumerate(top)}, np.array([r["c"] for r in top], np.int64), np.array([[r[x] for x in lps] for r in top], float).reshape(len(top), len(names))))
    end = values.filter("word = ''").first()
    end_c, end_lp = (end["c"], np.array([end[x] for x in lps])) if end else (0, np.full(len(names), math.log(0.5)))
    k_sums = [f"s_{i}" for i in range(len(names))]

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row of sums over its frequent words for each document, a row for each rarer word."""
        index, cs, lp = frequent.value
        base, known = base_of(cs), cs > 0
        for b in batches:
            rows: list[tuple] = []
            of_row, of_word, times_rare = [], [], []
            for row, doc_id, held, text in zip(b["row"], b["doc_id"], b["held_out"], b["text"], strict=True):
                counts = Counter(words_of(text))
                at = np.fromiter(map(index.get, counts, repeat(-1)), np.int64, len(counts))
                n = np.fromiter(counts.values(), np.int64, len(counts))
                cached = at >= 0
                i, t = at[cached], n[cached]
                if len(i) < len(at):
                    few = ~cached
                    rare = list(compress(counts, few.tolist()))
                    of_row.append(np.full(len(rare), row))
                    of_word.extend(w.decode() for w in rare)
                    times_rare.append(n[few])
                rows.append((row, doc_id, held, int(n.sum()) + 1, int(t[known[i]].sum()) + (end_c > 0), float(t @ base[i] + base_of(end_c)), *(t @ lp[i] + end_lp)))
                if len(of_word) >= 200_000:
                    yield pd.DataFrame({"row": np.concatenate(of_row), "word": pd.Series(of_word, dtype=object), "n": np.concatenate(times_rare)})
                    of_row, of_word, times_rare = [], [], []
            yield pd.DataFrame(rows, columns=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", *k_sums])
            if of_word:
                yield pd.DataFrame({"row": np.concatenate(of_row), "word": pd.Series(of_word, dtype=object), "n": np.concatenate(times_rare)})

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        types = {"doc_id": "Int64", "held_out": "boolean", "n": "Int64", "n_tokens": "Int64", "n_known": "Int64"}
        for b in split(batches):
            yield b.reindex(columns=["row", "doc_id", "held_out", "word", "n", "n_tokens", "n_known", "base", *k_sums]).astype(types | {"word": object} | dict.fromkeys(("base", *k_sums), "float64"))

    numbered = plain.withColumn("row", F.monotonically_increasing_id())
    schema = "row long, doc_id long, held_out boolean, word string, n long, n_tokens long, n_known long, base double, " + ", ".join(f"{s} double" for s in k_sums)
    cut = written(numbered.select("row", "doc_id", "held_out", "text").mapInPandas(whole, schema), "document-words")
    asked = cut.filter("word is not null").select("row", "word", "n").join(values, "word")
    rare = asked.select("row", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"), F.lit(0).cast("long").alias("n_tokens"), F.when(F.col("c") > 0, F.col("n")).otherwise(0).alias("n_known"), (F.col("n") * F.log10((F.col("c") + 0.5) / (n_train + 0.5 * (distinct + 1)))).alias("base"), *((F.col("n") * F.col(lps[i])).alias(s) for i, s in enumerate(k_sums)))
    both = rare.unionByName(cut.filter("word is null").select(*rare.columns))
    # a document has one row with its id, and one for each rarer word
    sums_of = both.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), *(F.sum(x).alias(x) for x in rare.columns[3:]))
    terms = [F.col(s) + float(w) for s, w in zip(k_sums, log_share, strict=True)]
    most = F.greatest(*terms) if len(terms) > 1 else terms[0]
    total = (most + F.log(sum((F.exp(t - most) for t in terms[1:]), F.exp(terms[0] - most)))) / LOG10
    return sums_of.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), total.alias("score"))
