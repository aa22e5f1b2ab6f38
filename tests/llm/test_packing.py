from __future__ import annotations

import struct
import zlib
from collections import Counter, defaultdict

import public_tokenizers
from tokenizers import Tokenizer

from tallyframe.llm import packing
from tallyframe.llm.queries import tokenizer_path
from tallyframe.llm.tokens import ChunkIds, text_ids

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_chunked_ids_are_the_tokenizers_own():
    whole, ids = Tokenizer.from_file(PATH), ChunkIds(PATH)
    texts = ["It's I'LL we've 12ab3 _x_ ¿qué? naïve Straße ß ĳ ǅ İstanbul ΣΑΣ ſ K", "a<|startoftext|>b", "x" * 99, "½² é ́a\u200b\x1c\x85b", "\U0001f600 中文字 ؀"]
    for t in texts:
        want = whole.encode(t, add_special_tokens=False).ids
        assert text_ids(t, ids) == struct.pack(f"<{len(want)}I", *want), t


def test_every_id_lies_in_one_piece_and_windows_have_no_gap(spark, docs):
    whole = Tokenizer.from_file(PATH)
    rows = packing.pack(docs, tokenizer_path, buffer_tokens=4096, step_tokens=4096).collect()
    want = Counter()
    for d in docs.select("doc_id", "text").collect():
        ids = whole.encode(d["text"] or "", add_special_tokens=False).ids + [1]
        want[(d["doc_id"], tuple(ids))] += 1
    pieces = defaultdict(list)
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"] > 0
        pieces[r["doc_id"], r["doc_tokens"]].append(r)
    for (doc_id, n), group in pieces.items():
        copies = [ids for (i, ids), c in want.items() if i == doc_id and len(ids) == n for _ in range(c)]
        assert sum(r["length"] for r in group) == n * len(copies)
        for r in group:
            got = struct.unpack(f"<{r['length']}I", r["ids"])
            assert any(ids[r["start"] : r["start"] + r["length"]] == got for ids in copies)
    assert {k[0] for k in pieces} == {i for i, _ in want}
    windows = defaultdict(list)
    for r in rows:
        windows[r["sequence_id"]].append(r)
    padded = 0
    for group in windows.values():
        at = 0
        for r in sorted(group, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= group[0]["tier"] and len({r["step_group"] for r in group}) == 1
        padded += at < group[0]["tier"]
    assert padded <= 3  # one for each task at most


def test_step_groups_hold_one_tier_and_like_loads(spark):
    many = spark.createDataFrame([(i, "word " * (37 * i % 900)) for i in range(400)], "doc_id long, text string").coalesce(1)
    rows = packing.pack(many, tokenizer_path, step_tokens=8192).collect()
    tiers, loads = defaultdict(set), defaultdict(int)
    for r in rows:
        tiers[r["step_group"]].add(r["tier"])
        loads[r["step_group"]] += r["length"]
    assert all(len(t) == 1 for t in tiers.values())
    assert max(loads.values()) <= 8192 + 2048
    assert len({t for s in tiers.values() for t in s}) > 1  # several tiers are in use


def test_digest_and_empty(spark, docs, no_docs):
    for r in packing.digest(packing.pack(docs, tokenizer_path)).filter("doc_id = 3").collect():
        assert r["ids_crc32"] == zlib.crc32(struct.pack("<I", 1)) and r["doc_tokens"] == 1
    assert packing.pack(no_docs, tokenizer_path).count() == 0
