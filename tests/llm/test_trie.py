"""Prefix trie of conversations against a plain dictionary of prefixes."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tallyframe.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, id string, n long, head string, level long"


def plain(rows):
    out = defaultdict(list)
    for c, *turn in rows:
        if c is not None:
            out[c].append(turn)
    order = lambda t: (t[0] is not None, t[0] or 0, t[1] or "")
    return {c: [(r or "", x or "") for _, r, x in sorted(ts, key=order)] for c, ts in out.items()}


def rebuilt(convs):
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in convs}
    return {c: convs.get(c - c % 100, [])[: h[c]] + ts[h[c] :] for c, ts in convs.items()}


def slow(convs):
    members = defaultdict(list)
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    below = {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        kids = children[p]
        below[p] = (sum(below[k][0] for k in kids) or 1, own + sum(below[k][1] for k in kids))
    end = lambda p: ",".join(str(c) for c in sorted(c for c in members[p] if len(convs[c]) == len(p)))
    return sorted(
        [(min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]), *below[p], hashlib.sha256(end(p).encode()).hexdigest()) for p in members], key=str
    )


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], SCHEMA).repartition(3)


def fast(turns, **how):
    return sorted([tuple(r) for r in trie.prefix_trie(*turns, **how).collect()], key=str)


def crowd():
    """Copies, shared starts of many lengths, chains, ends at branchings."""
    draw, rows = random.Random(5), []
    shared = [("user", f"shared {i}") for i in range(40)]
    for c in range(150):
        ts = shared[: draw.choice([0, 1, 2, 7, 8, 9, 30])] + [("assistant", draw.choice("ab")) for _ in range(draw.randrange(4))] + [("user", f"own {c}")] * draw.randrange(2)
        rows += [(c, i, *t) for i, t in enumerate(ts)]
    return rows + [(c, i, *t) for c in range(200, 280) for i, t in enumerate(shared[:35])]


AWKWARD = [
    (1, 2, "user", "b"), (1, None, "system", "first"), (1, 0, None, "a"), (2, 0, None, "a"), (2, None, "system", "first"), (3, 5, "", ""), (3, 6, None, None), (4, 5, None, None), (4, 5, None, None),
    (5, 1, "user", "x" * 100_000), (5, 2, "u", "ser"), (6, 1, "user", "x" * 100_000), (6, 2, "us", "er"), (None, 0, "user", "left out"), (None, None, None, None), (-7, 0, "é", "\U0001f600\U0001f600"), (8, 0, "é", "\U0001f600\U0001f600"),
]


@pytest.mark.parametrize("how", [{"container": 30}, {"segment": 12, "container": 5}])
def test_trie_against_a_dictionary_of_prefixes(spark, how):
    rows = crowd()
    assert fast(trie.turns_of(frame(spark, rows)), **how) == slow(plain(rows))


def test_trie_of_rebuilt_conversations(spark):
    rows = [(c + 100 * k, i, "user", f"{c} {i}") for k in (0, 2, 7) for c in (0, 3, 4, 5, 50) for i in range(c % 5 * 2 + 1)] + [(c, 0, "u", "only") for c in (901, 902, 903, 904, 905)]
    want = rebuilt(plain(rows))
    assert any(not ts for ts in want.values())
    assert fast(trie.rebuilt_turns(frame(spark, rows))) == slow(want)


def test_nulls_ties_repeats_and_long_texts(spark):
    assert fast(trie.turns_of(frame(spark, AWKWARD))) == slow(plain(AWKWARD))
    assert fast(trie.rebuilt_turns(frame(spark, [r for r in AWKWARD if r[0] != -7]))) == slow(rebuilt(plain([r for r in AWKWARD if r[0] != -7])))


def test_no_conversations_and_one(spark):
    assert fast(trie.rebuilt_turns(frame(spark, []))) == []
    assert fast(trie.turns_of(frame(spark, [(None, 1, "a", "b")]))) == []
    assert fast(trie.turns_of(frame(spark, [(9, 1, "a", "b")]))) == slow(plain([(9, 1, "a", "b")]))


def test_one_conversation_with_half_of_all_rows_and_one_said_by_most(spark, monkeypatch):
    monkeypatch.setattr(trie, "LISTED", 7)
    rows = [(1, i, "user", str(i % 3)) for i in range(900)] + [(2, i, "user", str(i % 3)) for i in range(870)] + [(c, i, "user", f"said {i}") for c in range(10, 310) for i in range(2)]
    assert fast(trie.turns_of(frame(spark, rows)), segment=64, container=200) == slow(plain(rows))
