"""Hierarchical packing of token ids into windows of several lengths.

Each task streams its share of the documents, so texts and ids are never shuffled:

1. a document's ids (with an end id) are cut into whole windows of the longest tier; the
   rest is routed to the shortest tier that holds it;
2. tiers are packed from the longest to the shortest: a rest opens a window of its tier,
   and the gap is filled with the longest rests of shorter tiers that fit; where none fits
   the longest rest at hand is cut, so that windows are full to the last id;
3. full windows are dealt to step groups of equal token counts, one tier to a group, in
   serpentine order of their attention cost (sum of squared piece lengths).

A window has the length of its tier (a power of two) and is full. Only the last few ids of
a task, fewer than the shortest tier, sit in a window that is padded to the longest one.
Memory is bounded by ``buffer_tokens`` and the open step groups. Window and group numbers
carry the task's partition number, so a task that is run again gives the same rows; the
input should be a file scan or sorted, so that its partitions do not change on a retry.

Defined results: null and empty texts pack their end id alone; repeated rows and null ids
are packed each by itself; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import struct
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import chunk_ids, text_ids

TIERS = (2048, 1024, 512, 256)
END_ID = 1
#: Ids that a task gathers before it packs them, and ids of one training step.
BUFFER_TOKENS = 1 << 20
STEP_TOKENS = 1 << 16
#: Step groups of a tier that are filled side by side, for balance.
GROUPS_AT_ONCE = 4
PIECE_SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class Packer:
    """Packs documents as they come; emits (piece..., sequence, offset, tier, group) rows."""

    def __init__(self, part: int, tiers: tuple[int, ...] = TIERS, buffer_tokens: int = BUFFER_TOKENS, step_tokens: int = STEP_TOKENS) -> None:
        self.tiers, self.buffer_tokens, self.step_tokens = sorted(tiers, reverse=True), buffer_tokens, step_tokens
        self.base, self.windows, self.groups, self.serial = part << 40, 0, 0, 0
        self.rests: list[tuple[int, int]] = []  # (length, key) in order
        self.held: dict[int, tuple] = {}  # key -> doc_id, start, ids, doc_tokens
        self.tokens = 0
        self.closed: dict[int, list] = {t: [] for t in self.tiers}

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[tuple]:
        n, top = len(ids) // 4, self.tiers[0]
        for start in range(0, n, top):
            piece = ids[4 * start : 4 * (start + top)]
            if len(piece) == 4 * top:
                yield from self._close(top, [(doc_id, start, piece, n)])
            else:
                self._hold(doc_id, start, piece, n)
        if self.tokens >= self.buffer_tokens:
            yield from self._pack(self.tiers[0] * 8)

    def finish(self) -> Iterator[tuple]:
        yield from self._pack(self.tiers[0])
        for tier in self.tiers:
            while self.tokens >= tier:
                yield from self._close(tier, self._fill(tier, []))
        if self.tokens:
            yield from self._close(self.tiers[0], self._fill(self.tokens, []))
        for tier in self.tiers:
            yield from self._deal(tier, 1)

    def _hold(self, doc_id: int | None, start: int, ids: bytes, n: int) -> None:
        self.serial += 1
        insort(self.rests, (len(ids) // 4, self.serial))
        self.held[self.serial] = (doc_id, start, ids, n)
        self.tokens += len(ids) // 4

    def _take(self, at: int) -> tuple:
        length, key = self.rests.pop(at)
        self.tokens -= length
        return self.held.pop(key)

    def _fill(self, gap: int, pieces: list[tuple]) -> list[tuple]:
        """Fills a gap that is no larger than what is held: best fit, then a cut."""
        while gap:
            at = bisect_right(self.rests, (gap, self.serial)) - 1
            if at >= 0:
                piece = self._take(at)
            else:
                doc_id, start, ids, n = self._take(len(self.rests) - 1)
                piece = (doc_id, start, ids[: 4 * gap], n)
                self._hold(doc_id, start + gap, ids[4 * gap :], n)
            pieces.append(piece)
            gap -= len(piece[2]) // 4
        return pieces

    def _pack(self, leave: int) -> Iterator[tuple]:
        """Packs windows from the longest tier down, while more than leave ids are held."""
        while self.tokens > leave:
            longest = self.rests[-1][0]
            tier = min(t for t in self.tiers if t >= longest)
            yield from self._close(tier, self._fill(tier - longest, [self._take(len(self.rests) - 1)]))

    def _close(self, tier: int, pieces: list[tuple]) -> Iterator[tuple]:
        cost = sum((len(p[2]) // 4) ** 2 for p in pieces)
        self.closed[tier].append((cost, self.windows, pieces))
        self.windows += 1
        if len(self.closed[tier]) >= GROUPS_AT_ONCE * (self.step_tokens // tier):
            yield from self._deal(tier, GROUPS_AT_ONCE)

    def _deal(self, tier: int, groups: int) -> Iterator[tuple]:
        """Serpentine dealing of a tier's closed windows, the costliest first."""
        done, self.closed[tier] = sorted(self.closed[tier], key=lambda w: (-w[0], w[1])), []
        if not done:
            return
        groups = max(groups, -(-len(done) * tier // self.step_tokens))
        for i, (_, window, pieces) in enumerate(done):
            lap, at = divmod(i, groups)
            group = self.groups + (groups - 1 - at if lap % 2 else at)
            offset = 0
            for doc_id, start, ids, n in pieces:
                yield doc_id, start, len(ids) // 4, ids, n, self.base + window, offset, tier, self.base + group
                offset += len(ids) // 4
        self.groups += groups


def pack(docs: DataFrame, tokenizer_path: str | Callable[[], str], *, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, tiers: tuple[int, ...] = TIERS, buffer_tokens: int = BUFFER_TOKENS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row per piece, with its ids as little-endian unsigned 32-bit integers (PIECE_SCHEMA).

    tokenizer_path is read on the executors: a path there, or a function that gives one.
    """
    names = [x.split()[0] for x in PIECE_SCHEMA.split(", ")]
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = chunk_ids(tokenizer_path() if callable(tokenizer_path) else tokenizer_path)
        packer = Packer(TaskContext.get().partitionId(), tiers, buffer_tokens, step_tokens)
        rows: list[tuple] = []
        frame = lambda: pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                rows += packer.add(None if pd.isna(doc_id) else int(doc_id), text_ids(text, ids) + end)
                if len(rows) >= 8_000:
                    yield frame()
                    rows.clear()
        rows += packer.finish()
        yield frame()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, PIECE_SCHEMA)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with the crc32 of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")
