"""Batches of an ordered stream that are sent when full or when their time is up.

A sender keeps rows until it has ``size`` of them or its deadline comes, sends them, and sets
the deadline ``wait`` after that moment. A deadline that finds nothing to send stays, so the
next row after an idle stretch goes out alone and at once.

Where a batch ends depends on where the last one did, back to the first row. So each range
partition is walked from a guessed state, at first as if a source began there; then from what
its predecessor ended in, where that differs. Ends depend little on starts (a full batch or an
idle stretch forgets all before it), so two or three passes suffice as a rule, and as many as
there are partitions always do. One source with all rows is walked by all tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import fresh
from ..functions.order import placed


@dataclass(frozen=True)
class Sender:
    """What a sender holds after a row: its source, deadline, rows kept, and batches sent so far."""

    source: str | None = None
    deadline: int = 0
    kept: int = 0
    sent: int = 0
    began: bool = False


def walk(sender: Sender, sources: list, times: list[int], size: int, wait: int) -> tuple[Sender, list[int], list[int]]:
    """The sender after the rows, and each row's batch and place in it."""
    source, deadline, kept, sent, began = sender.source, sender.deadline, sender.kept, sender.sent, sender.began
    batch, place = [], []
    for s, at in zip(sources, times, strict=True):
        if not began or s != source:
            source, deadline, kept, sent, began = s, at + wait, 0, 0, True
        elif kept and deadline <= at:
            kept, sent, deadline = 0, sent + 1, deadline + wait
        batch.append(sent)
        place.append(kept)
        kept += 1
        if kept >= size or at >= deadline:
            kept, sent, deadline = 0, sent + 1, at + wait
    return Sender(source, deadline, kept, sent, began), batch, place


def _ends(entries: dict[int, Sender], size: int, wait: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = sender = first = None
        for b in batches:
            if not b.num_rows:
                continue
            if part is None:
                part, first = b.column(0)[0].as_py(), b.column(1)[0].as_py()
                sender = entries.get(part, Sender())
            sender, _, _ = walk(sender, b.column(1).to_pylist(), b.column(2).to_pylist(), size, wait)
        if part is not None:
            row = (part, first, sender.source, sender.deadline, sender.kept, sender.sent)
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=["part", "first", "source", "deadline", "kept", "sent"])

    return run


def _numbers(entries: dict[int, Sender], size: int, wait: int, of: tuple[str, str, str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = None
        for b in batches:
            if not b.num_rows:
                continue
            part, source, at = (b.column(b.schema.get_field_index(c)) for c in of)
            if sender is None:
                sender = entries.get(part[0].as_py(), Sender())
            sender, batch, place = walk(sender, source.to_pylist(), at.to_pylist(), size, wait)
            kept = [(n, b.column(i)) for i, n in enumerate(b.schema.names) if n not in of]
            yield pa.RecordBatch.from_arrays([c for _, c in kept] + [pa.array(batch, pa.int64()), pa.array(place, pa.int64())], names=[n for n, _ in kept] + ["batch", "position"])

    return run


def timed_batches(rows: DataFrame, size: int, wait_us: int, order: list[str], within: str) -> DataFrame:
    """rows with batch (from 0 in each source, the column within) and position in it.

    order: the columns that put a source's rows in order, an instant (timestamp_ntz) first; they
    must tell a source's rows apart. Null sources are one source; rows without an instant have none
    to be sent at and are left out.
    """
    part, source, at = (fresh(rows, c) for c in ("part", "source", "at"))
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(order[0]))
    kept = placed(rows.filter(F.col(order[0]).isNotNull()).withColumns({source: F.col(within).cast("string"), at: us}), [source, *order], part)
    narrow = kept.select(part, source, at)
    entries: dict[int, Sender] = {}
    ends: dict[int, tuple[str | None, Sender]] = {}
    todo = None
    while todo is None or todo:
        asked = narrow if todo is None else narrow.filter(F.col(part).isin(todo))
        for r in asked.mapInArrow(_ends(entries, size, wait_us), "part long, first string, source string, deadline long, kept long, sent long").collect():  # a row a partition
            ends[r["part"]] = r["first"], Sender(r["source"], r["deadline"], r["kept"], r["sent"], True)
        todo, before = [], Sender()
        for p, (first, end) in sorted(ends.items()):
            entry = replace(before, sent=0) if before.began and before.source == first else Sender()
            if entry != entries.get(p, Sender()):
                todo.append(p)
            entries[p], before = entry, end
    # the entries hold; what was sent before is summed along the partitions of a source
    sent = 0
    for p, (_, end) in sorted(ends.items()):
        entry = entries[p]
        entries[p] = replace(entry, sent=sent if entry.began else 0)
        sent = end.sent + (entries[p].sent if entry.began and entry.source == end.source else 0)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name not in (part, source, at))
    return kept.mapInArrow(_numbers(entries, size, wait_us, (part, source, at)), f"{schema}, batch long, position long")
