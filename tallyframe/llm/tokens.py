"""Token ids of the word-level BPE, cached by white-space chunk.

The tokenizer never joins characters across ASCII white space, so a text's ids are the ids
of its chunks, one after the other. Chunks repeat, so each task looks most of them up.
"""

from __future__ import annotations

import re
import struct
import unicodedata
from functools import cache

#: Chunks kept in a worker's cache; it is emptied when full.
CACHE_CHUNKS = 600_000

#: Latin text only; the rest goes through the whole tokenizer.
PLAIN = re.compile(r"[!-~¡-¬®-ɏ]+")
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\w\s]|_)+")
#: Characters that Python and the tokenizer sort or lower-case differently, or special tokens.
ODD = re.compile(r"[ª²³¹º¼-¾İŉǄ-ǌǰǱ-ǳ]|<\||\|>")


def _byte_chars() -> list[str]:
    """Byte-level BPE's printable stand-in for each byte."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, nxt = [], 256
    for b in range(256):
        out.append(chr(b if b in keep else nxt))
        nxt += b not in keep
    return out


class ChunkIds(dict):
    """chunk (UTF-8 bytes) -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.chars = _byte_chars()

    def __missing__(self, chunk: bytes) -> bytes:
        if len(self) >= CACHE_CHUNKS:
            self.clear()
        text = chunk.decode()
        if len(text) <= 64 and PLAIN.fullmatch(text) and not ODD.search(text):
            ids = self._plain(text)
        else:
            ids = self.whole.encode(text, add_special_tokens=False).ids
        got = struct.pack(f"<{len(ids)}I", *ids)
        if len(chunk) <= 64:
            self[chunk] = got
        return got

    def _plain(self, text: str) -> list[int]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        out, chars = [], self.chars
        # contractions, runs of letters, single digits, runs of anything else
        for piece in PIECES.findall(text.lower()):
            out += [t.id for t in self.model.tokenize("".join([chars[b] for b in piece.encode()]))]
        return out


@cache
def chunk_ids(path: str) -> ChunkIds:
    """One cache for each Python worker and vocabulary."""
    return ChunkIds(path)


def text_ids(text: str | None, ids: ChunkIds) -> bytes:
    return b"".join([ids[c] for c in text.encode("utf-8", "replace").split()]) if text else b""
