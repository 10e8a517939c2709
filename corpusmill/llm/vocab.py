"""Byte-level BPE vocabularies and the split of text into the pieces within which pairs merge."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cached_property
from itertools import islice

import numpy as np
import regex

from corpusmill.llm.batches import held_in_worker

#: The split before the merges, as the byte-level tokenizers define it; white space is Unicode's property.
_WS = r"\t-\r \x85\xa0  -     　"
#: The alternatives that start differently stand in the order of their frequency.
_ANY = regex.compile(rf" ?\p{{L}}+|'(?:[stmd]|re|ve|ll)| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: The same over Latin-1 bytes, for texts that have no character beyond U+00FF.
_L = rb"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_N = rb"0-9\xb2\xb3\xb9\xbc-\xbe"
_W = rb"\t-\r \x85\xa0"
_LATIN = re.compile(rb" ?[%b]+|'(?:[stmd]|re|ve|ll)| ?[%b]+| ?[^%b%b%b]+|[%b]+(?![^%b])|[%b]+" % (_L, _N, _W, _L, _N, _W, _W, _W))


def pieces(text: str) -> list[bytes] | list[str]:
    """Pieces as Latin-1 bytes where the text allows it, else as strings; both are keys for `piece_utf8`."""
    try:
        return _LATIN.findall(text.encode("latin-1"))
    except UnicodeEncodeError:
        return _ANY.findall(text)


def pieces_by(text: str, n: int) -> Iterator[list[bytes] | list[str]]:
    """The same pieces, at most `n` at a time of a long text."""
    if len(text) <= 4 * n:
        yield pieces(text)
        return
    found = _LATIN.finditer(text.encode("latin-1")) if max(text) <= "\xff" else _ANY.finditer(text)
    while some := [m.group() for m in islice(found, n)]:
        yield some


def piece_utf8(piece: bytes | str) -> bytes:
    return piece.decode("latin-1").encode() if isinstance(piece, bytes) else piece.encode()


def _byte_of_symbol() -> dict[str, int]:
    """Vocabulary files write each byte as one printable character: itself if it is printable Latin-1, else from U+0100 on."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Ids, ranks of merges, and strings that are tokens of their own."""

    def __init__(self, data: bytes) -> None:
        spec = json.loads(data)
        byte = _byte_of_symbol()
        as_bytes = lambda s: bytes(map(byte.__getitem__, s))
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens") or ()}
        self.ids = {as_bytes(s): i for s, i in spec["model"]["vocab"].items() if s not in self.special}
        self.strings = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        self.byte_ids = [self.ids[bytes([b])] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.born = {i: -1 for i in self.byte_ids}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = (as_bytes(x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            a, b, whole = self.ids[left], self.ids[right], self.ids[left + right]
            self.merges.setdefault((a, b), (rank, whole))
            self.parts.setdefault(whole, (a, b))
            self.born.setdefault(whole, rank)
        #: Tokens that merging can give: bytes and what merges make.
        self.merged = {b: i for b, i in self.ids.items() if i in self.born}
        self.longest = max(map(len, self.merged))
        #: By the last three bytes: how long tokens with that end are, longest first.
        ends: dict[bytes, set[int]] = {}
        for token in self.merged:
            if len(token) > 2:
                ends.setdefault(token[-3:], {2, 1}).add(len(token))
        self.lengths_by_end = {end: tuple(sorted(x, reverse=True)) for end, x in ends.items()}
        size = max(self.strings) + 1
        self.lengths = [len(self.strings.get(i, b"")) for i in range(size)]
        self.flat_strings = np.frombuffer(b"".join(self.strings.get(i, b"") for i in range(size)), np.uint8), np.cumsum([0, *(len(self.strings.get(i, b"")) for i in range(size))])
        self._special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    @cached_property
    def endings(self) -> list[tuple[tuple[int, int], ...]]:
        """For each token that merging can give: (length, token) of itself and of all such tokens that it ends with, longest first."""
        out: list[tuple[tuple[int, int], ...]] = [()] * len(self.lengths)
        for token in sorted(self.merged, key=len):
            shorter = next((x for k in range(1, len(token)) if (x := self.merged.get(token[k:])) is not None), None)
            own = self.merged[token]
            out[own] = ((len(token), own), *(out[shorter] if shorter is not None else ()))
        return out

    def segments(self, text: str) -> list[str]:
        """Ordinary text and special strings in turn; special strings stand at odd places."""
        if not self._special_split or not any(s in text for s in self.special):
            return [text]
        return self._special_split.split(text)


def vocabulary(data: bytes) -> Vocabulary:
    """Parsed once in each Python worker, until the worker does something else."""
    return held_in_worker(("vocabulary", len(data), hash(data)), lambda: Vocabulary(data))


def read_vocabulary(path: str) -> bytes:
    """The file's bytes, read on the driver and sent to the workers with the task (about 1.5 MB, whatever the data)."""
    with open(path, "rb") as f:
        return f.read()


class Memo(dict):
    """What `of(piece)` gave for recent pieces: two generations of at most `limit` pieces, so memory stays bounded."""

    def __init__(self, of, limit: int = 120_000, longest: int = 64) -> None:
        super().__init__()
        self.of, self.limit, self.longest = of, limit, longest
        self.older: dict = {}

    def __missing__(self, piece):
        value = self.older.pop(piece, None)
        if value is None:
            value = self.of(piece)
        if len(piece) <= self.longest:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[piece] = value
        return value
