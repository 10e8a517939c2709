"""Packed token-id matrices: best-fit decreasing with a segment tree over free capacities.

Texts become ids; a text longer than a row is split into whole rows and a rest, so nothing is lost. Within a bounded
buffer of one partition the rests are sorted by falling length and each goes to the open row with the least free room
that still holds it, which the segment tree over capacities finds in log(capacity) steps. A packed row carries its ids
(padded), the cumulative lengths of its segments, which text and which part of it each segment is, the position that each
segment restarts from, and the position of every id (resets at each segment; 0 on padding).
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from corpusmill.llm.batches import held_in_worker, keyed_text, map_stream

CAPACITY = 2048
#: Tokens that a buffer holds before it is packed (a longer single text is a buffer of its own).
BUFFER_TOKENS = 1 << 21
PACK_SCHEMA = "doc_ids array<long>, parts array<int>, cu_seqlens array<int>, position_starts array<int>, n_tokens int, n_segments int, ids binary, positions binary"


class FreeRoom:
    """Open bins by free capacity; the tree's nodes count the bins below them."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, which: int) -> None:
        self.bins[room].append(which)
        at = room + self.size
        while at:
            self.tree[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The bin with the least room of `need` at least; the one opened last among equals."""
        tree, at = self.tree, need + self.size
        if not tree[at]:
            while at > 1 and (at & 1 or not tree[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if tree[2 * at] else 2 * at + 1
        room = at - self.size
        while at:
            tree[at] -= 1
            at >>= 1
        return room, self.bins[room].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers; items of the same length stay in order."""
    room, bins = FreeRoom(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = room.take(lengths[i])
        if found is None:
            found = capacity, len(bins)
            bins.append([])
        left, which = found
        bins[which].append(i)
        if left > lengths[i]:
            room.put(left - lengths[i], which)
    return bins


def pack(texts: list[tuple[int | None, np.ndarray]], capacity: int, pad: int, dtype: str, carry_positions: bool) -> dict[str, list]:
    """Packed rows of (id, token ids) pairs; texts without tokens take no room and stand in no row."""
    segments = []
    for key, ids in texts:
        for part, at in enumerate(range(0, len(ids), capacity)):
            segments.append((key, part, ids[at : at + capacity], at if carry_positions else 0))
    out: dict[str, list] = {x.split()[0]: [] for x in PACK_SCHEMA.split(", ")}
    for bin_ in best_fit_decreasing([len(s[2]) for s in segments], capacity):
        chosen = [segments[i] for i in bin_]
        row = np.full(capacity, pad, dtype)
        lengths = [len(s[2]) for s in chosen]
        total = sum(lengths)
        row[:total] = np.concatenate([s[2] for s in chosen])
        out["doc_ids"].append([s[0] for s in chosen])
        out["parts"].append([s[1] for s in chosen])
        out["cu_seqlens"].append(np.cumsum([0, *lengths]).tolist())
        out["position_starts"].append([s[3] for s in chosen])
        out["n_tokens"].append(total)
        out["n_segments"].append(len(chosen))
        out["ids"].append(row.tobytes())
        out["positions"].append(positions(out["cu_seqlens"][-1], out["position_starts"][-1], capacity).tobytes())
    return out


def positions(cu_seqlens: list[int], position_starts: list[int], capacity: int) -> np.ndarray:
    """Position ids of a packed row (32-bit): each segment counts on from its start, padding is 0."""
    edges, out = np.array(cu_seqlens), np.zeros(capacity, "<i4")
    out[: edges[-1]] = np.arange(edges[-1]) + np.repeat(np.array(position_starts, np.int64) - edges[:-1], np.diff(edges))
    return out


def encoding(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    """Parsed once in each Python worker, until the worker does something else."""

    def parsed() -> tiktoken.Encoding:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        return tiktoken.Encoding("corpusmill", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    return held_in_worker(("encoding", len(ranks), hash(ranks), pattern), parsed)


def packed_rows(df: DataFrame, ranks_path: str, pattern: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, carry_positions: bool = False, buffer_tokens: int = BUFFER_TOKENS) -> DataFrame:
    """With `carry_positions` a later part of a split text counts on where the part before it ended, else from 0.

    Token-id rows of `capacity`, each text followed by `end_id`, rows filled up with `end_id`.

    Null texts count as empty and give one end token, so every input row stands in the result; repeated rows are
    repeated. A partition is packed in buffers on its own, without a shuffle; every id keeps its place in its text.
    """
    with open(ranks_path, "rb") as f:  # under 1 MB
        sent = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        enc, held, size = encoding(sent.value, pattern), [], 0
        width = "<u2" if max(enc.max_token_value, end_id) < 1 << 16 else "<u4"
        end = np.array([end_id], width)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for i, text in enumerate(batch.column(1)):
                ids = np.concatenate([enc.encode_to_numpy(text.as_py() or "", disallowed_special=()).astype(width), end])
                held.append((keys[i], ids))
                size += len(ids)
                if size >= buffer_tokens:
                    yield pack(held, capacity, end_id, width, carry_positions)
                    held, size = [], 0
        if held:
            yield pack(held, capacity, end_id, width, carry_positions)

    return map_stream(keyed_text(df, id_col, text_col), run, PACK_SCHEMA)
