"""Substring dedup over bytes by merging Burrows-Wheeler transforms.

Contexts (see `repeats`) are split into shards. Each shard's suffixes are sorted once for its transform; the shards'
transforms are then merged without sorting suffixes again: an interleave says which shard each row of the merged
transform comes from. It starts as shard after shard and is refined by one stable pass over the merged symbols at a
time; after t passes it is the order by the first t bytes, and where two neighbouring rows first part in pass t, their
longest common prefix is t - 1. After W passes, rows not yet parted share W bytes: these intervals are the repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.batches import flat_utf8, map_batches
from corpusmill.llm.repeats import NULL_ID, Spec, covered_ranges, keyed, repeated_runs, union_of, with_ranges

WINDOW, GRAM = 100, 32
#: Bytes of a shard.
SHARD_BYTES = 1 << 17
RESULT_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


class Shard:
    """The transform of some strings: sorted suffixes, the symbol before each, and the row of the suffix one longer.

    Symbols are bytes plus one, 0 ends a string; UTF-8 has no byte above 0xF4, so a symbol is a byte too. Ends are
    ordered by their strings.
    """

    #: Bytes of the first ranking; the number of a string that ends within them follows.
    LEAD = 5

    def __init__(self, strings: list[bytes]) -> None:
        lengths = np.array([len(s) for s in strings], np.int64)
        ends = np.cumsum(lengths + 1) - 1
        self.owner = np.repeat(np.arange(len(strings)), lengths + 1)
        self.place = np.arange(len(self.owner)) - (ends - lengths)[self.owner]
        n = len(self.owner)
        left = lengths[self.owner] - self.place  # bytes up to the end
        text = np.zeros(n + self.LEAD, np.uint64)
        text[:n][left > 0] = np.frombuffer(b"".join(strings), np.uint8).astype(np.uint64) + np.uint64(1)
        key = np.zeros(n, np.uint64)
        for k in range(self.LEAD):
            key = key << np.uint64(8) | np.where(left > k, text[k : k + n], 0).astype(np.uint64)
        key = key << np.uint64(24) | np.where(left < self.LEAD, self.owner + 1, 0).astype(np.uint64)
        rank, reach = _dense(key), self.LEAD
        while rank.max(initial=0) < n - 1:
            later = np.zeros(n, np.int64)
            later[:-reach] = rank[reach:] + 1
            rank = _dense(rank * (n + 2) + later)
            reach *= 2
        self.suffixes = np.argsort(rank)
        self.strings = len(strings)
        whole = self.place[self.suffixes] == 0
        self.symbols = np.where(whole, 0, text[self.suffixes - 1]).astype(np.uint8)
        self.longer = np.where(whole, 0, rank[self.suffixes - 1]).astype(np.int32)


def _dense(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    by = key[order]
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(np.r_[False, by[1:] != by[:-1]])
    return out


def merge(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the merged transform: its shard, its row there, and the common prefix with the row above (at most depth)."""
    sizes = np.array([len(s.suffixes) for s in shards])
    base = np.cumsum(sizes) - sizes
    symbols = np.concatenate([s.symbols for s in shards])
    longer = np.concatenate([s.longer + np.int32(b) for s, b in zip(shards, base, strict=True)])
    # Rows of string ends come first, shard by shard, and stay there.
    fixed = np.concatenate([np.arange(b, b + s.strings, dtype=np.int32) for s, b in zip(shards, base, strict=True)])
    ends = len(fixed)
    rows = np.arange(len(symbols), dtype=np.int32)  # the interleave: shard after shard at first
    common = np.full(len(rows), depth, np.int16)
    parted = np.zeros(len(rows), bool)
    klass = np.zeros(len(rows), np.int32)
    fresh = np.ones(len(rows), bool)
    for t in range(1, depth + 1):
        merged = symbols[rows]
        order = np.argsort(merged, kind="stable")[ends:]
        symbol, prefix = merged[order], klass[order]
        rows[ends:] = longer[rows[order]]
        rows[:ends] = fixed
        np.not_equal(symbol[1:], symbol[:-1], out=fresh[ends + 1 :])
        fresh[ends + 1 :] |= prefix[1:] != prefix[:-1]
        common[fresh & ~parted] = t - 1
        parted |= fresh
        np.cumsum(fresh, out=klass)
    shard = np.searchsorted(base, rows, side="right") - 1
    return shard, rows - base[shard], common


def repeated_intervals(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (numbered shard after shard) that share `depth` bytes with another, and their interval's number.

    The refinement of `merge`, without blocks that are settled: a row parted from both neighbours keeps its place, and
    so do all that lead to it, so only rows in intervals of two and more go on to the next pass.
    """
    base = np.cumsum([0, *(len(s.suffixes) for s in shards)])
    symbols = np.concatenate([s.symbols for s in shards])
    longer = np.concatenate([s.longer + np.int32(b) for s, b in zip(shards, base, strict=False)])
    rows, klass = np.arange(len(symbols), dtype=np.int32), np.zeros(len(symbols), np.int32)
    for _ in range(depth):
        symbol = symbols.take(rows)
        order = np.argsort(symbol, kind="stable")
        order = order[np.count_nonzero(symbol == 0) :]
        symbol, prefix = symbol.take(order), klass.take(order)
        fresh = np.ones(len(order) + 1, bool)
        fresh[1:-1] = (symbol[1:] != symbol[:-1]) | (prefix[1:] != prefix[:-1])
        open_ = ~(fresh[:-1] & fresh[1:])
        rows = longer.take(rows.take(order[open_]))
        klass = np.cumsum(fresh[:-1][open_], dtype=np.int32)
    return rows, klass - 1


def byte_index(window: int, shard_bytes: int = SHARD_BYTES):
    """Runs of windows that stand earlier too, by the merged transform's intervals at the window's depth."""

    def index(doc: np.ndarray, start: np.ndarray, bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shards, firsts, at = [], [], 0
        while at < len(bodies):
            end, size = at, 0
            while end < len(bodies) and (end == at or size + len(bodies[end]) <= shard_bytes):
                size += len(bodies[end])
                end += 1
            shards.append(Shard(bodies[at:end]))
            firsts.append(at)
            at = end
        rows, interval = repeated_intervals(shards, window)
        base = np.cumsum([0, *(len(s.suffixes) for s in shards)])
        shard = np.searchsorted(base, rows, side="right") - 1
        suffix = np.concatenate([s.suffixes for s in shards])[rows] + base[shard]
        owner = np.concatenate([s.owner + f for s, f in zip(shards, firsts, strict=True)])[suffix]
        place = np.concatenate([s.place for s in shards])[suffix]
        at = start[owner] + place
        by = np.lexsort((at, doc[owner]))
        new = np.ones(len(by), bool)
        new[1:] = (doc[owner[by]][1:] != doc[owner[by]][:-1]) | (at[by][1:] != at[by][:-1])
        order = np.empty(len(by), np.int64)
        order[by] = np.cumsum(new)
        return repeated_runs(order, interval, owner, place)

    return index


def dedup_bytes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, keep_text: bool = False, many: int | None = None, keep: tuple[Column, ...] = ()) -> DataFrame:
    """Removes bytes under windows that also start earlier (smaller id, or the same document); one row for each input row.

    Null and empty texts have no bytes. Equal rows with equal ids are one document and get equal results. Texts shorter
    than a window lose nothing. `keep_text` adds the text of the remaining bytes; characters of which a part would go
    stay whole there. `keep` are further columns of the rows.
    """
    spec = Spec(words=False, window=window, gram=gram, within=True, **({} if many is None else {"many": many}))
    docs = keyed(df, id_col, text_col, *keep)
    ranged = with_ranges(docs, covered_ranges(docs.select("doc", "th", "text"), spec, byte_index(window)))
    more = docs.schema.fields[3:]

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        flat, offs = flat_utf8(batch.column(1))
        data, ranges = flat.tobytes(), batch.column(2).to_pylist()
        removed, spans, digests, texts = [], [], [], []
        for i in range(batch.num_rows):
            body = data[offs[i] : offs[i + 1]]
            gone = union_of(ranges[i], len(body))
            removed.append(sum(b - a for a, b in gone))
            spans.append(len(gone))
            digests.append(hashlib.sha256(_without(body, gone)).hexdigest())
            if keep_text:
                texts.append(_without(body, whole_characters(body, gone)).decode())
        yield {"doc_id": batch.column(0), "n_bytes": np.diff(offs), "n_removed": removed, "n_spans": spans, "kept_sha256": digests} | ({"kept": texts} if keep_text else {}) | {f.name: batch.column(3 + k) for k, f in enumerate(more)}

    source = ranged.select(F.when(F.col("doc") != NULL_ID, F.col("doc")).alias("doc_id"), "text", "ranges", *[f"`{f.name}`" for f in more])
    return map_batches(source, run, RESULT_SCHEMA + (", kept string" if keep_text else "") + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in more))


def _without(body: bytes, gone: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for span in gone for x in span), len(body)]
    return b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def whole_characters(body: bytes, gone: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans without the characters that they only cut into."""
    out = []
    for a, b in gone:
        while a < b and body[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(body) and body[b] & 0xC0 == 0x80:
            b -= 1
        out.append((a, b))
    return out
