"""Token counts without tokens: heap-and-linked-list byte-pair merging.

A piece starts as one symbol for each byte. A heap holds the adjacent pairs that can merge by (rank, place); the lowest
is popped, checked against the linked list (either side may have gone), merged, and its two new pairs are pushed. The
count is the number of symbols at the start less the number of merges; no identifiers are emitted.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame

from corpusmill.llm.batches import flat_utf8, held_in_worker, keyed_text, map_batches
from corpusmill.llm.vocab import Memo, Vocabulary, piece_utf8, pieces_by, read_vocabulary, vocabulary

#: Pieces of a text that are counted at a time.
PIECES_STEP = 1 << 14
COUNT_SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def merged_count(vocab: Vocabulary, data: bytes) -> int:
    """How many tokens the bytes of one piece become."""
    n = len(data)
    symbols = [vocab.byte_ids[b] for b in data]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    merges, heap = vocab.merges, []
    for i in range(n - 1):
        if found := merges.get((symbols[i], symbols[i + 1])):
            heappush(heap, (found[0], i, symbols[i], symbols[i + 1], found[1]))
    done = 0
    while heap:
        _, i, left, right, whole = heappop(heap)
        j = after[i]
        if symbols[i] != left or j >= n or symbols[j] != right:
            continue
        done += 1
        symbols[i], symbols[j] = whole, -1
        k = after[i] = after[j]
        h = before[i]
        if k < n:
            before[k] = i
            if found := merges.get((whole, symbols[k])):
                heappush(heap, (found[0], i, whole, symbols[k], found[1]))
        if h >= 0 and (found := merges.get((symbols[h], whole))):
            heappush(heap, (found[0], h, symbols[h], whole, found[1]))
    return n - done


class Counter:
    """Counts of texts under one vocabulary, with a bounded memory of piece counts."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab = vocab
        self.memo = Memo(lambda piece: merged_count(vocab, piece_utf8(piece)))

    def count(self, text: str) -> int:
        total = 0
        for k, part in enumerate(self.vocab.segments(text)):
            total += 1 if k % 2 else sum(sum(map(self.memo.__getitem__, some)) for some in pieces_by(part, PIECES_STEP))
        return total


def _counter(data: bytes) -> Counter:
    return held_in_worker(("counter", len(data), hash(data)), lambda: Counter(vocabulary(data)))


def token_counts(df: DataFrame, vocab_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """UTF-8 length, token count and whether it exceeds `limit`, for each row.

    Null and empty texts count 0 tokens; repeated rows are repeated; strings of special tokens count as one token each.
    A map without shuffles; a task holds one Arrow batch and a bounded memo.
    """
    data = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocab_path))

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        counter = _counter(data.value)
        flat, offs = flat_utf8(batch.column(1))
        counts = [counter.count(t) if t else 0 for t in batch.column(1).to_pylist()]
        yield {"doc_id": batch.column(0), "n_bytes": offs[1:] - offs[:-1], "n_tokens": counts, "over_limit": [n > limit for n in counts]}

    return map_batches(keyed_text(df, id_col, text_col), run, COUNT_SCHEMA)
