"""Substring dedup over words with prefix-partitioned suffix trees.

Suffixes are dealt out by a variable-length prefix (an anchor's gram, whole windows for the most frequent ones; see
`repeats`), which keeps each group memory-sized. A group's subtree is built from its sorted suffixes and their longest
common prefixes: an internal node is a maximal run of neighbours with a common prefix of some depth. The nodes at or
below the window's depth are the repeats; a word is removed where a window lies under a node that a document with a
smaller id has too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.batches import flat_utf8, map_batches
from corpusmill.llm.hashing import word_spans
from corpusmill.llm.repeats import NULL_ID, Spec, covered_ranges, keyed, repeated_runs, union_of, with_ranges

WINDOW, GRAM = 50, 8
RESULT_SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


class SuffixTree:
    """A generalised suffix tree of sequences of symbols, as sorted suffixes with common-prefix lengths."""

    def __init__(self, sequences: list[np.ndarray], depth: int) -> None:
        """Suffixes are compared to `depth` symbols; a sequence's end differs from every symbol and every other end."""
        lengths = np.array([len(s) for s in sequences], np.int64)
        self.owner = np.repeat(np.arange(len(sequences)), lengths + 1)
        starts = np.cumsum(lengths + 1) - lengths - 1
        self.place = np.arange(len(self.owner)) - starts[self.owner]
        ends = starts + lengths
        text = np.empty(len(self.owner), np.int64)
        is_end = np.zeros(len(text), bool)
        is_end[ends] = True
        text[~is_end] = np.concatenate(sequences) if sequences else 0
        text[is_end] = np.arange(len(ends)) - len(ends)  # below all symbols
        self.ranks = [np.unique(text, return_inverse=True)[1]]  # of the first 1, 2, 4, ... symbols
        self.reach = [1]
        while self.reach[-1] < depth:
            more = min(self.reach[-1], depth - self.reach[-1])
            self.ranks.append(self._joined(self.ranks[-1], more))
            self.reach.append(self.reach[-1] + more)
        self.sorted = np.argsort(self.ranks[-1], kind="stable")
        self.depth = depth

    @staticmethod
    def _joined(rank: np.ndarray, shift: int) -> np.ndarray:
        later = np.zeros(len(rank), np.int64)
        if shift < len(rank):
            later[:-shift] = rank[shift:] + 1
        return np.unique(rank.astype(np.int64) * (len(rank) + 2) + later, return_inverse=True)[1]

    def common_prefixes(self) -> np.ndarray:
        """Of neighbours in sorted order, up to `depth`; found from the ranks by halving steps."""
        a, b = self.sorted[:-1], self.sorted[1:]
        out = np.zeros(len(a), np.int64)
        n = len(self.sorted)
        for rank, reach in zip(self.ranks[::-1], self.reach[::-1], strict=True):
            i, j = np.minimum(a + out, n - 1), np.minimum(b + out, n - 1)
            ok = (rank[i] == rank[j]) & (out + reach <= self.depth) & (a + out < n) & (b + out < n)
            out[ok] += reach
        return np.minimum(out, self.depth)

    def nodes(self, depth: int) -> np.ndarray:
        """For each suffix in sorted order, the internal node or leaf at `depth` that it hangs under."""
        return np.cumsum(np.r_[True, self.common_prefixes() < depth]) - 1 if len(self.sorted) else self.sorted


def word_index(window: int):
    """Runs of windows that a context of a smaller document has too, by the tree's nodes at the window's depth."""

    def index(doc: np.ndarray, start: np.ndarray, bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        names: dict[bytes, int] = {}
        tree = SuffixTree([np.array([names.setdefault(w, len(names)) for w in body.split(b" ")], np.int64) for body in bodies], window)
        node = tree.nodes(window)
        owner, place = tree.owner[tree.sorted], tree.place[tree.sorted]
        size = np.bincount(tree.owner)[owner] - 1
        full = place + window <= size
        return repeated_runs(doc[owner[full]], node[full], owner[full], place[full])

    return index


def dedup_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, keep_text: bool = False, many: int | None = None) -> DataFrame:
    """Removes words under windows that also start in a document with a smaller id; one row for each input row.

    Null and empty texts have no words. Equal rows with equal ids are one document and get equal results. Texts shorter
    than a window lose nothing. `keep_text` adds the kept words joined by one blank.
    """
    spec = Spec(words=True, window=window, gram=gram, within=False, **({} if many is None else {"many": many}))
    docs = keyed(df, id_col, text_col)
    ranged = with_ranges(docs, covered_ranges(docs, spec, word_index(window)))

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        flat, offs = flat_utf8(batch.column(1))
        starts, ends, first = word_spans(flat, offs)
        data, ranges = flat.tobytes(), batch.column(2).to_pylist()
        removed, digests, texts = [], [], []
        for i in range(batch.num_rows):
            lo, hi = int(first[i]), int(first[i + 1])
            gone, at, kept = 0, lo, []
            for a, b in [*union_of(ranges[i], hi - lo), (hi - lo, hi - lo)]:
                gone += b - a
                if lo + a > at:
                    kept.append(b" ".join(data[s:e] for s, e in zip(starts[at : lo + a].tolist(), ends[at : lo + a].tolist(), strict=True)))
                at = lo + b
            body = b" ".join(kept)
            removed.append(gone)
            digests.append(hashlib.sha256(body).hexdigest())
            if keep_text:
                texts.append(body.decode())
        yield {"doc_id": batch.column(0), "n_words": np.diff(first), "n_removed": removed, "kept_sha256": digests} | ({"kept": texts} if keep_text else {})

    source = ranged.select(F.when(F.col("doc") != NULL_ID, F.col("doc")).alias("doc_id"), "text", "ranges")
    return map_batches(source, run, RESULT_SCHEMA + (", kept string" if keep_text else ""))
