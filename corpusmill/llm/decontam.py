"""Benchmark decontamination with SimHash windows and multi-index Hamming blocks.

Words are runs of ASCII letters and digits and of non-ASCII bytes, A-Z lower-cased; shingles are five words; of a text
or item of fewer words, all of them are its one shingle. A shingle weighs ln(1 + N / df) among all N items that have words
(df at least 1), however many passes they take. For each item size there are windows of as many words at every place of a
text; a text of fewer words than the item is one window as a whole. A window's weighted SimHash has 64 bits; the items' hashes are cut into RADIUS + 1 blocks, of which two
hashes within the radius must share one (pigeonhole), so the block tables give every item within the radius. Their exact
weighted Jaccard similarity with the window decides.

What a window shares with an item weighs at least the similarity times the item's own weight. Windows whose item
shingles weigh less than that for every item of their size are passed over before they are hashed, which rules out
nothing that the exact test would take.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.batches import array_of, keyed_text, map_batches, slices
from corpusmill.llm.hashing import LOWER, gram_hashes, in_one_text, word_hashes, word_spans

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 20
#: Items and characters in one pass over the texts; more take further passes, with the same weights.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 16_000_000
NOT_WORD = np.ones(256, bool)
NOT_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = False
MATCH_SCHEMA = "doc_id long, item_id long, similarity double, first_word int, n_words int, distance int"


def shingles_of(flat: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """Hashes of all runs of SHINGLE words of a slice, each text's first word, and the one shingle of each short text."""
    flat = LOWER[flat]
    starts, ends, first = word_spans(flat, offs, NOT_WORD)
    words = word_hashes(flat, starts, ends)
    sizes = np.diff(first)
    short = {i: gram_hashes(words[first[i] : first[i + 1]], int(sizes[i])) for i in np.flatnonzero((sizes > 0) & (sizes < SHINGLE)).tolist()}
    return gram_hashes(words, SHINGLE), first, short


def own_shingles(text: int, grams: np.ndarray, first: np.ndarray, short: dict[int, np.ndarray]) -> np.ndarray:
    """The shingles of one text of a slice, in order."""
    return short.get(text, grams[int(first[text]) : max(int(first[text]), int(first[text + 1]) - SHINGLE + 1)])


def simhash(shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted SimHash of each row of shingles."""
    bits = (shingles[..., None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    score = np.where(bits.astype(bool), weights[..., None], -weights[..., None]).sum(axis=-2)
    return ((score > 0).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=-1, dtype=np.uint64)


@dataclass
class Weights:
    """Shingle weights of a whole benchmark: of those that items share, and the one weight of all others (df 1)."""

    shared: np.ndarray  # sorted
    weight: np.ndarray
    rare: float

    @staticmethod
    def of(n: int, shared: np.ndarray, df: np.ndarray) -> Weights:
        order = np.argsort(shared)
        return Weights(shared[order], np.log(1 + n / df[order]), float(np.log(1 + max(1, n))))


@dataclass
class Items:
    """Benchmark items by size, with the benchmark's shingle weights and the block tables of their hashes."""

    ids: list[int | None]
    sets: list[np.ndarray]  # sorted distinct shingles
    among: Weights
    known: np.ndarray = field(init=False)
    sizes: dict[int, list[int]] = field(default_factory=dict)
    tables: dict[int, list[dict[int, list[int]]]] = field(default_factory=dict)
    own: np.ndarray = field(init=False)  # total weight of each item
    hashes: np.ndarray = field(init=False)
    blocks: list[tuple[np.uint64, np.uint64]] = field(init=False)

    @staticmethod
    def of(rows: list[tuple[int | None, str]], among: Weights | None = None) -> Items:
        """Items of these rows; without `among`, the rows are the whole benchmark."""
        ids, sets, sizes, lists = [], [], {}, []
        for key, text in rows:
            data = np.frombuffer((text or "").encode(), np.uint8)
            grams, first, short = shingles_of(data, np.array([0, len(data)]))
            grams = short.get(0, grams)
            if not len(grams):
                continue  # no words, so nothing that a text could hold
            sizes.setdefault(int(first[-1]), []).append(len(ids))
            ids.append(key)
            lists.append(grams)
            sets.append(np.unique(grams))
        known, df = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, int))
        out = Items(ids, sets, among or Weights.of(len(ids), known[df > 1], df[df > 1]), sizes=sizes)
        out.known = known
        out.own = np.array([out.weights(x).sum() for x in sets])
        out.hashes = np.array([simhash(g[None], out.weights(g)[None])[0] for g in lists], np.uint64)
        edges = np.linspace(0, 64, RADIUS + 2).astype(int)
        out.blocks = [(np.uint64(a), np.uint64((1 << int(b - a)) - 1)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        for size, members in sizes.items():
            tables: list[dict[int, list[int]]] = []
            for shift, mask in out.blocks:
                table: dict[int, list[int]] = {}
                for i in members:
                    table.setdefault(int((out.hashes[i] >> shift) & mask), []).append(i)
                tables.append(table)
            out.tables[size] = tables
        return out

    def weights(self, grams: np.ndarray) -> np.ndarray:
        """Weights of shingles; those of no item weigh as one that a single item has."""
        w = self.among
        if not len(w.shared):
            return np.full(len(grams), w.rare)
        at = np.minimum(np.searchsorted(w.shared, grams), len(w.shared) - 1)
        return np.where(w.shared[at] == grams, w.weight[at], w.rare)

    def are_known(self, grams: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.zeros(len(grams), bool)
        at = np.minimum(np.searchsorted(self.known, grams), len(self.known) - 1)
        return self.known[at] == grams

    def near(self, size: int, hash_: np.uint64) -> list[int]:
        """All items of this size within the radius."""
        found = {i for table, (shift, mask) in zip(self.tables[size], self.blocks, strict=True) for i in table.get(int((hash_ >> shift) & mask), ())}
        return [i for i in sorted(found) if int(self.hashes[i] ^ hash_).bit_count() <= RADIUS]

    def similarity(self, item: int, window: np.ndarray) -> float:
        common = self.weights(np.intersect1d(self.sets[item], window)).sum()
        union = self.weights(np.union1d(self.sets[item], window)).sum()
        return float(common / union)


def matches_in(grams: np.ndarray, first: np.ndarray, short: dict[int, np.ndarray], items: Items, similarity: float) -> Iterator[tuple[int, int, float, int, int, int]]:
    """(text, item, similarity, first word, words, distance) of each item's best window in each text of a slice."""
    if not len(items.ids):
        return
    for text, own in short.items():  # a text's one shingle is like an item of the same one only
        size, hash_ = int(first[text + 1] - first[text]), simhash(own[None], items.weights(own)[None])[0]
        for item in items.near(size, hash_) if size in items.sizes else ():
            if items.similarity(item, own) >= similarity:
                yield text, items.ids[item], items.similarity(item, own), 0, size, int(items.hashes[item] ^ hash_).bit_count()
    if not len(grams):
        return
    inside = in_one_text(first, SHINGLE)
    known = items.are_known(grams) & inside
    counts = np.cumsum(np.r_[0, known])
    least = {size: similarity * min(items.own[i] for i in members) - 1e-9 for size, members in items.sizes.items()}
    sums = np.cumsum(np.r_[0, np.where(known, items.weights(grams), 0)])
    best: dict[tuple[int, int], tuple] = {}
    lows, highs = np.minimum(first[:-1], len(known)), np.minimum(first[1:], len(known))
    for text in np.flatnonzero((sums[highs] - sums[lows] >= min(least.values()) - 1e-6) & (counts[highs] > counts[lows])):
        lo, hi = int(first[text]), int(first[text + 1]) - SHINGLE + 1
        own, hits = grams[lo:hi], known[lo:hi]
        weight = items.weights(own)
        good = np.cumsum(np.r_[0, weight * hits])
        for size in (x for x in items.sizes if x >= SHINGLE):
            k = min(size - SHINGLE + 1, len(own))  # a shorter text is one window
            for at in np.flatnonzero(good[k:] - good[:-k] >= least[size]).tolist():
                window = own[at : at + k]
                hash_ = simhash(window[None], weight[None, at : at + k])[0]
                for item in items.near(size, hash_):
                    value = items.similarity(item, window)
                    key = (int(text), item)
                    if value >= similarity and (key not in best or value > best[key][0]):
                        best[key] = (value, at, k + SHINGLE - 1, int(items.hashes[item] ^ hash_).bit_count())
    for (text, item), (value, at, size, distance) in best.items():
        yield text, items.ids[item], value, at, size, distance


def _item_shingles(batch: pa.RecordBatch) -> Iterator[dict]:
    """Each distinct shingle of each item, and a null for each item that has any."""
    for _, _, flat, offs in slices(batch.column(0)):
        found = shingles_of(flat, offs)
        sets = [x for i in range(len(offs) - 1) if len(x := np.unique(own_shingles(i, *found)))]
        if sets:
            own = array_of(np.concatenate(sets).view(np.int64), pa.int64())
            yield {"shingle": pa.chunked_array([own, pa.nulls(len(sets), pa.int64())])}


def benchmark_weights(benchmark: DataFrame, text_col: str) -> Weights:
    """Weights over all items; 16 bytes for each shingle that two items or more have come to the driver and all tasks."""
    counts = map_batches(benchmark.select(F.col(text_col).cast("string").alias("text")), _item_shingles, "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("df"))
    found = counts.where("shingle is null or df > 1").toArrow()
    shingles, df = found.column("shingle"), found.column("df").to_numpy()
    null = shingles.is_null().to_numpy()
    return Weights.of(int(df[null].sum()), shingles.drop_null().to_numpy().view(np.uint64), df[~null])


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block: int) -> Iterator[Items]:
    """Items in blocks of bounded size, in order of their ids (null ids too), weighted over the whole benchmark."""
    among = benchmark_weights(benchmark, text_col)
    rows = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string")).orderBy("id").toLocalIterator()
    held: list[tuple[int | None, str]] = []
    size = 0
    for row in rows:
        held.append((row[0], row[1]))
        size += len(row[1] or "")
        if len(held) == block or size >= BLOCK_CHARS:
            yield Items.of(held, among)
            held, size = [], 0
    if held:
        yield Items.of(held, among)


def contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY, block: int = BLOCK_ITEMS) -> DataFrame:
    """A row for each text and benchmark item with a window that is similar enough: the best one, the first of equals.

    Null and empty texts match nothing, nor do items without words; an item of fewer words than a shingle matches texts
    that have just these words. Items with a null id match as others do, with a null item_id. Repeated rows match again. A map without shuffles of texts for each block of items.
    """
    texts, out = keyed_text(df, id_col, text_col), None
    for items in item_blocks(benchmark, item_id, item_text, block):
        part = map_batches(texts, _match_rows(df.sparkSession.sparkContext.broadcast(items), similarity), MATCH_SCHEMA)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = df.sparkSession.range(0).select(*[F.col("id").cast(x.split()[1]).alias(x.split()[0]) for x in MATCH_SCHEMA.split(", ")])
    return out


def _match_rows(sent, similarity: float):
    names = [x.split()[0] for x in MATCH_SCHEMA.split(", ")]

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        rows = []
        for i, _, flat, offs in slices(batch.column(1)):
            for text, *match in matches_in(*shingles_of(flat, offs), sent.value, similarity):
                rows.append((batch.column(0)[i + text].as_py(), *match))
        if rows:
            yield dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))

    return run


def clean(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", *keep: Column, similarity: float = SIMILARITY, block: int = BLOCK_ITEMS) -> DataFrame:
    """doc_id, text and `keep` of the rows in which no item has a similar window; columns named as given."""
    out = keyed_text(df, id_col, text_col, *keep)
    names, schema = out.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields)
    for items in item_blocks(benchmark, "item_id", "text", block):
        out = map_batches(out, _clean_rows(df.sparkSession.sparkContext.broadcast(items), similarity, names), schema)
    return out


def _clean_rows(sent, similarity: float, names: list[str]):
    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        ok = np.ones(batch.num_rows, bool)
        for i, _, flat, offs in slices(batch.column(1)):
            for text, *_ in matches_in(*shingles_of(flat, offs), sent.value, similarity):
                ok[i + text] = False
        kept = batch.filter(array_of(ok, pa.bool_()))
        yield {n: kept.column(k) for k, n in enumerate(names)}

    return run
