"""Where texts repeat what stands earlier: the frame of the two exact substring operators.

Units are words or bytes, a window is W units. Only suffixes that start at *anchors* can be needed: in each window the
anchor is the leftmost of its k-grams with the smallest hash, so equal windows have equal anchors at equal offsets, and
every repeat of W units shares an anchor's gram and its place. An anchor's *context* is what the windows that chose it
span, so each window is in one context only.

1. A scan emits anchors; within an Arrow batch, equal contexts are merged at once (the first stays, the rest is covered).
2. Anchors are dealt out by gram. Grams of one anchor go. Members of a class of equal contexts after the first are
   covered throughout. First members of grams with several classes need an exact index.
3. Their contexts are cut from the texts and dealt out by gram; an operator's own index (suffix tree, merged BWTs)
   finds which of their windows are repeats. Grams with very many classes are split by whole windows instead.
4. Covered ranges meet their text again, once.

Equality of contexts is told by a hash of 61 bits modulo a prime under a random base (and their gram's 64 bits, modulo
2**64), so no texts can be built that collide; grams themselves only deal out work.

Rows with equal id and equal text are one document. Null ids stand last. Whole texts take part; nothing is capped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.batches import flat_utf8, map_batches, map_stream, numbers, slices
from corpusmill.llm.hashing import BASES, BYTE_VALUE, PrimeSums, in_one_text, mix, powers, prefix_sums, signed, span_hashes, word_hashes, word_spans
from corpusmill.llm.lineage import written

PLACE_MASK = np.uint64((1 << 28) - 1)
NULL_ID = (1 << 63) - 1
#: Contexts of one gram beyond which it is split by whole windows.
MANY_CONTEXTS = 10_000
#: Units of context that one index holds.
INDEX_UNITS = 1 << 18

ANCHOR_SCHEMA = "gram long, ctx long, doc long, th int, pos int, l short, r short, hi int"
MARK_SCHEMA = "gram long, doc long, th int, pos int, l short, r short, hi int, classes int"
CONTEXT_SCHEMA = "gram long, doc long, th int, start int, body binary"
RANGE_SCHEMA = "doc long, th int, lo int, hi int"

#: Takes contexts (document, start, units) and returns (context index, first window, end window) runs that repeat.
Index = Callable[[np.ndarray, np.ndarray, list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Spec:
    words: bool  # units are words, else bytes
    window: int
    gram: int
    within: bool  # an earlier place in the same document counts too
    many: int = MANY_CONTEXTS


def keyed(df: DataFrame, id_col: str, text_col: str, *keep: Column) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return df.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("doc"), F.hash(text).alias("th"), text.alias("text"), *keep)


def _units(flat: np.ndarray, offs: np.ndarray, spec: Spec) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit value for each unit and each text's first unit."""
    if not spec.words:
        return BYTE_VALUE[flat], offs
    starts, ends, first = word_spans(flat, offs)
    return word_hashes(flat, starts, ends), first


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    span = 1
    while span * 2 <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (w - span)], x[w - span :]) if w > span else x


def anchors_of(flat: np.ndarray, offs: np.ndarray, spec: Spec) -> dict[str, np.ndarray]:
    """Anchors of a slice: row, place in its text, gram, context, and the context's reach to the left and right."""
    values, first = _units(flat, offs, spec)
    window, k = spec.window, spec.gram
    if len(values) > int(PLACE_MASK):
        raise ValueError(f"a text of more than {int(PLACE_MASK)} units")
    none = {n: np.zeros(0, np.int64) for n in ("row", "pos", "gram", "ctx", "l", "r")}
    if len(values) < window:
        return none
    sums = prefix_sums(values, BASES[1])
    _, down = powers(BASES[1], len(sums))
    grams = (sums[k:] - sums[:-k]) * down[: len(sums) - k]
    best = _sliding_min((grams & ~PLACE_MASK) | np.arange(len(grams), dtype=np.uint64), window - k + 1)
    begin = np.flatnonzero(in_one_text(first, window))
    if not len(begin):
        return none
    at = (best[begin] & PLACE_MASK).astype(np.int64)
    new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    at, low, high = at[new], begin[new], begin[np.r_[new[1:] - 1, len(begin) - 1]]
    row = np.searchsorted(first, at, side="right") - 1
    left, right = at - low, high + window - at
    ctx = mix(PrimeSums(values).spans(at - left, at + right) + (left * 257 + right).astype(np.uint64) * np.uint64(BASES[2]))
    return {"row": row, "pos": at - first[row], "gram": signed(mix(grams[at])), "ctx": signed(ctx), "l": left, "r": right}


def _anchor_rows(spec: Spec) -> Callable[[pa.RecordBatch], Iterator[dict]]:
    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        doc, th = numbers(batch.column(0)), numbers(batch.column(1))
        parts = []
        for i, _, flat, offs in slices(batch.column(2)):
            found = anchors_of(flat, offs, spec)
            found["row"] = found["row"] + i
            parts.append(found)
        if not parts:
            return
        a = {n: np.concatenate([p[n] for p in parts]) for n in parts[0]}
        a["doc"], a["th"] = doc[a["row"]], th[a["row"]]
        order = np.lexsort((a["pos"], a["doc"], a["ctx"], a["gram"]))
        a = {n: x[order] for n, x in a.items()}
        if not len(order):
            return
        new = _changes(a["gram"], a["ctx"])
        heads = np.flatnonzero(new)[np.cumsum(new) - 1]
        keep = new | (_same_doc(a, heads) if not spec.within else False)
        yield {n: a[n][keep] for n in ("gram", "ctx", "doc", "th", "pos", "l", "r")} | {"hi": np.full(int(keep.sum()), -1)}
        lost = ~keep & ~(_same_doc(a, heads) & (a["pos"] == a["pos"][heads]))  # a repeated row is not a later place
        if lost.any():
            doc, th, lo, hi = merged_ranges(a["doc"][lost], a["th"][lost], (a["pos"] - a["l"])[lost], (a["pos"] + a["r"])[lost])
            n = len(doc)
            fresh = mix(np.arange(n, dtype=np.uint64) + mix(doc.astype(np.uint64)))
            yield {"gram": signed(fresh), "ctx": np.zeros(n, np.int64), "doc": doc, "th": th, "pos": lo, "l": np.zeros(n), "r": np.zeros(n), "hi": hi}

    return run


def _changes(*columns: np.ndarray) -> np.ndarray:
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _same_doc(a: dict[str, np.ndarray], heads: np.ndarray) -> np.ndarray:
    return (a["doc"] == a["doc"][heads]) & (a["th"] == a["th"][heads])


def merged_ranges(doc: np.ndarray, th: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """Unions of overlapping or touching ranges of each document."""
    if not len(doc):
        return doc, th, lo, hi
    order = np.lexsort((lo, th, doc))
    doc, th, lo, hi = doc[order], th[order], lo[order].astype(np.int64), hi[order].astype(np.int64)
    new = _changes(doc, th)
    group = np.cumsum(new)
    reach = np.maximum.accumulate(hi + group * (1 << 32)) - group * (1 << 32)
    starts = new.copy()
    starts[1:] |= lo[1:] > reach[:-1]
    heads = np.flatnonzero(starts)
    return doc[heads], th[heads], lo[heads], reach[np.r_[heads[1:] - 1, len(doc) - 1]]


def _class_rows(spec: Spec) -> Callable[[Iterator[pa.RecordBatch]], Iterator[dict]]:
    """Over a partition sorted by (gram, ctx, doc, pos): ranges (hi >= 0), and first members of grams with several classes."""
    names = ["gram", "ctx", "doc", "th", "pos", "l", "r", "hi"]

    def settle(a: dict[str, np.ndarray]) -> Iterator[dict]:
        ready = a["hi"] >= 0
        if ready.any():
            yield {n: a[n][ready] for n in names if n != "ctx"} | {"classes": np.zeros(int(ready.sum()))}
            a = {n: x[~ready] for n, x in a.items()}
        if not len(a["gram"]):
            return
        new_gram, new = _changes(a["gram"]), _changes(a["gram"], a["ctx"])
        group = np.cumsum(new_gram) - 1
        classes = np.bincount(group, weights=new).astype(np.int64)[group]
        heads = np.flatnonzero(new)[np.cumsum(new) - 1]
        first = new if spec.within else _same_doc(a, heads)
        marks = first & (classes > 1)
        if marks.any():
            yield {n: a[n][marks] for n in names if n != "ctx"} | {"classes": classes[marks]}
        rest = ~first & ~(_same_doc(a, heads) & (a["pos"] == a["pos"][heads]))
        if rest.any():
            n = int(rest.sum())
            yield {"gram": np.zeros(n), "doc": a["doc"][rest], "th": a["th"][rest], "pos": (a["pos"] - a["l"])[rest], "l": np.zeros(n), "r": np.zeros(n), "hi": (a["pos"].astype(np.int64) + a["r"])[rest], "classes": np.zeros(n)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: list[dict[str, np.ndarray]] = []
        for batch in batches:
            a = {n: numbers(batch.column(i)) for i, n in enumerate(names)}
            if not len(a["gram"]):
                continue
            cut = int(np.searchsorted(a["gram"], a["gram"][-1]))
            if held and held[0]["gram"][0] == a["gram"][-1]:
                held.append(a)
                continue
            held.append({n: x[:cut] for n, x in a.items()})
            yield from settle({n: np.concatenate([h[n] for h in held]) for n in names})
            held = [{n: x[cut:] for n, x in a.items()}]
        if held:
            yield from settle({n: np.concatenate([h[n] for h in held]) for n in names})

    return run


def _context_rows(spec: Spec) -> Callable[[pa.RecordBatch], Iterator[dict]]:
    """Cuts the marked contexts out of the texts; words are joined by one blank."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        doc, th = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        marks = batch.column(3)
        flat, offs = flat_utf8(batch.column(2))
        out: dict[str, list] = {n: [] for n in ("gram", "doc", "th", "start", "body")}
        for i in range(batch.num_rows):
            own = flat[offs[i] : offs[i + 1]]
            data = own.tobytes()
            spans = word_spans(own, np.array([0, len(own)]))[:2] if spec.words else None
            for m in marks[i].as_py():
                lo, hi = m["pos"] - m["l"], m["pos"] + m["r"]
                out["gram"].append(m["gram"])
                out["doc"].append(doc[i])
                out["th"].append(th[i])
                out["start"].append(lo)
                out["body"].append(b" ".join(data[s:e] for s, e in zip(spans[0][lo:hi].tolist(), spans[1][lo:hi].tolist(), strict=True)) if spec.words else data[lo:hi])
        yield out

    return run


def _index_rows(index: Index, spec: Spec) -> Callable[[Iterator[pa.RecordBatch]], Iterator[dict]]:
    """Whole gram groups of a sorted partition are gathered up to INDEX_UNITS and indexed together."""

    def settle(gram: list, doc: list, th: list, start: list, body: list) -> Iterator[dict]:
        d, t, s = np.array(doc, np.int64), np.array(th, np.int32), np.array(start, np.int64)
        which, lo, hi = index(d, s, body)
        if len(which):
            a, b, c, e = merged_ranges(d[which], t[which], s[which] + lo, s[which] + hi - 1 + spec.window)
            yield {"doc": a, "th": b, "lo": c, "hi": e}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: tuple[list, ...] = ([], [], [], [], [])
        size, last = 0, None
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if row[0] != last and size >= INDEX_UNITS:
                    yield from settle(*held)
                    held, size = ([], [], [], [], []), 0
                last = row[0]
                size += row[4].count(b" ") + 1 if spec.words else len(row[4])
                for h, x in zip(held, row, strict=True):
                    h.append(x)
        if held[0]:
            yield from settle(*held)

    return run


def _window_rows(spec: Spec) -> Callable[[pa.RecordBatch], Iterator[dict]]:
    """Two hashes of each window of each context: of 61 bits modulo a prime under a random base, and of 64 bits."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        doc, th, start = (numbers(batch.column(i)) for i in (1, 2, 3))
        for i, _, flat, offs in slices(batch.column(4).cast(pa.string()) if spec.words else batch.column(4).cast(pa.large_binary()).view(pa.large_string())):
            values, first = _units(flat, offs, spec)
            ok = np.flatnonzero(in_one_text(first, spec.window))
            row = np.searchsorted(first, ok, side="right") - 1
            fps = [signed(PrimeSums(values).spans(ok, ok + spec.window)), signed(span_hashes(prefix_sums(values, BASES[1]), ok, ok + spec.window, BASES[1]))]
            yield {"fa": fps[0], "fb": fps[1], "doc": doc[i + row], "th": th[i + row], "lo": start[i + row] + ok - first[row]}

    return run


def covered_ranges(docs: DataFrame, spec: Spec, index: Index) -> DataFrame:
    """All ranges (in units) of keyed documents that windows seen earlier cover."""
    anchors = map_batches(docs, _anchor_rows(spec), ANCHOR_SCHEMA)
    dealt = anchors.repartition("gram").sortWithinPartitions("gram", "ctx", "doc", "pos")
    settled = written(map_stream(dealt, _class_rows(spec), MARK_SCHEMA))
    whole = settled.where("hi >= 0").select("doc", "th", F.col("pos").alias("lo"), "hi")
    marks = settled.where("hi < 0").groupBy("doc", "th").agg(F.collect_list(F.struct("gram", "pos", "l", "r", "classes")).alias("marks"))
    cut = lambda many: F.expr(f"filter(marks, m -> m.classes {'>' if many else '<='} {spec.many})")
    joined = docs.join(marks, ["doc", "th"])
    few = map_batches(joined.select("doc", "th", "text", cut(False).alias("marks")).where("size(marks) > 0"), _context_rows(spec), CONTEXT_SCHEMA)
    indexed = map_stream(few.repartition("gram").sortWithinPartitions("gram", "doc", "start"), _index_rows(index, spec), RANGE_SCHEMA)
    many = map_batches(joined.select("doc", "th", "text", cut(True).alias("marks")).where("size(marks) > 0"), _context_rows(spec), CONTEXT_SCHEMA)
    windows = map_batches(many, _window_rows(spec), "fa long, fb long, doc long, th int, lo int")
    firsts = windows.groupBy("fa", "fb").agg(F.min(F.struct("doc", "lo")).alias("first"))
    later = (F.col("doc") > F.col("first.doc")) | ((F.col("doc") == F.col("first.doc")) & (F.col("lo") > F.col("first.lo"))) if spec.within else F.col("doc") > F.col("first.doc")
    split = windows.join(firsts, ["fa", "fb"]).where(later).select("doc", "th", "lo", (F.col("lo") + spec.window).cast("int").alias("hi"))
    return whole.unionByName(indexed).unionByName(split)


def with_ranges(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """Each document row with its covered ranges (null: none)."""
    return docs.join(ranges.groupBy("doc", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges")), ["doc", "th"], "left")


def repeated_runs(order: np.ndarray, klass: np.ndarray, owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows whose class has a smaller order; owner and place say where each window stands."""
    least = np.full(int(klass.max()) + 1 if len(klass) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, klass, order)
    hit = np.flatnonzero(least[klass] < order)
    owner, place = owner[hit], place[hit]
    by = np.lexsort((place, owner))
    owner, place = owner[by], place[by]
    new = _changes(owner, place - np.arange(len(place)))
    heads = np.flatnonzero(new)
    return owner[heads], place[heads], place[np.r_[heads[1:] - 1, len(place) - 1]] + 1 if len(heads) else place


def union_of(ranges: list | None, limit: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted((r["lo"], min(r["hi"], limit)) for r in ranges or ()):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        elif lo < hi:
            out.append([lo, hi])
    return [(a, b) for a, b in out]
