"""Language identification by prediction by partial matching.

Each language has a variable-order byte context tree: the counts of every byte after contexts of 3, 2, 1 and 0 bytes.
A byte seen in a context costs -log2(c / (n + q)) bits (n counts, q distinct bytes there); one not seen costs the
escape, -log2(q / (n + q)), plus its cost in the context one byte shorter; the last resort is 8 bits. Statistics are
frozen after training, so a byte's cost depends on four bytes only and the exact code length of a text is a sum of
table rows: all languages are scored at once, and the shortest code wins.

Training takes at most about `docs_per_lang` labelled rows of a language (a hash of the id chooses them, whole texts,
whatever the table's size); everything else covers all rows, and every language that occurs is learned. Languages are
learned in blocks of LANGS_OF_MODEL, each with a model of bounded size; texts pass the blocks one after another.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.batches import keyed_text, map_batches, slices

ORDER = 3
#: Labelled rows a language that training aims at, and languages of one model.
DOCS_PER_LANG, LANGS_OF_MODEL = 600, 16
#: Bytes that are scored at a time.
SCORED_BYTES = 1 << 18
#: Shares of rows are told in this many parts.
PARTS = 1 << 48
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
LANG_SCHEMA = "doc_id long, lang_pred string, score double, bits_per_byte double"


def padded_grams(flat: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For each byte, itself (lowest 8 bits) and the three before it; zeros stand before a text."""
    gram = flat.astype(np.uint32)
    out = gram.copy()
    for k in range(1, ORDER + 1):
        part = np.zeros_like(gram)
        part[k:] = gram[:-k] if k < len(gram) else gram[:0]
        for j in range(k):
            at = offs[:-1] + j
            part[at[at < offs[1:]]] = 0
        out |= part << np.uint32(8 * k)
    return out


@dataclass(frozen=True)
class Model:
    """Sorted 4-byte keys with a row of costs for each language, and what unseen keys fall back on."""

    langs: tuple[str, ...]
    keys: tuple[np.ndarray, ...]  # by order 3, 2, 1: (context, byte) seen by any language
    costs: tuple[np.ndarray, ...]
    contexts: tuple[np.ndarray, ...]  # contexts of orders 3, 2, 1
    escapes: tuple[np.ndarray, ...]
    base: np.ndarray  # order 0: 256 rows

    def rows(self, grams: np.ndarray, order: int = ORDER) -> np.ndarray:
        if order == 0:
            return self.base[grams & np.uint32(0xFF)]
        key = grams & np.uint32((1 << 8 * (order + 1)) - 1)
        keys = self.keys[ORDER - order]
        at = np.searchsorted(keys, key)
        at[at == len(keys)] = 0
        out = self.costs[ORDER - order][at]
        if len(missing := np.flatnonzero(keys[at] != key)):
            lost = key[missing]
            out[missing] = self.escape(lost >> np.uint32(8), order) + self.rows(lost, order - 1)
        return out

    def escape(self, context: np.ndarray, order: int) -> np.ndarray:
        known = self.contexts[ORDER - order]
        at = np.searchsorted(known, context)
        at[at == len(known)] = 0
        return np.where((known[at] == context)[:, None], self.escapes[ORDER - order][at], np.float32(0))

    def code_lengths(self, flat: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Bits of each text under each language."""
        out = np.zeros((len(offs) - 1, len(self.langs)))
        full = np.flatnonzero(offs[1:] > offs[:-1])
        if len(full):
            out[full] = np.add.reduceat(self.rows(padded_grams(flat, offs)), offs[full], axis=0, dtype=np.float64)
        return out


def fit(langs: list[str], grams: np.ndarray, lang: np.ndarray, count: np.ndarray) -> Model:
    """The model of gram counts (lang: index into langs); languages that were not counted know nothing and cost 8 bits."""
    n = len(langs)
    keys, costs, contexts, escapes = [], [], [], []
    byte_counts = np.zeros((256, n))
    np.add.at(byte_counts, ((grams & 0xFF).astype(np.int64), lang), count)
    total, distinct = byte_counts.sum(axis=0), (byte_counts > 0).sum(axis=0)
    with np.errstate(divide="ignore", invalid="ignore"):
        base = np.where(byte_counts > 0, -np.log2(byte_counts / (total + distinct)), np.where(total > 0, -np.log2(distinct / (total + distinct)), 0) + 8)
    model = Model(tuple(langs), (), (), (), (), base.astype(np.float32))
    for order in range(1, ORDER + 1):
        key, at = np.unique(grams & np.uint32((1 << 8 * (order + 1)) - 1), return_inverse=True)
        seen = np.zeros((len(key), n))
        np.add.at(seen, (at, lang), count)
        context, back = np.unique(key >> np.uint32(8), return_inverse=True)
        sums, kinds = np.zeros((len(context), n)), np.zeros((len(context), n))
        np.add.at(sums, back, seen)
        np.add.at(kinds, back, seen > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(sums > 0, -np.log2(kinds / (sums + kinds)), 0)
            own = -np.log2(seen / (sums + kinds)[back])
        lower = Model(model.langs, tuple(keys[::-1]), tuple(costs[::-1]), (), (), model.base)
        below = _rows_at(lower, contexts, escapes, key, order - 1)
        keys.append(key)
        costs.append(np.where(seen > 0, own, escape[back] + below).astype(np.float32))
        contexts.append(context)
        escapes.append(escape.astype(np.float32))
    return Model(tuple(langs), tuple(keys[::-1]), tuple(costs[::-1]), tuple(contexts[::-1]), tuple(escapes[::-1]), model.base)


def _rows_at(model: Model, contexts: list, escapes: list, key: np.ndarray, order: int) -> np.ndarray:
    """Costs at a lower order while the tree is built; every key's shorter forms were seen too."""
    if order == 0:
        return model.base[key & np.uint32(0xFF)]
    known = model.keys[0]
    return model.costs[0][np.searchsorted(known, key & np.uint32((1 << 8 * (order + 1)) - 1))]


def train(df: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = DOCS_PER_LANG) -> list[Model]:
    """Counts 4-byte grams of a bounded sample on the workers; only the sample's distinct grams reach the driver.

    One model for each LANGS_OF_MODEL languages in order of their names. Rows without text or language teach nothing.
    """
    lang, text = F.col(f"`{lang_col}`").cast("string"), F.col(f"`{text_col}`")
    labelled = df.where(usable & lang.isNotNull() & text.isNotNull())
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy(lang.alias("lang")).count().collect()}
    share = {x: min(PARTS, -(-docs_per_lang * PARTS // n)) for x, n in sizes.items()}
    names = sorted(sizes)
    return [_trained(labelled, {x: share[x] for x in names[at : at + LANGS_OF_MODEL]}, id_col, text_col, lang) for at in range(0, len(names), LANGS_OF_MODEL)]


def _trained(labelled: DataFrame, share: dict[str, int], id_col: str, text_col: str, lang: Column) -> Model:
    limit = F.create_map([F.lit(x) for pair in share.items() for x in pair])
    key = F.pmod(F.xxhash64(F.col(f"`{id_col}`"), F.lit("sample")), F.lit(PARTS))
    chosen = labelled.where(lang.isin(*share) & (key < limit[lang]))
    index = {x: i for i, x in enumerate(share)}

    def count(batch: pa.RecordBatch) -> Iterator[dict]:
        of_row = np.array([index[x] for x in batch.column(2).to_pylist()])
        keys, sums = [], []
        for i, j, flat, offs in slices(batch.column(1)):
            code = np.repeat(of_row[i:j], np.diff(offs)).astype(np.uint64) << np.uint64(32) | padded_grams(flat, offs)
            key, n = np.unique(code, return_counts=True)
            keys.append(key)
            sums.append(n)
        if keys:
            yield {"key": np.concatenate(keys).view(np.int64), "n": np.concatenate(sums)}

    counted = map_batches(keyed_text(chosen, id_col, text_col, lang.alias("lang")), count, "key long, n long")
    table = counted.groupBy("key").agg(F.sum("n").alias("n")).toArrow().sort_by("key")
    found = table.column("key").to_numpy().view(np.uint64)
    return fit(list(share), (found & np.uint64(0xFFFFFFFF)).astype(np.uint32), (found >> np.uint64(32)).astype(np.int64), table.column("n").to_numpy().astype(float))


RUNNING_SCHEMA = "best string, least double, total double"


def identify(df: DataFrame, models: list[Model], id_col: str = "doc_id", text_col: str = "text", *keep: Column) -> DataFrame:
    """The language with the shortest code for each row's whole text, its posterior (0 to 1) and its bits a byte.

    `und` with score 0 for null texts, texts without a letter (Unicode category L), and where nothing was learnt; ties go
    to the first language by name. Repeated rows are repeated. `keep` columns pass through after the result's own.
    """
    kept = keyed_text(df, id_col, text_col, *keep)
    fields, names = kept.schema.fields, kept.columns[2:]
    whole = kept.select("doc_id", "text", *[F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in RUNNING_SCHEMA.split(", ")], *[F.struct(*[f"`{x}`" for x in names]).alias("kept")] if names else [])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in whole.schema.fields)
    for model in models:
        whole = map_batches(whole, _scored(df.sparkSession.sparkContext.broadcast(model)), schema)
    size = F.greatest(F.octet_length("text"), F.lit(1))
    rate = F.col("least") / F.coalesce(size, F.lit(1))
    return whole.select(
        "doc_id",
        F.coalesce("best", F.lit(UNKNOWN)).alias("lang_pred"),
        F.when(F.col("best").isNotNull(), 1 / F.col("total")).otherwise(F.lit(0.0)).alias("score"),
        rate.alias("bits_per_byte"),
        *[F.col(f"kept.`{f.name}`").alias(f.name) for f in fields[2:]],
    )


def _scored(sent):
    """The best language so far, its bits, and the sum of all languages' probabilities as multiples of its own."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        model = sent.value
        columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        best, least, total = [], [], []
        letters = [bool(t) and _LETTER.search(t) is not None for t in columns["text"].to_pylist()]
        before = list(zip(*(columns[x.split()[0]].to_pylist() for x in RUNNING_SCHEMA.split(", ")), strict=True))
        for i, j, flat, offs in slices(columns["text"], SCORED_BYTES):
            bits = model.code_lengths(flat, offs)
            first = bits.argmin(axis=1)
            low = bits[np.arange(j - i), first]
            share = np.exp2(np.clip(low[:, None] - bits, -1000, 0)).sum(axis=1)
            for k in range(j - i):
                name, own, sum_ = model.langs[first[k]] if letters[i + k] else None, float(low[k]), float(share[k])
                old_name, old, old_sum = before[i + k]
                if old is not None and old <= own:
                    name, own, sum_ = old_name, old, old_sum + sum_ * 2.0 ** max(-1000.0, old - own)
                elif old is not None:
                    sum_ += old_sum * 2.0 ** max(-1000.0, own - old)
                best.append(name)
                least.append(own)
                total.append(sum_)
        yield columns | {"best": best, "least": least, "total": total}

    return run


def held_out(id_col: str = "doc_id") -> Column:
    """The quarter of the ids that training never sees; a null id is not of it."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train_and_identify(df: DataFrame, *keep: Column) -> DataFrame:
    """Trains on labelled rows outside the held-out quarter and predicts all rows."""
    return identify(df, train(df, ~held_out()), "doc_id", "text", held_out().alias("held_out"), *keep)
