"""Chunking: the structure- and meaning-aware segmenter, its heading-only form, fixed-length cuts and rule ranges.

The aware segmenter is sequential within a document and runs as one Arrow-batched function over its blocks; cutting at
fixed lengths is an Arrow-batched map over whole texts. Neither shuffles text that is already one row a document.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import cached_property, lru_cache
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, MapType, StringType, StructField, StructType

from corpusmill.arrow import map_rows, map_values
from corpusmill.functions import fixed as K
from corpusmill.functions.text import WHITE
from corpusmill.operators.clean import cleaned, cleaned_blocks
from corpusmill.operators.parse import headed, with_headings

_TOKEN = re.compile(K.TOKEN)
_SENTENCE = re.compile(K.SENTENCE)
_METRIC = re.compile(K.METRIC)
#: What an ASCII text with a metric has.
_METRIC_ASCII = [p for p in K.METRIC.strip("()").split("|") if p.isascii()]
_TERMS = [re.compile(p) for p in K.METRIC_TERMS]


@dataclass(frozen=True)
class SegmentConfig:
    min_chars: int = 180
    target_chars: int = 550
    max_chars: int = 800
    overlap: int = 1
    heading_flush: int = 240
    min_tokens: int = 100
    target_tokens: int = 900
    max_tokens: int = 1200
    with_heading: bool = True
    semantic: bool = True
    threshold: float = 0.55

    @classmethod
    def auto(cls, total: int) -> SegmentConfig:
        if total <= 0:
            return cls()
        target = next((t for limit, t in ((3_000, 300), (10_000, 450), (50_000, 650), (200_000, 850)) if total < limit), 1100)
        return cls(min_chars=max(120, target // 2), target_chars=target, max_chars=2 * target, heading_flush=max(120, target // 3))

    @classmethod
    def headings_only(cls) -> SegmentConfig:
        return replace(cls(), overlap=0, semantic=False)


def auto_target(total: Column) -> Column:
    """The target length of a document of that many characters."""
    return F.when(total <= 0, 550).when(total < 3_000, 300).when(total < 10_000, 450).when(total < 50_000, 650).when(total < 200_000, 850).otherwise(1100)


# ---- one document ----


@dataclass
class Block:
    ref: str
    text: str
    kind: str
    level: int = 0
    title: str = ""
    path: tuple[str, ...] = ()

    @cached_property
    def metric(self) -> bool:
        t = self.text
        return (not t.isascii() or any(s in t for s in _METRIC_ASCII)) and _METRIC.search(t) is not None


@dataclass
class Piece:
    """A chunk in the making; lengths follow the content."""

    content: str
    path: list[str]
    titles: list[str]
    metrics: list[str]
    kind: str
    blocks: list[Block]
    reason: str
    extra: dict = field(default_factory=dict)

    @property
    def chars(self) -> int:
        return len(self.content)

    @property
    def tokens(self) -> int:
        return count_tokens(self.content)

    @property
    def fixed(self) -> bool:
        return self.kind in K.PROTECTED


def count_tokens(text: str) -> int:
    return len(_TOKEN.findall(text))


def tokens_over(text: str, limit: int) -> bool:
    """Whether there are more tokens than that; there are no more than characters."""
    return len(text) > limit and count_tokens(text) > limit


def joined(blocks: list[Block]) -> str:
    return "\n\n".join(t for b in blocks if (t := b.text.strip()))


def unique(items) -> list[str]:
    return [x for x in dict.fromkeys([str(i).strip() for i in items]) if x]


def metric_terms(text: str) -> list[str]:
    if "%" not in text:  # all terms have one
        return []
    return list((_found_terms if len(text) <= 200 else _found_terms.__wrapped__)(text))


@lru_cache(maxsize=1 << 12)
def _found_terms(text: str) -> tuple[str, ...]:
    found = (m.group(0) for p in _TERMS for m in p.finditer(text))
    return tuple(dict.fromkeys(re.sub(r"\s+", " ", x.strip()).replace("≥", K.AT_LEAST).replace(">=", K.AT_LEAST) for x in found))


def shared_path(a: list[str], b: list[str]) -> list[str]:
    n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[:n]


def token_similarity(a: str, b: str) -> float:
    x, y = Counter(_TOKEN.findall(a.lower())), Counter(_TOKEN.findall(b.lower()))
    norm = math.sqrt(sum(v * v for v in x.values())) * math.sqrt(sum(v * v for v in y.values()))
    return round(sum(v * y[k] for k, v in x.items()) / norm, 6) if norm else 0.0


class Segmenter:
    """All rules for one document's blocks under one configuration."""

    def __init__(self, config: SegmentConfig) -> None:
        self.c = config

    def run(self, blocks: list[Block]) -> list[Piece]:
        pieces = [p for first in self.gather(blocks) for p in self.cut(first)]
        return self.absorb(self.rebalance(self.merge(pieces)))

    # -- gathering blocks --

    def piece(self, blocks: list[Block], path: list[str], reason: str, text: str | None = None) -> Piece:
        text = joined(blocks) if text is None else text
        heads, special, metric = [], "", False
        for b in blocks:
            if b.kind == "heading":
                heads.append(b)
            elif b.kind in K.PROTECTED:
                special = b.kind
            metric = metric or b.metric
        deep = next((b.path for b in heads if len(b.path) > 1), heads[0].path if heads else path)
        kind = "metric" if metric else special or "normal"
        return Piece(text, list(deep), unique([b.title for b in heads]), metric_terms(text) if metric else [], kind, list(blocks), reason)

    def gather(self, blocks: list[Block]) -> list[Piece]:
        c, out = self.c, []
        held: list[Block] = []
        text, bodies = "", 0  # of what is held: its text, and how many blocks are no headings
        path: list[str] = []
        stack: list[Block] = []
        head: Block | None = None

        def hold(b: Block) -> None:
            nonlocal text, bodies
            held.append(b)
            bodies += b.kind != "heading"
            if t := b.text.strip():
                text = f"{text}\n\n{t}" if text else t

        def flush(reason: str) -> None:
            nonlocal text, bodies
            if bodies:
                out.append(self.piece(held, path, reason, text))
            held.clear()
            text, bodies = "", 0

        def reseed() -> None:
            nonlocal text, bodies
            if c.with_heading and head is not None:
                held.clear()
                text, bodies = "", 0
                hold(head)

        lead = lambda: [head] if c.with_heading and head is not None else []
        for b in blocks:
            if b.kind == "heading":
                if len(text) >= c.heading_flush:
                    flush("heading_boundary")
                stack = [s for s in stack if s.level < b.level] + [b]
                path = [s.title for s in stack]
                head = Block(b.ref, b.text, b.kind, b.level, b.title, tuple(path))
                if c.with_heading:
                    hold(head)
                continue
            if b.kind in K.PROTECTED:
                flush("before_special_block")
                out.append(self.piece([*lead(), b], path, f"protected_{b.kind}"))
                reseed()
                continue
            if bodies and self.drifts(text, b.text):
                flush("semantic_boundary")
                reseed()
            if len(b.text) > c.max_chars or tokens_over(b.text, c.max_tokens):
                flush("before_long_block")
                out += [self.piece([*lead(), replace(b, text=part)], path, "long_block_sentence_split") for part in self.split(b.text, c.max_chars)]
                reseed()
                continue
            if not held:
                reseed()
            if bodies and len(text) + len(b.text) > c.max_tokens:
                now = count_tokens(text)
                if now >= c.min_tokens and now + count_tokens(b.text) > c.max_tokens:
                    flush("pre_add_token_overflow")
            hold(b)
            if len(text) >= c.target_chars or tokens_over(text, c.target_tokens - 1):
                flush("target_length_reached")
                reseed()
        flush("document_end")
        return out

    def drifts(self, held: str, text: str) -> bool:
        c = self.c
        if not c.semantic or len(held) < max(c.min_chars, int(c.target_chars * 0.85)):
            return False
        left, right = (re.sub(r"\s+", " ", t).strip()[-1200:] for t in (held, text))
        return (token_similarity(left, right) if left and right else 0.0) < c.threshold

    # -- cutting what is too long --

    def cut(self, p: Piece) -> list[Piece]:
        c = self.c
        if p.fixed or (p.chars <= c.max_chars and not tokens_over(p.content, c.max_tokens)):
            return [p]
        head, body = "", p.content.strip()
        if p.blocks and p.blocks[0].kind == "heading":
            head = p.blocks[0].text.strip()
            rows = body.splitlines()
            if rows and rows[0].strip() == head:
                body = "\n".join(rows[1:]).lstrip("\n")
        room = max(1, c.max_chars - len(head) - 2) if head else c.max_chars
        parts = self.split(body, min(room, self.token_limit(body))) or [body]
        texts = [f"{head}\n\n{part.strip()}".strip() if head else part.strip() for part in parts]
        return [replace(p, content=t, kind="normal", reason="sentence_boundary_for_oversized_chunk", extra={"split_index": i}) for i, t in enumerate(texts) if t]

    def token_limit(self, text: str) -> int:
        c, n = self.c, count_tokens(text)
        if n <= c.max_tokens or n <= len(text):
            return c.max_chars
        return max(1, int(c.max_tokens / (n / len(text)) * 0.95))

    def split(self, text: str, limit: int) -> list[str]:
        limit, text = max(1, limit), text.strip()
        if len(text) <= limit:
            return [text] if text else []
        return self.packed(self.units(text, limit, K.SEPARATORS), limit)

    def units(self, text: str, limit: int, separators: tuple[str, ...]) -> list[str]:
        """Parts at the coarsest separator that occurs; those still too long go on with finer ones."""
        text = text.strip()
        if len(text) <= limit:
            return [text] if text else []
        at = next((i for i, s in enumerate(separators) if s == "" or s in text), None)
        if at is None or separators[at] == "":
            return self.by_length(text, limit)
        parts, out = text.split(separators[at]), []
        for i, part in enumerate(parts):
            if part.strip():
                part += separators[at] if i < len(parts) - 1 else ""
                out += self.units(part, limit, separators[at + 1 :]) if len(part) > limit else [part]
        return out

    @staticmethod
    def by_length(text: str, limit: int) -> list[str]:
        out, rest = [], text.strip()
        while len(rest) > limit:
            soft = max(rest.rfind(s, 0, limit + 1) for s in (" ", "\n", "\t", ",", "，", "、", ":"))
            at = soft + 1 if soft >= max(1, limit // 2) else limit
            out.append(rest[:at].strip())
            rest = rest[at:].strip()
        return [*out, rest] if rest else out

    def packed(self, units: list[str], limit: int) -> list[str]:
        """Greedy packing; each piece starts with the last units of the one before, as far as they fit."""
        out: list[str] = []
        held: list[str] = []
        size = lambda xs: sum(map(len, xs))
        for unit in (u.strip(" \t") for u in units):
            if not unit.strip():
                continue
            if held and size(held) + len(unit) > limit:
                out.append("".join(held).strip())
                kept: list[str] = []
                for u in held[-self.c.overlap :] if self.c.overlap > 0 else []:
                    if size(kept) + len(u) <= limit:
                        kept.append(u)
                while kept and size(kept) + len(unit) > limit:
                    kept.pop(0)
                held = kept
            held.append(unit)
        return [p for p in (*out, "".join(held).strip()) if p]

    # -- joining what is too short --

    def fits(self, a: Piece, b: Piece) -> bool:
        c = self.c
        if b.kind != "normal":
            return False
        chars = a.chars + b.chars + (2 if a.content.strip() and b.content.strip() else 0)
        if chars > c.max_chars or a.chars + b.chars > c.max_tokens and a.tokens + b.tokens > c.max_tokens:
            return False
        if a.path == b.path:
            return True
        if shared_path(a.path, b.path):
            return min(a.chars, b.chars) < c.min_chars
        if a.chars < max(120, c.min_chars * 2 // 3):
            return chars <= c.target_chars
        if min(a.chars, b.chars) < max(80, c.min_chars // 2):
            return not a.path or not b.path or chars <= c.target_chars or token_similarity(a.content, b.content) >= c.threshold * 0.35
        return False

    @staticmethod
    def union(a: Piece, b: Piece) -> Piece:
        content, blocks = f"{a.content}\n\n{b.content}".strip(), a.blocks + b.blocks
        titles = unique(a.titles + b.titles) or unique(x.title for x in blocks if x.kind == "heading")
        metric = any(x.metric for x in blocks)
        terms = unique(a.metrics + b.metrics) or (metric_terms(content) if metric else [])
        path = shared_path(a.path, b.path) or list(a.path or b.path)
        return Piece(content, path, titles, terms, "metric" if terms or metric else "normal", blocks, b.reason, {"merge_reason": "adaptive_short_chunk_merge"})

    def merge(self, pieces: list[Piece]) -> list[Piece]:
        out, i = [], 0
        while i < len(pieces):
            now, i = pieces[i], i + 1
            while not now.fixed and i < len(pieces) and not pieces[i].fixed and self.fits(now, pieces[i]):
                now, i = self.union(now, pieces[i]), i + 1
                if now.chars >= self.c.min_chars and now.tokens >= self.c.min_tokens:
                    break
            out.append(now)
        return out

    def rebalance(self, pieces: list[Piece]) -> list[Piece]:
        """A short chunk takes last sentences of a long one before it: the fewest that together reach what it lacks and 80
        more, but no more than the long one has to spare; one sentence stays at least."""
        out, least = list(pieces), self.c.min_chars
        for at in range(len(out) - 1):
            donor, short = out[at], out[at + 1]
            if donor.kind == short.kind == "normal" and short.chars < least < donor.chars and self.related(donor, short):
                sentences = [t for t in map(str.strip, _SENTENCE.findall(donor.content)) if t]
                tails = list(accumulate(map(len, reversed(sentences[1:]))))
                goal = min(least - short.chars + 80, donor.chars - least)
                if cut := min(len(tails), bisect_left(tails, goal) + 1):
                    given = "".join(sentences[-cut:])
                    out[at] = replace(donor, content="".join(sentences[:-cut]), extra=donor.extra | {"rebalance_role": "donor", "chars_donated": tails[cut - 1]})
                    out[at + 1] = replace(short, content=f"{given}\n\n{short.content}".strip(), extra=short.extra | {"rebalance_role": "recipient", "chars_received": tails[cut - 1]})
        return out

    @staticmethod
    def related(a: Piece, b: Piece) -> bool:
        return not (a.path or b.path) or bool(shared_path(a.path, b.path))

    def absorb(self, pieces: list[Piece]) -> list[Piece]:
        out = list(pieces)
        while len(out) > 1 and not out[-1].fixed and (out[-1].chars < self.c.min_chars or out[-1].tokens < self.c.min_tokens) and self.fits(out[-2], out[-1]):
            out[-2:] = [self.union(out[-2], out[-1])]
        return out


_NAMES = ArrayType(StringType())
CHUNK_FIELDS = StructType(
    [StructField(n, k) for n, k in (
        ("ordinal", IntegerType()), ("chunk_type", StringType()), ("title_path", _NAMES), ("section_titles", _NAMES), ("metric_keywords", _NAMES), ("content", StringType()),
        ("source_ids", _NAMES), ("source_types", _NAMES), ("split_reason", StringType()), ("strategy", MapType(StringType(), StringType())), ("min_chars", IntegerType()), ("max_chars", IntegerType()),
    )]
)


def _pieces(blocks: list[Block], config: SegmentConfig | None) -> Iterator[tuple]:
    c = config or SegmentConfig.auto(sum(len(b.text) for b in blocks))
    for i, p in enumerate(Segmenter(c).run(blocks), 1):
        yield i, p.kind, p.path, p.titles, p.metrics, p.content, [b.ref for b in p.blocks], [b.kind for b in p.blocks], p.reason, {k: str(v) for k, v in p.extra.items()}, c.min_chars, c.max_chars


def _from(fields: StructType, pieces, *columns: str):
    """`pieces` of each document's row, a document at a time: what a worker holds does not grow with its documents."""
    return lambda df: map_values(df.select("doc_id", *columns), lambda doc_id, *row: ((doc_id, *p) for p in pieces(*row)), StructType([StructField("doc_id", df.schema["doc_id"].dataType), *fields]))


def chunks(blocks: DataFrame, config: SegmentConfig | None = None) -> DataFrame:
    """Blocks (with heading levels and titles) to chunks; without a configuration each document's length chooses one."""

    def pieces(rows: list[dict] | None) -> Iterator[tuple]:
        rows = sorted(rows or [], key=lambda r: r["last_raw"])
        return _pieces([Block(f"b{r['raw']:04d}", r["text"], r["block_type"], r["heading_level"] or 0, r["title"] or "") for r in rows], config)

    rows = blocks.groupBy("doc_id").agg(F.collect_list(F.struct("raw", "last_raw", "text", "block_type", "heading_level", "title")).alias("rows"))
    return _flagged(_from(CHUNK_FIELDS, pieces, "rows")(rows))


def segmented_of(df: DataFrame, config: SegmentConfig | None = None) -> DataFrame:
    """`segmented` of the blocks of texts: a document is parsed, cleaned and chunked at once, without a shuffle."""

    def pieces(text: str | None) -> Iterator[tuple]:
        blocks = headed(b[:4] for b in cleaned_blocks(text or ""))
        return _pieces([Block(f"b{first:04d}", t, kind, level or 0, title or "") for first, _, t, kind, level, title in blocks], config)

    return _flagged(_from(CHUNK_FIELDS, pieces, "text")(df))


def _flagged(flat: DataFrame) -> DataFrame:
    n = F.length("content")
    has = lambda t: F.array_contains("source_types", t)
    flags = F.array_compact(
        F.array(
            F.when(n > F.col("max_chars"), "oversized"),
            F.when(n < F.col("min_chars"), "undersized"),
            F.when(F.size("source_ids") == 0, "missing_source_ref"),
            F.when(F.col("chunk_type").isin(*K.PROTECTED, "metric"), F.concat(F.lit("contains_"), "chunk_type")),
            F.when(has("image"), "contains_image"),
        )
    )
    chunk_id = F.format_string("%s_chunk_%04d", F.col("doc_id").cast("string"), F.col("ordinal"))
    return flat.select("*", chunk_id.alias("chunk_id"), n.alias("char_count"), flags.alias("quality_flags"))


def fixed_cuts(text: str, size: int) -> Iterator[tuple[int, int]]:
    """(start, end) of fixed-length slices: up to the first line break beyond the size, else the last sentence end there.

    Each place is looked at a bounded number of times, so a text of any length is cut in linear time.
    """
    at, total = 0, len(text)
    while at < total:
        end = at + size
        if end < total:
            ahead = text[end : end + size // 2]
            line = ahead.find("\n") + 1
            end += line or 1 + max(map(ahead.rfind, ".!?。！？"))
        end = min(end, total)
        yield at, end
        at = end


def fixed_chunks_of(df: DataFrame, sizes: tuple[int, ...], *keep: str) -> DataFrame:
    """size, doc_id, `keep`, nth, lo, hi, content: a text's slices for each size, all cut in one pass over the texts.

    Blank slices are left out; null and empty texts have none. A map without shuffles.
    """
    names = ("doc_id", *keep)
    source = df.select(*names, F.col("text").cast("string").alias("text"))
    kinds = {f.name: f.dataType for f in source.schema.fields}
    schema = StructType([StructField("size", IntegerType()), *(StructField(n, kinds[n]) for n in names), StructField("nth", IntegerType()), StructField("lo", IntegerType()), StructField("hi", IntegerType()), StructField("content", StringType())])

    def rows(row: dict) -> Iterator[tuple]:
        text, own = row["text"] or "", tuple(row[n] for n in names)
        for size in sizes:
            for nth, (lo, hi) in enumerate(fixed_cuts(text, size), 1):
                if content := text[lo:hi].strip(WHITE):
                    yield (size, *own, nth, lo, hi, content)

    return map_rows(source, rows, schema)


def fixed_chunks(df: DataFrame, size: int = 512) -> DataFrame:
    """doc_id, nth, lo, hi, content of one size."""
    return fixed_chunks_of(df, (size,)).drop("size")


# ---- whole documents ----


def segmented(blocks: DataFrame, config: SegmentConfig | None = None) -> DataFrame:
    """Parsed blocks cleaned (cover, contents and large body tables, see `clean`), with their headings found, and chunked."""
    return chunks(with_headings(cleaned(blocks)), config)
