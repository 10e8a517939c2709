"""Ranges of blocks: greedy ones by length, repaired ones from a model's answer, and the records that they give."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from corpusmill.arrow import map_values
from corpusmill.functions.text import WHITE
from corpusmill.operators.parse import raw_texts

#: White space that is not one blank already.
_SPACE = re.compile(f"[{WHITE}]{{2,}}|[{WHITE.replace(' ', '')}]")

RANGE = "array<struct<start:int,stop:int>>"


def rule_ranges(sizes: Column, target: int) -> Column:
    """Blocks are taken while their lengths, two characters between each, stay under the target; one at least."""

    def step(acc: Column, x: Column) -> Column:
        more = x + F.when(acc["size"] > 0, 2).otherwise(0)
        full = (acc["i"] > acc["start"]) & (acc["size"] + more >= target)
        return F.struct(
            (acc["i"] + 1).alias("i"),
            F.when(full, acc["i"]).otherwise(acc["start"]).alias("start"),
            F.when(full, x).otherwise(acc["size"] + more).alias("size"),
            F.when(full, F.array_append(acc["out"], F.struct(acc["start"].alias("start"), (acc["i"] - 1).alias("stop")))).otherwise(acc["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("start"), F.lit(0).alias("size"), F.array().cast(RANGE).alias("out"))
    return F.aggregate(sizes, start, step, lambda acc: F.when(acc["start"] < acc["i"], F.array_append(acc["out"], F.struct(acc["start"].alias("start"), (acc["i"] - 1).alias("stop")))).otherwise(acc["out"]))


def sanitized(ranges: Column, total: Column) -> Column:
    """Ranges in order, clipped to what is free, with gaps and the end filled; `given` tells them from fillers."""
    kind = "array<struct<start:int,stop:int,given:boolean>>"

    def one(start: Column, stop: Column, given: bool) -> Column:
        return F.array(F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop"), F.lit(given).alias("given")))

    def step(acc: Column, r: Column) -> Column:
        at = acc["at"]
        raw = F.coalesce(r["start"], at)
        start, stop = F.greatest(raw, at), F.coalesce(r["stop"], raw)
        skip = (at >= total) | (stop < start) | (start >= total)
        end = F.least(stop, total - 1)
        gap = F.when(start > at, one(at, start - 1, False)).otherwise(F.array().cast(kind))
        # A range that starts beyond the end also ends the list.
        return F.when(skip, F.struct(F.when((at < total) & (stop >= start), total).otherwise(at).alias("at"), acc["out"].alias("out"), F.when((at < total) & (stop >= start), at).otherwise(acc["rest"]).alias("rest"))).otherwise(
            F.struct((end + 1).alias("at"), F.concat(acc["out"], gap, one(start, end, True)).alias("out"), (end + 1).alias("rest"))
        )

    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"), F.lit(0).alias("rest"))
    return F.aggregate(ranges, start, step, lambda acc: F.when(acc["rest"] < total, F.concat(acc["out"], one(acc["rest"], total - 1, False))).otherwise(acc["out"]))


def materialized(blocks: DataFrame, ranges: DataFrame) -> DataFrame:
    """blocks (doc_id, i, text) joined to ranges (doc_id, nth, start, stop): one row a range with its blocks' text."""
    inside = (blocks["doc_id"] == ranges["doc_id"]) & (blocks["i"] >= ranges["start"]) & (blocks["i"] <= ranges["stop"])
    x = blocks.join(ranges, inside).select(ranges["doc_id"], "nth", "start", "stop", "i", "text")
    return x.groupBy("doc_id", "nth", "start", "stop").agg(F.expr("listagg(text, '\n\n') WITHIN GROUP (ORDER BY i)").alias("content"))


def split_parts(sizes: Column, most: int) -> Column:
    """For each of a range's blocks the part (from 1) it falls into, so that no part, two characters between its blocks, is
    longer than `most`; a block alone may be. Blocks of no length are in part 0."""
    start = F.struct(F.lit(0).alias("part"), F.lit(0).alias("size"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, n: Column) -> Column:
        fresh = (acc["part"] == 0) | (acc["size"] + n + 2 > most)
        part = acc["part"] + F.when(fresh, 1).otherwise(0)
        moved = F.struct(part.alias("part"), F.when(fresh, n).otherwise(acc["size"] + n + 2).alias("size"), F.array_append(acc["out"], part).alias("out"))
        return F.when(n > 0, moved).otherwise(F.struct(acc["part"].alias("part"), acc["size"].alias("size"), F.array_append(acc["out"], F.lit(0)).alias("out")))

    return F.aggregate(sizes, start, step, lambda acc: acc["out"])


def records(blocks: DataFrame, ranges: DataFrame, max_chars: int) -> DataFrame:
    """Chunk records of blocks (doc_id, i, block_id, text) by ranges (doc_id, nth, start, stop, title, reason).

    A range longer than `max_chars` gives several records, from the second on with the part's number in the title; blank
    blocks go. chunk_id counts within the document.
    """
    b = blocks.groupBy("doc_id").agg(F.collect_list(F.struct("i", "block_id", "text")).alias("blocks"))
    r = ranges.groupBy("doc_id").agg(F.collect_list(F.struct("nth", "start", "stop", "title", "reason")).alias("ranges"))
    x = b.join(r, "doc_id").select("doc_id", F.col("doc_id").cast("string").alias("name"), "blocks", "ranges")
    values = lambda rows: [tuple(r.values()) for r in rows]
    return map_values(x, lambda doc_id, name, blocks, ranges: ((doc_id, *r) for r in document_records(name, values(blocks), values(ranges), max_chars)), _record(x))


def records_of(df: DataFrame, ranges: Callable[[int], list[tuple]], max_chars: int) -> DataFrame:
    """`records` of the raw blocks of texts (doc_id, text), named b0 and so on, by the ranges that their number gives: a
    document is parsed and cut at once, and nothing is shuffled."""

    def rows(doc_id, name: str | None, text: str | None) -> Iterator[tuple]:
        blocks = [(i, f"b{i}", t) for i, t in enumerate(raw_texts(text or ""))]
        for r in document_records(name, blocks, ranges(len(blocks)), max_chars):
            yield doc_id, *r

    return map_values(df.select("doc_id", F.col("doc_id").cast("string").alias("name"), "text"), rows, _record(df))


def _record(df: DataFrame) -> StructType:
    text = [StructField(n, StringType()) for n in ("chunk_id", "chunk_title", "chunk_summary", "content", "block_ids")]
    return StructType([df.schema["doc_id"], *text[:3], StructField("char_count", IntegerType()), *text[3:]])


def document_records(name: str | None, blocks: list[tuple], ranges: list[tuple], max_chars: int) -> Iterator[tuple]:
    """(chunk_id, chunk_title, chunk_summary, char_count, content, block_ids) of one document."""
    rows = sorted(((i, block_id, _SPACE.sub(" ", text or "").strip(" ")) for i, block_id, text in blocks if i is not None), key=lambda b: b[0])
    places = [b[0] for b in rows]
    spans: dict[tuple, list[tuple]] = {}
    for nth, start, stop, title, reason in ranges:
        if start is not None and stop is not None:
            found = rows[bisect_left(places, start) : bisect_right(places, stop)]
            if found:
                spans.setdefault((nth, title, reason), []).extend(found)
    index = 0
    for (_, title, reason), found in sorted(spans.items(), key=lambda x: (x[0][0] is not None, x[0][0])):
        parts: list[list[tuple]] = []
        size = 0
        for b in sorted(found, key=lambda b: b[0]):
            n = len(b[2])
            if n and (not parts or size + n + 2 > max_chars):
                parts.append([b])
                size = n
            elif n:
                parts[-1].append(b)
                size += n + 2
        for part, held in enumerate(parts, 1):
            index += 1
            content = "\n\n".join(b[2] for b in held)
            head = title or "未命名分段"
            yield f"{'null' if name is None else name}_ai_chunk_{index:04d}", f"{head}（续{part}）" if part > 1 else head, reason or "", len(content), content, ",".join(b[1] for b in held if b[1] is not None)


def parsed_ranges(answer: Column) -> Column:
    """Ranges in a model's JSON answer: an object's `ranges` or `chunks`, or an array, in a fence or in prose; none if broken."""
    one = "struct<start:int,end:int,title:string,reason:string>"
    text = F.coalesce(answer, F.lit(""))
    whole = F.from_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1), f"ranges array<{one}>, chunks array<{one}>")
    alone = F.from_json(F.regexp_extract(text, r"(?s)(\[.*\])", 1), f"array<{one}>")
    found = F.coalesce(whole["ranges"], whole["chunks"], alone, F.array().cast(f"array<{one}>"))
    return F.transform(F.filter(found, lambda r: r.isNotNull()), lambda r: F.struct(r["start"].alias("start"), r["end"].alias("stop"), r["title"].alias("title"), r["reason"].alias("reason")))
