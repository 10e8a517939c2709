"""Enrichment of chunks: summaries, entities, keywords, labels, back-links, retrieval text."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from heapq import nlargest
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from corpusmill.arrow import bounded, map_values
from corpusmill.functions import fixed as K
from corpusmill.functions.text import dedupe_ci, find_all, first_ci, norm_ws


def lead_summary(text: Column, limit: int = K.SUMMARY_CHARS) -> Column:
    """Whole sentences from the start, the last one cut at the limit; blanks between sentences go."""
    t = norm_ws(text)
    whole = F.regexp_replace(t, f"({K.SUMMARY_END}) ", "$1")
    first = F.regexp_extract(t, f"^[^。！？!?；;]*{K.SUMMARY_END}?", 0)
    return F.when(F.length(first) >= limit, F.left(whole, F.lit(limit))).otherwise(F.trim(F.left(whole, F.lit(limit))))


def entity_tags(text: Column, limit: int = K.MAX_ENTITIES) -> Column:
    """Dates, versions, quoted terms, organisations and technical terms, in that order, without repeats.

    The text and its lower case are elements of arrays, so that they are worked out once and not for each pattern.
    """
    none = F.array().cast("array<string>")

    def of(t: Column, low: Column) -> Column:
        # What every match holds is looked for first.
        quoted = [F.when(F.contains(t, F.lit(p.removeprefix("(")[0])), find_all(t, p, 1)).otherwise(none) for p in K.QUOTED]
        found = [find_all(t, K.ENTITY_DATE), F.when(F.contains(t, F.lit(".")), find_all(t, K.ENTITY_VERSION)).otherwise(none), *quoted]
        found += [F.when(F.contains(t, F.lit(s)), find_all(t, f"[一-鿿A-Za-z0-9]{{2,20}}{s}")).otherwise(none) for s in K.ORG_SUFFIXES]
        terms = [F.when(F.contains(t, F.lit(term)) | (F.contains(low, F.lit(term.lower())) & t.rlike(rf"(?iU)\b{term}\b")), F.lit(term)) for term in K.TECH_TERMS]
        return F.filter(F.transform(F.flatten(F.array(*found, F.array_compact(F.array(*terms)))), lambda x: F.trim(x)), lambda x: x != "")

    every = F.get(F.transform(F.array(norm_ws(text)), lambda t: F.get(F.transform(F.array(F.lower(t)), lambda low: of(t, low)), 0)), 0)
    # Whole repeats go by a hash first: the rest is compared with what was kept before, `limit` at most.
    return first_ci(F.array_distinct(every), limit)


def typed_entities(text: Column) -> Column:
    """Distinct (type, value) in the order of the types and of their places."""
    def of(kind: str, pattern: str) -> Column:
        return F.transform(find_all(F.coalesce(text, F.lit("")), pattern), lambda v: F.struct(F.lit(kind).alias("type"), F.trim(v).alias("value")))

    parts = [of(kind, pattern) for kind, pattern in K.TYPED_ENTITIES]
    return F.array_distinct(F.flatten(F.array(*parts)))


def keyword_tokens(text: Column) -> Column:
    """Latin runs, and Han runs as bigrams; stop words, digits and very short Latin words are no keywords."""
    runs = find_all(F.coalesce(text, F.lit("")), r"[一-鿿]+|[\p{L}\p{N}_]+")
    split = lambda r: F.when(r.rlike("^[一-鿿]{3,}$"), F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substr(r, i, F.lit(2)))).otherwise(F.array(r))
    valid = lambda t: ~F.lower(t).isin(*K.KEYWORD_STOPWORDS) & (F.length(t) >= 2) & ~t.rlike(r"\p{Nd}|^_+$") & ~F.lower(t).rlike("^[a-z]{1,2}$")
    return F.filter(F.flatten(F.transform(runs, split)), valid)


def _terms(df: DataFrame, text_col: str) -> DataFrame:
    return df.select("doc_id", F.explode(keyword_tokens(F.col(text_col))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n"))


def keywords_freq(df: DataFrame, k: int, text_col: str = "text") -> DataFrame:
    """doc_id, rank, term, n: the most frequent terms, ties by term."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("n"), "term")
    return _terms(df, text_col).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Terms whose frequencies go to all tasks; and terms that a task counts at a time.
FREQUENT, COUNTED = 200_000, 500_000


def keywords_tfidf(df: DataFrame, k: int, text_col: str = "text") -> DataFrame:
    """doc_id, rank, term, n, df: by n * ln((1 + N) / (1 + df)) in millionths, ties by term; frequencies of this corpus.

    The frequencies of the most frequent terms go to all tasks. With them, and as the others are no more frequent than
    these, each document leaves out what cannot be among its k best, so only few of its terms are shuffled.
    """
    total = df.count()
    texts = df.select("doc_id", F.col(text_col).alias("text"))
    if not texts.groupBy("doc_id").count().where(F.col("count") > 1).isEmpty():
        texts = texts.groupBy("doc_id").agg(F.concat_ws("\n", F.collect_list("text")).alias("text"))  # rows of one id are one document
    bounded(texts)
    spread = texts.select("text").mapInArrow(_frequencies, "term string, df long").groupBy("term").agg(F.sum("df").alias("df")).persist()
    held = {r["df"]: r["n"] for r in spread.groupBy(F.least("df", F.lit(1000)).alias("df")).agg(F.count("*").alias("n")).collect()}
    least, n = max(held, default=1) + 1, 0
    while least > 1 and n + held.get(least - 1, 0) <= FREQUENT:
        least -= 1
        n += held.get(least, 0)
    frequent = {r["term"]: r["df"] for r in spread.where(F.col("df") >= least).collect()}  # FREQUENT at most
    kept = map_values(texts, _Best(k, total, frequent, least), StructType([texts.schema["doc_id"], *_KEPT]))
    rare = kept.where("df IS NULL").drop("df").join(spread.where(F.col("df") < least), "term").select("doc_id", "term", "n", "df")
    weight = F.floor(F.col("n") * F.log(F.lit(1 + total) / (1 + F.col("df"))) * 1_000_000 + 0.5).cast("long")
    scored = kept.where("df IS NOT NULL").unionByName(rare).withColumn("weight_e6", weight)
    w = Window.partitionBy("doc_id").orderBy(F.desc("weight_e6"), "term")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


_KEPT = (StructField("term", StringType()), StructField("n", LongType()), StructField("df", LongType()))
_RUN, _HAN = re.compile(r"[一-鿿]+|\w+"), re.compile("[一-鿿]{3,}")
_STOPWORDS = frozenset(K.KEYWORD_STOPWORDS)


def _is_keyword(t: str) -> bool:
    low = t.lower()
    if low in _STOPWORDS or len(t) < 2 or len(low) <= 2 and low.isascii() and low.isalpha():
        return False
    return t.isalpha() or not any(c.isdecimal() for c in t) and t.strip("_") != ""


def _keywords(text: str | None) -> dict[str, int]:
    """`keyword_tokens` of one text, counted."""
    out: dict[str, int] = {}
    for run, n in Counter(_RUN.findall(text or "")).items():
        if "一" <= run[0] <= "鿿" and _HAN.fullmatch(run):
            for i in range(len(run) - 1):
                if _is_keyword(t := run[i : i + 2]):
                    out[t] = out.get(t, 0) + n
        elif _is_keyword(run):
            out[run] = out.get(run, 0) + n
    return out


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, df: in how many of a partition's documents each term is; COUNTED terms at most are held, and then given out."""
    counts: Counter[str] = Counter()
    schema = pa.schema([("term", pa.string()), ("df", pa.int64())])

    def parts() -> Iterator[pa.RecordBatch]:
        items = iter(counts.items())
        while part := list(islice(items, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)
        counts.clear()

    for batch in batches:
        for text in batch.column(0).to_pylist():
            counts.update(_keywords(text).keys())
            if len(counts) >= COUNTED:
                yield from parts()
    yield from parts()


class _Best:
    """The terms of a document that can be among its k best: their df, or none where only `spread` has it."""

    def __init__(self, k: int, total: int, frequent: dict[str, int], least: int) -> None:
        self.k, self.frequent = k, frequent
        weight = lambda df: math.log((1 + total) / (1 + df))
        self.weights = {df: weight(df) for df in set(frequent.values())}
        self.low, self.high = weight(least - 1), weight(1)  # of terms that are not frequent

    def __call__(self, doc_id, text: str | None) -> list[tuple]:
        terms = [(t, n, self.frequent.get(t)) for t, n in _keywords(text).items()]
        lows = nlargest(self.k, (n * (self.low if df is None else self.weights[df]) for _, n, df in terms))
        bar = lows[-1] - 1e-5 if len(lows) == self.k else -math.inf  # a weight is compared in millionths
        return [(doc_id, t, n, df) for t, n, df in terms if n * (self.high if df is None else self.weights[df]) >= bar]


#: Named keyword strategies: DataFrame and k to ranked terms.
KEYWORD_STRATEGIES: dict[str, Callable[..., DataFrame]] = {"freq": keywords_freq, "tfidf": keywords_tfidf}


def keyword_strategy(name: str | None = None) -> Callable[..., DataFrame]:
    key = (name or "tfidf").strip().lower()
    if key not in KEYWORD_STRATEGIES:
        raise ValueError(f"unknown keyword strategy {key}; there are {', '.join(sorted(KEYWORD_STRATEGIES))}")
    return KEYWORD_STRATEGIES[key]


def labels(chunks: DataFrame, strategy: str | None = None) -> DataFrame:
    """chunk_id, label: two keywords of the title path and four of the content, without repeats; else the chunk's type."""
    extract = keyword_strategy(strategy)

    def top(text: Column, k: int) -> DataFrame:
        ranked = extract(chunks.select(F.col("chunk_id").alias("doc_id"), text.alias("text")), k)
        return ranked.groupBy("doc_id").agg(F.expr("transform(array_sort(collect_list(struct(rank, term))), x -> x.term)").alias("terms"))

    title = top(F.array_join("title_path", " "), 2).select(F.col("doc_id").alias("chunk_id"), F.col("terms").alias("a"))
    body = top(F.col("content"), 4).select(F.col("doc_id").alias("chunk_id"), F.col("terms").alias("b"))
    none = F.array().cast("array<string>")
    every = F.slice(dedupe_ci(F.concat(F.coalesce("a", none), F.coalesce("b", none))), 1, K.MAX_LABELS)
    out = chunks.select("chunk_id", "chunk_type").join(title, "chunk_id", "left").join(body, "chunk_id", "left")
    return out.select("chunk_id", F.when(F.size(every) > 0, every).otherwise(F.array("chunk_type")).alias("label"))


def backlink(doc_id: Column, chunk_id: Column, ref_ids: Column, pages: Column) -> Column:
    return F.struct(
        F.lit("source_refs_v1").alias("kind"),
        doc_id.alias("doc_id"),
        chunk_id.alias("chunk_id"),
        F.get(ref_ids, 0).alias("primary_ref"),
        dedupe_ci(ref_ids).alias("source_ref_ids"),
        F.struct(F.array_min(pages).alias("start"), F.array_max(pages).alias("end")).alias("page_span"),
        F.size(ref_ids).alias("source_ref_count"),
    )


def retrieval_text(title_path: Column, titles: Column, metrics: Column, chunk_type: Column, content: Column) -> Column:
    """What is indexed for a chunk: its path, sections and metrics above its content."""
    line = lambda head, items, sep: F.when(F.size(items) > 0, F.concat(F.lit(head), F.array_join(F.filter(items, lambda x: F.trim(x) != ""), sep)))
    kind = F.when(chunk_type == "metric", F.lit("内容类型: 技术指标 验收标准 评价指标 百分比 阈值"))
    return F.trim(F.concat_ws("\n", line("标题路径: ", title_path, " > "), line("包含小节: ", titles, "；"), line("关键指标: ", metrics, "；"), kind, F.when(F.trim(content) != "", content)))


def retrieval_document(c: DataFrame) -> Column:
    """The retrieval text, or else labelled lines of what the chunk has."""
    items = lambda head, col, sep: F.when(F.size(col) > 0, F.concat(F.lit(head), F.array_join(F.filter(col, lambda x: F.trim(x) != ""), sep)))
    word = lambda head, col: F.when(F.trim(col) != "", F.concat(F.lit(head), F.trim(col)))
    composed = F.concat_ws(
        "\n",
        items("标题路径: ", c["title_path"], " / "),
        items("包含小节: ", c["section_titles"], " / "),
        items("标签: ", c["label"], ", "),
        items("实体: ", c["entity_tags"], ", "),
        word("摘要: ", c["summary"]),
        word("正文: ", c["content"]),
    )
    return F.coalesce(F.nullif(F.trim(c["retrieval_text"]), F.lit("")), composed)
