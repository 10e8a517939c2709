"""Tags, extractive summaries and document summaries by rules."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from itertools import islice, pairwise

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.arrow import bounded
from corpusmill.functions import fixed as K
from corpusmill.functions.text import find_all
from corpusmill.operators.enrich import typed_entities


def tag_tokens(text: Column) -> Column:
    return F.filter(find_all(F.coalesce(text, F.lit("")), K.TAG_TOKEN), lambda t: (F.length(t) >= 2) & ~F.lower(t).isin(*K.TAG_STOPWORDS))


def tags(df: DataFrame, limit: int = K.MAX_TAGS, text_col: str = "text") -> DataFrame:
    """doc_id, nth, tag: neighbours in order of frequency as short bigrams, best first; then single terms.

    Terms stand by falling frequency and first place; a bigram's score is the sum of its two frequencies, and a bigram
    that occurs again keeps its first place.
    """
    terms = df.select("doc_id", F.posexplode(tag_tokens(F.col(text_col))).alias("at", "term"))
    terms = terms.groupBy("doc_id", "term").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("n"), "at")
    ranked = terms.select("doc_id", "term", "n", F.row_number().over(w).alias("place"), F.lead("term").over(w).alias("next"), F.lead("n").over(w).alias("next_n"))
    pairs = ranked.where("next IS NOT NULL").select("doc_id", F.concat("term", "next").alias("tag"), (F.col("n") + F.col("next_n")).alias("score"), "place").where(F.length("tag") <= K.BIGRAM_CHARS)
    pairs = pairs.groupBy("doc_id", "tag").agg(F.max("score").alias("score"), F.min("place").alias("place"), F.lit(0).alias("single"))
    every = pairs.unionByName(ranked.select("doc_id", F.col("term").alias("tag"), F.col("n").alias("score"), "place", F.lit(1).alias("single")))
    firsts = every.groupBy("doc_id", "tag").agg(F.min(F.struct("single", (-F.col("score")).alias("down"), "place")).alias("k"))
    w = Window.partitionBy("doc_id").orderBy("k")
    return firsts.select("doc_id", F.row_number().over(w).alias("nth"), "tag").where(F.col("nth") <= limit)


def _tags(limit: int):
    """`tags` of one text."""
    token, stop = re.compile("[一-鿿]{2,}|[A-Za-z0-9_]{2,}"), frozenset(K.TAG_STOPWORDS)

    def of(text: str | None) -> list[str]:
        found = Counter(token.findall(text or ""))  # in order of first places
        terms = sorted(((t, n) for t, n in found.items() if t.lower() not in stop), key=lambda x: -x[1])
        best: dict[str, tuple[int, int]] = {}
        for place, ((a, n), (b, m)) in enumerate(pairwise(terms)):
            if len(tag := a + b) <= K.BIGRAM_CHARS:
                down, first = best.get(tag, (0, place))
                best[tag] = min(down, -n - m), first
        out = sorted(best, key=best.__getitem__)[:limit]
        return out + [t for t, _ in islice((x for x in terms if x[0] not in best), limit - len(out))]

    return of


def rule_tags(text: Column, limit: int = K.MAX_TAGS) -> Column:
    """The tags of each text by itself, best first: nothing is shuffled."""
    return F.udf(_tags(limit), "array<string>", useArrow=True)(text)


def _summary(limit: int):
    sentence, token, stop = re.compile(K.SENTENCE), re.compile(K.TAG_TOKEN), frozenset(K.TAG_STOPWORDS)

    def words(t: str) -> list[str]:
        return [w for w in token.findall(t) if len(w) > 1 and w.lower() not in stop]

    def summary(text: str | None) -> str:
        text = text or ""
        parts = [s for m in sentence.finditer(text) if (s := m.group(0).strip())] or [text.strip()]
        if len(parts) <= 2:
            return "".join(parts).strip()[:limit]
        counts, room, picked = Counter(words(text)), limit - len(parts[0]), [0]
        # A sentence that occurs again stands at its last place, as equal sentences cannot be told apart.
        place = {s: i for i, s in enumerate(parts)}
        for s in sorted(parts[1:], key=lambda s: -sum(counts[w] for w in words(s))):
            if room <= 0:
                break
            if s != parts[0] and len(s) <= room + 20:
                picked.append(place[s])
                room -= len(s)
        picked[0] = place[parts[0]]
        return "".join(parts[i] for i in sorted(picked)).strip()[:limit]

    return summary


def extractive_summary(text: Column, limit: int = K.SUMMARY_CHARS) -> Column:
    """The first sentence and the best others that fit (20 characters over at most), in their order, cut at the limit."""
    return F.udf(_summary(limit), "string", useArrow=True)(text)


def document_summary(summaries: DataFrame, limit: int = K.DOC_SUMMARY_CHARS) -> DataFrame:
    """doc_id, summary from rows (doc_id, nth, summary)."""
    kept = summaries.where("summary <> ''")
    return kept.groupBy("doc_id").agg(F.left(F.expr("listagg(summary, '；') WITHIN GROUP (ORDER BY nth)"), F.lit(limit)).alias("summary"))


def parse_tags(answer: Column) -> Column:
    """Tags in a model's answer: parts at commas and line breaks, at most 20 characters each, five of them."""
    parts = F.transform(F.split(answer, "[,，、\n]"), lambda p: F.trim(F.regexp_replace(p, "^[-•*#\\s]+", "")))
    return F.slice(F.filter(parts, lambda p: (p != "") & (F.length(p) <= 20)), 1, K.MAX_TAGS)


def parse_entities(answer: Column) -> Column:
    """`type: value` lines of a model's answer."""
    rows = F.filter(F.split(answer, "\n"), lambda r: r.rlike("^[^:：]+[:：].*\\S"))
    return F.transform(rows, lambda r: F.struct(F.trim(F.regexp_extract(r, "^([^:：]+)[:：]", 1)).alias("type"), F.trim(F.regexp_extract(r, "^[^:：]+[:：](.*)$", 1)).alias("value")))


#: A language model as a column function: what it answers to prompts; null where it has no answer.
Model = Callable[[Column], Column]


def organized(chunks: DataFrame, model: Model | None = None) -> DataFrame:
    """chunk_id, doc_id, nth, tags, summary, entities, source of chunks (chunk_id, doc_id, nth, content).

    With a model its parsed answers count, and rules wherever it gives none (`source` says which); blank chunks get empty
    results. Without a model nothing is asked.
    """
    text = F.coalesce("content", F.lit(""))
    blank = ~text.rlike(r"(?U)\S")
    none = F.array().cast("array<string>")
    bounded(chunks)
    ask = lambda what: F.nullif(F.trim(model(F.concat(F.lit(what + ":\n"), text))), F.lit("")) if model else F.lit(None).cast("string")
    x = chunks.select("chunk_id", "doc_id", "nth", text.alias("content"), blank.alias("blank"), rule_tags(text).alias("rule_tags"), ask("tags").alias("m_tags"), ask("summary").alias("m_summary"), ask("entities").alias("m_entities"))
    m_tags, m_entities = parse_tags(F.col("m_tags")), parse_entities(F.col("m_entities"))
    given = lambda xs: F.coalesce(F.size(xs) > 0, F.lit(False))
    entities = typed_entities(F.col("content"))
    return x.select(
        "chunk_id",
        "doc_id",
        "nth",
        F.when(F.col("blank"), none).when(given(m_tags), m_tags).otherwise(F.col("rule_tags")).alias("tags"),
        F.when(F.col("blank"), "").otherwise(F.coalesce("m_summary", extractive_summary(F.col("content")))).alias("summary"),
        F.when(F.col("blank"), F.slice(entities, 1, 0)).when(given(m_entities), m_entities).otherwise(entities).alias("entities"),
        F.when(F.col("blank"), "empty").when(given(m_tags) | F.col("m_summary").isNotNull() | given(m_entities), "model").otherwise("rule").alias("source"),
    )


def organized_batch(chunks: DataFrame, model: Model | None = None) -> tuple[DataFrame, DataFrame]:
    """The organised chunks, and their documents' summaries."""
    each = organized(chunks, model)
    return each, document_summary(each.select("doc_id", "nth", "summary"))
