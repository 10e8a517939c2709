"""Stores of chunks that are searched by vectors or by character TF-IDF, within each query's document.

A store holds a DataFrame of chunks: doc_id, ordinal, chunk_id, content, and where there are any chunk_type, title_path,
section_titles and retrieval_text. Searching joins the queries (query_id, doc_id, question) to their document's chunks,
adds a ranker's boost to the similarity and keeps the k best of each query.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from corpusmill.arrow import map_values
from corpusmill.functions.text import e6
from corpusmill.operators.retrieve import lexical_boost, trigram_counts

#: An encoder turns a text into its sparse vector, an array of (bucket, n); a ranker gives what is added to a similarity.
Encoder = Callable[[Column], Column]
Ranker = Callable[[Column, Column, Column], Column]
ENCODERS: dict[str, Encoder] = {"trigrams": trigram_counts}
RANKERS: dict[str, Ranker] = {"lexical": lexical_boost, "none": lambda question, text, chunk_type: F.lit(0.0)}


def register_encoder(name: str, encoder: Encoder) -> None:
    ENCODERS[name] = encoder


def encoder(name: str | None = None) -> Encoder:
    """By name; the hashed trigrams where no name is given, or where a preferred one is not there."""
    return ENCODERS.get(name or "trigrams", trigram_counts)


def sparse_cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of (bucket, n), 0 if either is empty."""
    total = lambda xs, f: F.aggregate(xs, F.lit(0).cast("long"), lambda acc, x: acc + f(x))
    square = lambda xs: total(xs, lambda x: x["n"].cast("long") * x["n"])

    def of(s: Column) -> Column:
        inner = total(s["a"], lambda x: x["n"] * F.coalesce(F.try_element_at(s["table"], x["bucket"]), F.lit(0)))
        norm = F.sqrt(square(s["a"]).cast("double")) * F.sqrt(square(s["b"]).cast("double"))
        return F.coalesce(inner / F.nullif(norm, F.lit(0.0)), F.lit(0.0))

    # The vectors and the table are worked out once, as an element, and not for each bucket.
    table = F.map_from_entries(F.transform(b, lambda x: F.struct(x["bucket"], x["n"])))
    return F.get(F.transform(F.array(F.struct(a.alias("a"), b.alias("b"), table.alias("table"))), of), 0)


def _optional(chunks: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in chunks.columns else F.lit(None).cast(kind)


def index_text(chunks: DataFrame) -> Column:
    """The retrieval text; else the content behind its path and section titles."""
    none = F.array().cast("array<string>")
    path, titles = (F.coalesce(_optional(chunks, c, "array<string>"), none) for c in ("title_path", "section_titles"))
    head = F.concat_ws(" | ", F.nullif(F.array_join(path, " > "), F.lit("")), F.nullif(F.array_join(titles, "；"), F.lit("")))
    content = F.coalesce("content", F.lit(""))
    body = F.when(head != "", F.concat(head, F.lit(": "), content)).otherwise(content)
    own = _optional(chunks, "retrieval_text", "string")
    return F.when(F.trim(own) != "", own).otherwise(body)


@dataclass(frozen=True)
class Store:
    """Indexed chunks and how they are searched."""

    chunks: DataFrame
    method: str = "vectors"
    encode: Encoder = trigram_counts
    rank: Ranker = lexical_boost

    @classmethod
    def of(cls, chunks: DataFrame, method: str = "vectors", encode: Encoder | str | None = None, rank: Ranker | str = "lexical") -> Store:
        """Indexes chunks; without any there is nothing to index, which is an error."""
        if chunks.isEmpty():
            raise ValueError("no chunks to index")
        kind = F.coalesce(_optional(chunks, "chunk_type", "string"), F.lit("normal"))
        kept = chunks.select("doc_id", "ordinal", "chunk_id", "content", kind.alias("chunk_type"), index_text(chunks).alias("text"))
        return cls(kept, method, encode if callable(encode) else encoder(encode), rank if callable(rank) else RANKERS[rank])

    def summary(self) -> DataFrame:
        """doc_id, chunk_count of each indexed document."""
        return self.chunks.groupBy("doc_id").agg(F.count("*").alias("chunk_count"))

    def documents(self) -> DataFrame:
        """The indexed documents, sorted."""
        return self.chunks.select("doc_id").distinct().orderBy("doc_id")

    def unknown(self, queries: DataFrame) -> DataFrame:
        """Queries whose document is not indexed."""
        return queries.join(self.documents(), "doc_id", "left_anti")

    def replaced(self, chunks: DataFrame) -> Store:
        """The store with the given documents' chunks in place of what it had of them."""
        new = Store.of(chunks, self.method, self.encode, self.rank)
        return Store(self.chunks.join(new.documents(), "doc_id", "left_anti").unionByName(new.chunks), self.method, self.encode, self.rank)

    def search(self, queries: DataFrame, k: int = 5, strict: bool = False) -> DataFrame:
        """query_id, rank, doc_id, chunk_id, ordinal, content, chunk_type, similarity_e6, score_e6 of the k best (1 at least).

        Scores are compared in millionths; of equal ones the later chunk stands first. Queries on documents that are not
        indexed give no rows, or an error if `strict`.
        """
        if strict and not (lost := self.unknown(queries)).isEmpty():
            raise KeyError(f"not indexed: {lost.first()['doc_id']}")
        scored = self._by_tfidf(queries) if self.method == "tfidf" else self._by_vectors(queries)
        score = F.col("similarity_e6") + e6(self.rank(F.col("question"), F.col("text"), F.col("chunk_type")))
        w = Window.partitionBy("query_id").orderBy(F.desc("score_e6"), F.desc("ordinal"))
        best = scored.withColumn("score_e6", score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(1, k))
        return best.select("query_id", "rank", "doc_id", "chunk_id", "ordinal", "content", "chunk_type", "similarity_e6", "score_e6")

    def _by_vectors(self, queries: DataFrame) -> DataFrame:
        asked = queries.select("query_id", "doc_id", "question", self.encode(F.col("question")).alias("q"))
        held = self.chunks.withColumn("v", self.encode(F.col("text")))
        return asked.join(held, "doc_id").withColumn("similarity_e6", e6(sparse_cosine(F.col("q"), F.col("v")))).drop("q", "v")

    def _by_tfidf(self, queries: DataFrame) -> DataFrame:
        """Each document is an index of its own: frequencies are those among its chunks, and grams it lacks do not count.

        A document's texts are brought together and scored in one task, so no gram is shuffled; the grams of documents of
        over LARGE chunks are spread over tasks instead.
        """
        asked = queries.select("query_id", "doc_id", "question")
        sizes = self.chunks.groupBy("doc_id").agg(F.count("*").alias("docs"))
        large = sizes.where(F.col("docs") > LARGE)
        if large.isEmpty():
            return _tfidf_within(asked, self.chunks)
        small = _tfidf_within(asked, self.chunks.join(large, "doc_id", "left_anti"))
        return small.unionByName(_tfidf_across(asked, self.chunks.join(large.select("doc_id"), "doc_id", "left_semi"), large))


#: Chunks of a document that is searched by TF-IDF in one task.
LARGE = 2000


def _lowered(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s\s+", " ")


def _tfidf_within(asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """The pairs of queries and chunks of a document with their similarity_e6, a document at a time."""
    def of_document(df: DataFrame, name: str, low: str) -> DataFrame:
        row = F.struct(_lowered(F.col(low)).alias("low"), *[c for c in df.columns if c != "doc_id"])
        return df.groupBy("doc_id").agg(F.collect_list(row).alias(name))  # LARGE chunks at most

    both = of_document(chunks, "held", "text").join(of_document(asked, "asked", "question"), "doc_id").select("doc_id", "asked", "held")
    queries, rows = (StructType(both.schema[c].dataType.elementType.fields[1:]) for c in ("asked", "held"))
    schema = StructType([both.schema["doc_id"], *queries, *rows, StructField("similarity_e6", LongType())])
    q_id, c_id, q_names, c_names = "query_id", "chunk_id", queries.names, rows.names

    def scored(doc_id, asked: list[dict], held: list[dict]) -> Iterator[tuple]:
        counts = _counted(held, c_id)
        df = Counter(g for c in counts.values() for g in c)
        idf = {g: math.log((1 + len(held)) / (1 + n)) + 1 for g, n in df.items()}
        wanted = {k: _weights(c, idf) for k, c in _counted(asked, q_id).items()}
        norms = {k: _norm(c, idf) for k, c in counts.items()}
        for q in asked:
            own = wanted[q[q_id]]
            for row in held:
                c, norm = counts[row[c_id]], norms[row[c_id]]
                s = math.fsum(w * ((1 + math.log(n)) * idf[g] / norm) for g, w in own.items() if (n := c.get(g)))
                yield (doc_id, *[q[n] for n in q_names], *[row[n] for n in c_names], math.floor(s * 1_000_000 + 0.5))

    return map_values(both, scored, schema)


def _counted(rows: list[dict], key: str, low: int = 1, high: int = 4) -> dict:
    """The grams of each item's texts, counted."""
    out: dict = {}
    for row in rows:
        t = row["low"]
        found = Counter(chain.from_iterable(map("".join, zip(*(t[i:] for i in range(n)), strict=False)) for n in range(low, high + 1)))
        out[row[key]] = out[row[key]] + found if row[key] in out else found
    return out


def _norm(counts: Counter, idf: dict[str, float]) -> float:
    return math.sqrt(math.fsum(((1 + math.log(n)) * idf[g]) ** 2 if n > 1 else idf[g] ** 2 for g, n in counts.items() if g in idf))


def _weights(counts: Counter, idf: dict[str, float]) -> dict[str, float]:
    """Sublinear frequencies times the document's idf, to length 1, without grams that the document lacks."""
    norm = _norm(counts, idf)
    return {g: (1 + math.log(n)) * idf[g] / norm for g, n in counts.items() if g in idf}


def _tfidf_across(asked: DataFrame, chunks: DataFrame, sizes: DataFrame) -> DataFrame:
    """As `_tfidf_within`, a gram of a document at a time."""
    held = gram_counts(chunks.select("doc_id", F.col("chunk_id").alias("item"), "text"))
    spread = held.groupBy("doc_id", "gram").agg(F.count("*").alias("df"))
    idf = spread.join(sizes, "doc_id").select("doc_id", "gram", (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1).alias("idf"))
    wanted = gram_counts(asked.select("doc_id", F.col("query_id").alias("item"), F.col("question").alias("text")))
    v = weighted(held, idf).select("doc_id", F.col("item").alias("chunk_id"), "gram", F.col("w").alias("v"))
    q = weighted(wanted, idf).select("doc_id", F.col("item").alias("query_id"), "gram", F.col("w").alias("q"))
    inner = q.join(v, ["doc_id", "gram"]).groupBy("query_id", "doc_id", "chunk_id").agg(F.sum(F.col("q") * F.col("v")).alias("s"))
    pairs = asked.join(chunks, "doc_id")
    return pairs.join(inner, ["query_id", "doc_id", "chunk_id"], "left").withColumn("similarity_e6", e6(F.coalesce("s", F.lit(0.0)))).drop("s")


def gram_counts(df: DataFrame, low: int = 1, high: int = 4) -> DataFrame:
    """doc_id, item, gram, c: lower-cased character n-grams of (doc_id, item, text); runs of white space are one blank."""
    t = _lowered(F.col("text"))

    def grams_of(n: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length("t") - n + 1, F.lit(1)))
        return F.when(F.length("t") >= n, F.transform(places, lambda i: F.substr("t", i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    every = F.flatten(F.array(*[grams_of(n) for n in range(low, high + 1)]))
    return df.select("doc_id", "item", t.alias("t")).select("doc_id", "item", F.explode(every).alias("gram")).groupBy("doc_id", "item", "gram").agg(F.count("*").alias("c"))


def weighted(counts: DataFrame, idf: DataFrame) -> DataFrame:
    """doc_id, item, gram, w: sublinear frequency times the document's idf, each item to length 1."""
    x = counts.join(idf, ["doc_id", "gram"]).withColumn("w", (1 + F.log("c")) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id", "item")))
    return x.select("doc_id", "item", "gram", (F.col("w") / norm).alias("w"))


def answer_prompt(hits: DataFrame, limit: int = 800) -> DataFrame:
    """query_id, prompt: the hits (query_id, rank, title_path, content, question) as contexts above their question."""
    title = F.coalesce(F.nullif(F.array_join("title_path", " > "), F.lit("")), F.lit("无标题"))
    part = F.concat(F.lit("["), title, F.lit("]\n"), F.left(F.coalesce("content", F.lit("")), F.lit(limit)))
    x = hits.select("query_id", "rank", "question", part.alias("part")).groupBy("query_id", "question")
    x = x.agg(F.expr("listagg(part, '\n\n---\n\n') WITHIN GROUP (ORDER BY rank)").alias("context"))
    return x.select("query_id", F.concat(F.lit("文档片段：\n"), "context", F.lit("\n\n问题："), "question", F.lit("\n\n回答：")).alias("prompt"))


def answered(hits: DataFrame, model: Callable[[Column], Column] | None = None) -> DataFrame:
    """query_id, prompt, answer: the model's, or an empty one without a model or where it gives none."""
    x = answer_prompt(hits)
    return x.withColumn("answer", F.coalesce(model(F.col("prompt")) if model else F.lit(None).cast("string"), F.lit("")))


def hit_pages(refs: Column) -> Column:
    """Distinct pages of source references in their order."""
    return F.array_distinct(F.filter(F.transform(refs, lambda r: r["page"]), lambda p: p.isNotNull()))
