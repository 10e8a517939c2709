"""Vectors, lexical scores and top-k retrieval."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegralType, LongType, StructField, StructType

from corpusmill.arrow import bounded
from corpusmill.functions import fixed as K
from corpusmill.functions.text import compact, e6, find_all
from corpusmill.operators.joins import spread_join

#: Rows of a query side that is sent to all tasks; longer ones go in blocks.
QUERY_BLOCK = 10_000


def trigram_counts(text: Column) -> Column:
    """(bucket, n) of lower-cased character trigrams by CRC-32 modulo VECTOR_SIZE; a shorter text has none.

    Each step is the one element of an array, so that a lambda takes it as it is and does not work it out again.
    """
    places = lambda t: F.when(F.length(t) >= 3, F.sequence(F.lit(1), F.greatest(F.length(t) - 2, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    buckets = F.transform(F.array(F.lower(F.coalesce(text, F.lit("")))), lambda t: F.transform(places(t), lambda i: F.crc32(F.substr(t, i, F.lit(3)).cast("binary")) % K.VECTOR_SIZE))
    counts = F.transform(buckets, lambda bs: F.transform(F.array_sort(F.array_distinct(bs)), lambda b: F.struct(b.cast("int").alias("bucket"), F.size(F.filter(bs, lambda x: x == b)).alias("n"))))
    return F.get(counts, 0)


def trigram_vector(text: Column) -> Column:
    """Dense vector of length 1 (or all 0)."""
    counts = trigram_counts(text)
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda acc, x: acc + x["n"] * x["n"]))
    table = F.map_from_arrays(F.transform(counts, lambda x: x["bucket"]), F.transform(counts, lambda x: x["n"]))
    return F.transform(F.sequence(F.lit(0), F.lit(K.VECTOR_SIZE - 1)), lambda i: F.coalesce(F.try_element_at(table, i) / F.nullif(norm, F.lit(0.0)), F.lit(0.0)).cast("float"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0)), F.lit(0.0))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda acc, x: acc + x)


def nearest(queries: DataFrame, vectors: DataFrame, k: int, measure: str = "cosine") -> DataFrame:
    """query_id, vec_id, score_e6, rank: the k best of all vectors for each query (a stated query set against all rows).

    Queries go to all tasks in blocks of QUERY_BLOCK, and each task keeps k a query. Products of whole blocks only tell
    which pairs can be among the k best; those are scored as `cosine` and `squared_distance` do, term by term. Scores are
    compared in millionths, ties by id. A vector that is null or does not fit the query counts as those functions have it.
    """
    spark = vectors.sparkSession
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    kinds = {"query_id": queries.schema["query_id"], "vec_id": vectors.schema["vec_id"]}
    schema = StructType([*kinds.values(), StructField("score_e6", LongType())])
    w = Window.partitionBy("query_id").orderBy(F.desc("score_e6"), "vec_id")
    if not isinstance(kinds["vec_id"].dataType, IntegralType):  # whole numbers stand for other ids; numbering them is one task's work
        ids = vectors.select("vec_id").distinct().withColumn("nth", F.row_number().over(Window.orderBy("vec_id")).cast("long"))
        numbered = vectors.join(ids, vectors["vec_id"].eqNullSafe(ids["vec_id"])).select(F.col("nth").alias("vec_id"), "v")
        return nearest(queries, numbered, k, measure).join(ids.withColumnRenamed("vec_id", "id"), F.col("vec_id") == F.col("nth")).select("query_id", F.col("id").alias("vec_id"), "score_e6", "rank")
    # A file of vectors is small and would be one task; what is dealt out is read once a block.
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<double>").alias("v")).repartition(spark.sparkContext.defaultParallelism)
    bounded(rows)
    out = None
    for b in range(blocks):
        block = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).select("query_id", F.col("q").cast("array<double>").alias("q")).collect()  # a block is bounded
        part = rows.mapInArrow(Nearest([r["query_id"] for r in block], [r["q"] for r in block], k, measure == "cosine", to_arrow_schema(schema)), schema)
        out = part if out is None else out.unionByName(part)
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Products, and pairs scored term by term, that a task holds at a time.
PRODUCTS, PAIRS = 1 << 21, 1 << 14
#: What stands for no score and for no id: both come last, or first, as nulls do.
NONE = -(1 << 63)


class Nearest:
    """The k best of a partition's vectors for each query of a block."""

    def __init__(self, ids: list, queries: list, k: int, by_cosine: bool, schema: pa.Schema) -> None:
        self.ids, self.k, self.by_cosine, self.schema = ids, k, by_cosine, schema
        self.width = max((len(q) for q in queries if q is not None), default=0)
        self.q, self.q_fits = fitted(queries, self.width)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(self.ids)
        if not n:
            return
        self.q_square = squares(self.q)
        self.score, self.found, self.there = np.full((n, self.k), NONE), np.full((n, self.k), NONE), np.zeros((n, self.k), bool)
        step = max(1, PRODUCTS // n)
        for batch in batches:
            ids = np.array([NONE if x is None else x for x in batch.column(0).to_pylist()], np.int64)
            v, fits = fitted_column(batch.column(1), self.width)
            for at in range(0, len(ids), step):
                self.add(ids[at : at + step], v[at : at + step], fits[at : at + step])
        own, place = np.nonzero(self.there)
        for at in range(0, len(own), 1 << 15):
            o, p = own[at : at + (1 << 15)], place[at : at + (1 << 15)]
            null = lambda x: None if x == NONE else x
            columns = [self.ids[i] for i in o], [null(x) for x in self.found[o, p].tolist()], [null(x) for x in self.score[o, p].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)

    def add(self, ids: np.ndarray, v: np.ndarray, fits: np.ndarray) -> None:
        v_square = squares(v)
        fit = fits[:, None] & self.q_fits
        with np.errstate(divide="ignore", invalid="ignore"):
            near = v @ self.q.T
            if self.by_cosine:
                near /= np.sqrt(v_square)[:, None] * np.sqrt(self.q_square)
                near = np.where(fit & ((v_square != 0)[:, None] & (self.q_square != 0)), near * 1e6, 0.0)
                slack = 0.51
            else:
                near = (2 * near - v_square[:, None] - self.q_square) * 1e6
                slack = 0.51 + 1e6 * 1e-13 * (v_square.max(initial=0) + self.q_square)
                near = np.where(fit, near, -np.inf)
        full = self.there[:, -1]
        least = np.where(full & (self.score[:, -1] != NONE), self.score[:, -1] - slack, -np.inf)
        if len(ids) > self.k and not full.all():  # then the k best of these rows are a bound
            least = np.maximum(least, np.partition(near, len(ids) - self.k, axis=0)[len(ids) - self.k] - 2 * slack)
        row, own = np.nonzero(~(near < least))
        for at in range(0, len(row), PAIRS):
            self.keep(own[at : at + PAIRS], *self.scored(row[at : at + PAIRS], own[at : at + PAIRS], ids, v, fits, v_square))

    def scored(self, row, own, ids, v, fits, v_square) -> tuple[np.ndarray, np.ndarray]:
        a, b = v[row], self.q[own]
        total = np.zeros(len(row))
        for i in range(self.width):  # one term after the other, as an aggregate adds them
            total += a[:, i] * b[:, i] if self.by_cosine else (b[:, i] - a[:, i]) * (b[:, i] - a[:, i])
        fit = fits[row] & self.q_fits[own]
        if self.by_cosine:
            norm = np.sqrt(self.q_square[own]) * np.sqrt(v_square[row])
            total = np.where(fit & (norm != 0), total / np.where(norm == 0, 1.0, norm), 0.0)
        whole = np.floor(total * 1_000_000 + 0.5)
        if not (np.abs(whole[fit]) < 1 << 62).all():
            raise ValueError("a score is no number, or too large")
        e6 = np.where(fit | self.by_cosine, whole, 0).astype(np.int64)
        return np.where(fit | self.by_cosine, e6 if self.by_cosine else -e6, NONE), ids[row]

    def keep(self, own: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Puts pairs among the best of their queries."""
        some = np.unique(own)
        old, place = np.nonzero(self.there[some])
        old = some[old]
        own, score, ids = np.r_[own, old], np.r_[score, self.score[old, place]], np.r_[ids, self.found[old, place]]
        order = np.lexsort((ids, -1 - score, own))  # the complement falls as the score rises, for all whole numbers
        own, score, ids = own[order], score[order], ids[order]
        first = np.r_[True, own[1:] != own[:-1]]
        rank = np.arange(len(own)) - np.maximum.accumulate(np.where(first, np.arange(len(own)), 0))
        best = rank < self.k
        self.score[own[best], rank[best]], self.found[own[best], rank[best]], self.there[own[best], rank[best]] = score[best], ids[best], True


def squares(v: np.ndarray) -> np.ndarray:
    total = np.zeros(len(v))
    for i in range(v.shape[1]):
        total += v[:, i] * v[:, i]
    return total


def fitted(vectors: list, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors as rows, and which of them are whole; the others are rows of 0."""
    fits = np.array([x is not None and len(x) == width and None not in x for x in vectors], bool)
    rows = np.array([x for x, ok in zip(vectors, fits, strict=True) if ok], np.float64).reshape(int(fits.sum()), width)
    out = np.zeros((len(vectors), width))
    out[fits] = rows
    return out, fits


def fitted_column(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    flat = column.flatten()
    if column.null_count or flat.null_count or len(flat) != width * len(column) or any(n != width for n in column.value_lengths().to_pylist()):
        return fitted(column.to_pylist(), width)
    data = np.frombuffer(flat.buffers()[1], np.float64, len(flat), flat.offset * 8) if len(flat) else np.zeros(0)
    return data.reshape(len(column), width), np.ones(len(column), bool)


def distance_to_score(distance: Column) -> Column:
    return 1 / (1 + F.greatest(distance, F.lit(0.0)))


def lexical_tokens(text: Column) -> Column:
    return F.array_distinct(find_all(F.lower(F.coalesce(text, F.lit(""))), K.LEXICAL_TOKEN))


def lexical_overlap(question: Column, text: Column) -> Column:
    q = lexical_tokens(question)
    return F.coalesce(F.size(F.array_intersect(q, lexical_tokens(text))) / F.nullif(F.size(q), F.lit(0)), F.lit(0.0))


def quality_penalty(flags: Column) -> Column:
    one = lambda f: F.when(F.array_contains(flags, f), K.RETRIEVAL_WEIGHTS[2]).otherwise(0.0)
    return one("undersized") + one("oversized")


def hybrid(hits: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """hits (query_id, question, chunk_id, distance, cand_rank) with chunks (chunk_id, text, quality_flags) to the k best.

    0.65 of the distance's score and 0.35 of the lexical overlap less the penalty, in millionths; ties keep the
    candidates' order. Hits without a chunk are dropped.
    """
    a, b, _ = K.RETRIEVAL_WEIGHTS
    score = a * distance_to_score(F.coalesce("distance", F.lit(float("inf")))) + b * lexical_overlap(F.col("question"), F.col("text")) - quality_penalty(F.col("quality_flags"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score_e6"), "cand_rank")
    scored = hits.where(F.col("cand_rank") <= max(K.CANDIDATE_FACTOR * k, K.CANDIDATE_MIN)).join(chunks, "chunk_id").withColumn("score_e6", e6(score))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def query_terms(question: Column) -> Column:
    """Distinct Latin words and Han runs without white space, then known phrases that occur."""
    words = F.filter(F.transform(find_all(F.coalesce(question, F.lit("")), K.QUERY_TERM), compact), lambda t: F.length(t) >= 2)
    phrases = F.array_compact(F.array(*[F.when(F.contains(compact(question), F.lit(p)), F.lit(p)) for p in K.QUERY_PHRASES]))
    return F.array_distinct(F.concat(words, phrases))


def lexical_boost(question: Column, text: Column, chunk_type: Column) -> Column:
    terms = query_terms(question)
    hits = F.size(F.filter(terms, lambda t: F.contains(compact(text), t)))
    metric = F.when(question.rlike(K.METRIC_QUERY) & (chunk_type == "metric"), K.BOOST_METRIC).otherwise(0.0)
    return F.when(F.size(terms) > 0, F.least(F.lit(K.BOOST_CAP), K.BOOST_STEP * hits) + metric).otherwise(0.0)


def char_tfidf(df: DataFrame, low: int = 1, high: int = 4) -> DataFrame:
    """doc_id, gram, w: sublinear tf times smooth idf over character n-grams, each document to length 1."""
    t = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"(?U)\s\s+", " ")

    def grams_of(n: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length(t) - n + 1, F.lit(1)))
        return F.when(F.length(t) >= n, F.transform(places, lambda i: F.substr(t, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    grams = [grams_of(n) for n in range(low, high + 1)]
    counts = df.select("doc_id", F.explode(F.flatten(F.array(*grams))).alias("gram")).groupBy("doc_id", "gram").agg(F.count("*").alias("c"))
    spread = counts.groupBy("gram").agg(F.count("*").alias("df"))
    total = df.agg(F.count("*").alias("docs"))
    x = spread_join(counts, spread, "gram", by="doc_id").join(F.broadcast(total))  # one row is broadcast
    x = x.withColumn("w", (1 + F.log("c")) * (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1))
    return x.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id")))).select("doc_id", "gram", "w")
