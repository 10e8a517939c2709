"""A corpus pipeline of the training-data operators; each stage's result is written and read again as the next one's input.

Language ID drops texts without a language; the n-gram join keeps the first row of each group of near copies; suffix
dedup takes out bytes that an earlier text has too, and drops texts of which nothing but white space is left by that;
decontamination drops texts that hold a benchmark item; the last stage encodes and decodes what remains.

Rows are documents, whether or not their ids are null or repeated: rows stand in order of their ids (null ids last), those
of one id in order of their other columns, and decisions are taken by that place.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import bpe_stream, bwt_merge, decontam, ngram_join, ppm
from corpusmill.llm.lineage import dropped, swept, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts whose language stays undetermined: null texts and texts without a letter."""
    keep = [F.col(c).alias(f"own_{c}") for c in COLUMNS[1:]]
    found = ppm.identify(docs, ppm.train(docs, ~ppm.held_out()), "doc_id", "text", *keep)
    return found.where(F.col("lang_pred") != ppm.UNKNOWN).select("doc_id", *[F.col(f"own_{c}").alias(c) for c in COLUMNS[1:]])


def placed(docs: DataFrame) -> DataFrame:
    """The rows with a `place` of their own, in order of ids (null ids last) and other columns.

    Where every row has an id of its own, that is the place. Else rows are sorted and written out, as places must stand.
    """
    first, *others = COLUMNS
    rows = docs.select(*COLUMNS)
    if rows.groupBy(first).count().where(F.col(first).isNull() | (F.col("count") > 1)).isEmpty():
        return rows.withColumn("place", F.col(first).cast("long"))
    return written(rows.orderBy(F.col(first).asc_nulls_last(), *others).withColumn("place", F.monotonically_increasing_id()))


#: Places that are sent to all tasks, 8 bytes each; more are met by a join that deals out texts.
FEW_PLACES = 500_000


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts with five-word shingle similarity of 0.8 or more: its first (smallest id, null ids last).

    Rows without words are in no group; one of identical ones stays.
    """
    words = F.coalesce(F.col("text"), F.lit("")).rlike(r"\S")
    rows = placed(docs.where(words))
    groups = ngram_join.similar_groups(rows, ngram_join.Join(words=5, num=80, den=100), "place")
    gone = groups.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("place"))
    if gone.count() <= FEW_PLACES:
        gone = F.broadcast(gone)
    return rows.join(gone, "place", "left_anti").select(*COLUMNS).unionByName(docs.where(~words).select(*COLUMNS).distinct())


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 100-byte strings that stand earlier: in a row before (null ids last) or in the same text."""
    own = tuple(F.col(c).alias(f"own_{c}") for c in ("doc_id", "lang", "source"))
    done = bwt_merge.dedup_bytes(placed(docs), "place", keep_text=True, keep=own)
    left = done.where((F.col("n_removed") == 0) | F.col("kept").rlike(r"\S"))
    return left.select(F.col("own_doc_id").alias("doc_id"), F.col("kept").alias("text"), F.col("own_lang").alias("lang"), F.col("own_source").alias("source"), F.length("kept").cast("long").alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in which no benchmark item stands."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.clean(docs, benchmark, "doc_id", "text", *[F.col(c) for c in COLUMNS[2:]]).select(*COLUMNS)


def bpe_roundtrip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_stream.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))


def alone(stage: Stage) -> Stage:
    """The stage without the memory of the one before it: executors live on and would hold both."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        swept(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES: list[tuple[str, Stage]] = [
    ("language_id", alone(language_id)),
    ("ngram_jaccard_join", alone(near_duplicates)),
    ("suffix_array_dedup", alone(suffix_array_dedup)),
    ("benchmark_decontamination", alone(decontamination)),
    ("bpe_roundtrip", alone(bpe_roundtrip)),
]
#: SQL has no byte-context models, merges or windows of hashes; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir))
        dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
