"""The registered queries of this subpackage, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import bpe_count, bpe_stream, bwt_merge, decontam, licenses, media, ngram_join, oracles, packing, ppm, suffix_tree

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(documents(spark, sf_dir))


def op2_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_stream.encode_decode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(documents(spark, sf_dir), ngram_join.Join(words=3, num=90, den=100))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.train_and_identify(documents(spark, sf_dir)).select("doc_id", "held_out", "lang_pred", "score", "bits_per_byte")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.dedup_words(documents(spark, sf_dir))


def op6_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_rows(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, end_id=50256)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_count.token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt_merge.dedup_bytes(documents(spark, sf_dir))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


QUERIES: dict[str, Query] = {name: f for name, f in sorted(globals().items()) if name.startswith("op") and callable(f)}
ORACLE_SQL: dict[str, str] = oracles.ORACLE_SQL
