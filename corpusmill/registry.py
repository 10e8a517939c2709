"""All queries outside `llm` and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.segment import fixed_chunks
from corpusmill.plans.oracles import ORACLE_SQL
from corpusmill.plans.queries import QUERIES

Query = Callable[[SparkSession, str], DataFrame]
__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-length chunks of all documents, counted by language."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = fixed_chunks(docs).join(docs.select("doc_id", "lang"), "doc_id")
    return found.groupBy("lang").agg(F.count("*").alias("chunks"), F.round(F.avg(F.length("content")), 2).alias("avg_chars"))
