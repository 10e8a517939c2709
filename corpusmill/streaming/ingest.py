"""Incremental ingest: new or changed documents of a stream go through chunking and replace what was stored for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusmill.operators import segment, store
from corpusmill.operators.parse import blocks

DOCS = "doc_id string, file_sha256 string, status string, chunk_count int, last_error string"
CHUNKS = "doc_id string, ordinal int, chunk_id string, chunk_type string, content string"
Chunker = Callable[[DataFrame], DataFrame]


def default_chunks(docs: DataFrame) -> DataFrame:
    return segment.segmented(blocks(docs)).select("doc_id", "ordinal", "chunk_id", "chunk_type", "content")


def ingest_batch(spark: SparkSession, batch: DataFrame, docs_path: str, chunks_path: str, chunker: Chunker = default_chunks) -> None:
    """One batch of (doc_id, text, error if there is one): what is ready with the same content is left alone.

    New and changed documents are marked `processing`, chunked, and marked `ready`, or `failed` with the reason where they
    came with an error; the chunks of failed ones stay as they were. Where chunking itself fails, all of the batch are
    marked failed and the error goes on. Each step writes a whole new version of a table, so a batch that is repeated after
    a loss finds its documents unready and does the same again. One writer at a time.
    """
    error = F.col("error") if "error" in batch.columns else F.lit(None).cast("string")
    incoming = batch.select("doc_id", "text", error.alias("error"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("file_sha256"))
    docs, chunks = store.read_table(spark, docs_path, DOCS), store.read_table(spark, chunks_path, CHUNKS)
    todo = store.changed(docs, incoming).persist()
    try:
        if todo.isEmpty():
            return
        started = todo.select("doc_id", "file_sha256", F.lit("processing").alias("status"), F.lit(0).alias("chunk_count"), F.lit(None).cast("string").alias("last_error"))
        store.write_version(store.upsert(docs, started, "doc_id"), docs_path)
        try:
            fresh = chunker(todo.where("error IS NULL"))
            store.write_version(store.delete(chunks, todo.where("error IS NULL"), "doc_id").unionByName(fresh), chunks_path)
        except Exception as e:
            _finish(spark, docs, todo.withColumn("error", F.lit(str(e)[:500])), docs_path, chunks_path)
            raise
        _finish(spark, docs, todo, docs_path, chunks_path)
    finally:
        todo.unpersist()


def _finish(spark: SparkSession, docs: DataFrame, todo: DataFrame, docs_path: str, chunks_path: str) -> None:
    counts = store.read_table(spark, chunks_path, CHUNKS).groupBy("doc_id").agg(F.count("*").cast("int").alias("chunk_count"))
    done = todo.join(counts, "doc_id", "left").select("doc_id", "file_sha256", F.when(F.col("error").isNull(), "ready").otherwise("failed").alias("status"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.col("error").alias("last_error"))
    store.write_version(store.upsert(docs, done, "doc_id"), docs_path, keep=3)  # `docs` is read from the version before last


def ingest_stream(stream: DataFrame, docs_path: str, chunks_path: str, checkpoint: str, chunker: Chunker = default_chunks) -> StreamingQuery:
    spark = stream.sparkSession
    return stream.writeStream.foreachBatch(lambda batch, _: ingest_batch(spark, batch, docs_path, chunks_path, chunker)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
