"""Keyed tables on plain files: upserts, replacement of a document's chunks, vector records, idempotent ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DOCUMENTS = (
    "doc_id string, file_name string, file_sha256 string, file_size bigint, status string, block_count int, chunk_count int, "
    "strategy map<string,string>, statistics map<string,double>, last_error string"
)
CHUNKS = (
    "chunk_id string, doc_id string, ordinal int, chunk_type string, title_path array<string>, section_titles array<string>, content string, retrieval_text string, "
    "char_count int, source_ids array<string>, quality_flags array<string>, label array<string>, summary string, entity_tags array<string>"
)
STATUSES = ("processing", "ready", "failed")


def upsert(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Rows of `new`, and those of `old` whose keys it has not. Of repeated keys in `new` all rows stay."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def delete(old: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    return old.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def only(rows: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    return rows.join(wanted.select(*keys).distinct(), list(keys), "left_semi")


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children without a parent, which a cascade removes."""
    return children.join(parents.select(key).distinct(), key, "left_anti")


def violations(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """What breaks the tables' rules: rule, key."""
    bad = documents.where(~F.col("status").isin(*STATUSES)).select(F.lit("status").alias("rule"), F.col("doc_id").alias("key"))
    counts = documents.where("chunk_count < 0 OR block_count < 0").select(F.lit("count").alias("rule"), F.col("doc_id").alias("key"))
    twice = chunks.groupBy("chunk_id").count().where("count > 1").select(F.lit("chunk_id").alias("rule"), F.col("chunk_id").alias("key"))
    place = chunks.groupBy("doc_id", "ordinal").count().where("count > 1").select(F.lit("ordinal").alias("rule"), F.concat_ws("#", "doc_id", "ordinal").alias("key"))
    lost = orphans(chunks, documents, "doc_id").select(F.lit("parent").alias("rule"), F.col("chunk_id").alias("key"))
    return bad.unionByName(counts).unionByName(twice).unionByName(place).unionByName(lost)


def changed(documents: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows (doc_id, file_sha256, ...) that are not ready with the same content already; one row an id."""
    ready = documents.where("status = 'ready'").select("doc_id", "file_sha256")
    w = Window.partitionBy("doc_id").orderBy("file_sha256")
    once = incoming.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")
    return once.join(ready, ["doc_id", "file_sha256"], "left_anti")


def ready(documents: DataFrame, outcome: DataFrame) -> DataFrame:
    """Documents with the outcome (doc_id, chunk_count, last_error): ready, or failed where there is an error."""
    x = documents.alias("d").join(outcome.alias("o"), "doc_id", "left")
    touched = F.col("o.chunk_count").isNotNull() | F.col("o.last_error").isNotNull()
    status = F.when(F.col("o.last_error").isNotNull(), "failed").when(touched, "ready").otherwise(F.col("d.status"))
    own = [c for c in documents.columns if c not in ("doc_id", "status", "chunk_count", "last_error")]
    return x.select("doc_id", *[F.col(f"d.{c}").alias(c) for c in own], status.alias("status"), F.coalesce("o.chunk_count", "d.chunk_count").alias("chunk_count"), F.when(touched, F.col("o.last_error")).otherwise(F.col("d.last_error")).alias("last_error")).select(*documents.columns)


def page_bounds(pages: Column) -> tuple[Column, Column]:
    """First and last page, -1 where there is none."""
    return F.coalesce(F.array_min(pages), F.lit(-1)), F.coalesce(F.array_max(pages), F.lit(-1))


def vector_records(chunks: DataFrame) -> DataFrame:
    """Flat records for a vector index; chunks need `pages` and `document` too."""
    first, last = page_bounds(F.col("pages"))
    return chunks.select(
        F.col("chunk_id").alias("id"),
        "document",
        "doc_id",
        "ordinal",
        F.coalesce("chunk_type", F.lit("normal")).alias("chunk_type"),
        "char_count",
        F.size("source_ids").alias("source_ref_count"),
        first.alias("page_start"),
        last.alias("page_end"),
        F.array_join("title_path", " / ").alias("title_path"),
        F.array_join("quality_flags", ",").alias("quality_flags"),
    )


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Whole versions of a table, oldest first: those whose writer left its mark of success."""
    _, fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    names = [(s.getPath().getName(), s.getPath().toString()) for s in fs.listStatus(p)]
    return sorted(int(n[1:]) for n, full in names if n[:1] == "v" and n[1:].isdigit() and _fs(spark, f"{full}/_SUCCESS")[1].exists(_fs(spark, f"{full}/_SUCCESS")[2]))


def write_version(df: DataFrame, path: str, keep: int = 2) -> int:
    """Writes a table's next version into a folder of its own and then removes all but the last `keep` versions.

    A version counts once it is whole (Spark's mark of success is written last), so a reader or a job that dies at any
    place sees the version before it; nothing is renamed, and there is no moment without a table. One writer at a time.
    """
    spark = df.sparkSession
    have = _versions(spark, path)
    new = (have[-1] if have else 0) + 1
    df.write.mode("overwrite").parquet(f"{path}/v{new}")  # what a dead writer left of this version goes
    for old in [*have, new][:-keep]:
        _, fs, p = _fs(spark, f"{path}/v{old}")
        fs.delete(p, True)
    return new


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The newest whole version of a table, no rows if there is none."""
    have = _versions(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/v{have[-1]}") if have else spark.createDataFrame([], schema)


def chunks_of(documents: DataFrame, chunks: DataFrame, doc_id: str) -> DataFrame:
    """A document's chunks by ordinal; an error if there is no such document."""
    if documents.where(F.col("doc_id") == doc_id).isEmpty():
        raise KeyError(f"no document {doc_id}")
    return chunks.where(F.col("doc_id") == doc_id).orderBy("ordinal")


def all_chunks(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """All chunks with their document's name and status, by document and ordinal; chunks without a document are left out."""
    return chunks.join(documents.select("doc_id", "file_name", "status"), "doc_id").orderBy("doc_id", "ordinal")


def with_ordinals(chunks: DataFrame, *order: str) -> DataFrame:
    """Chunks numbered from 1 within their document, as a replacement of all its chunks numbers them."""
    return chunks.withColumn("ordinal", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)))


def json_decoded(df: DataFrame, column: str, schema: str, fallback: Column) -> DataFrame:
    """A column of JSON text as a value of `schema`; the fallback where it is null, broken or of another shape."""
    whole = F.get_json_object(F.col(column), "$").isNotNull()
    return df.withColumn(column, F.coalesce(F.when(whole, F.from_json(F.col(column), schema, {"mode": "PERMISSIVE"})), fallback))


def migrated(df: DataFrame, schema: str) -> DataFrame:
    """The rows with the columns of `schema`: columns that an older table lacks are null, others are cast."""
    want = df.sparkSession.createDataFrame([], schema).schema.fields
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want])
