"""Cutting lineage with tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only where that is unset on one machine, as in tests.

    On a cluster without it this is an error: a folder of one machine would lose what other executors write.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="corpusmill-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """The same rows from a Parquet table in the shared folder; a lost executor loses nothing of it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/corpusmill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._corpusmill_path = path
    return out


def dropped(df: DataFrame | None) -> None:
    """Deletes the table of a frame that `written` returned, once nothing will read it again; other frames are left alone."""
    path = getattr(df, "_corpusmill_path", None)
    if path and (spark := _written.pop(path, None)):
        _delete(spark, path)


def swept(spark: SparkSession) -> None:
    """Lets the driver find the shuffles of frames that are gone, whose files executors keep until it does; executors then
    collect what they no longer use and give it back to the machine, which else they keep beside what comes next."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    others = max(1, spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1)
    spark.range(0, others, 1, others).select(F.expr("java_method('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _remove() -> None:
    for path, spark in _written.items():
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session is already gone; the folder's owner cleans up
            return
