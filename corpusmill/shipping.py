"""Makes this package importable in Python workers wherever the driver imported it from."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package's sources to the executors through Spark's own file server, once for each application."""
    sc = spark.sparkContext
    if getattr(sc, "_corpusmill_shipped", None) != sc.applicationId:
        target = Path(tempfile.mkdtemp(prefix="corpusmill")) / "corpusmill_src.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(PACKAGE.rglob("*.py")):
                z.write(f, f"{PACKAGE.name}/{f.relative_to(PACKAGE)}")
        sc.addPyFile(str(target))
        sc._corpusmill_shipped = sc.applicationId
    return spark
