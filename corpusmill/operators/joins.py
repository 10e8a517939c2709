"""Joins that stay even when few keys hold many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts that a key's rows are dealt out in.
SALTS = 16


def spread_join(many: DataFrame, one: DataFrame, *keys: str, by: str, salts: int = SALTS) -> DataFrame:
    """Inner join of `many` rows a key with one row a key: each key's rows are dealt out by a hash of the column `by` over
    `salts` tasks, to which the one row goes as copies, so a frequent key is no longer one task's work."""
    left = many.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    right = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"]).drop("_salt")
