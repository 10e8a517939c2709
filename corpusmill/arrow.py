"""Arrow-batched maps over bounded batches, for what column expressions cannot say in linear time."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from corpusmill.shipping import ship

#: Rows of a batch that goes on.
ROWS = 2000
#: Rows and about how many bytes a batch that reaches a worker holds at most.
BATCH_ROWS, BATCH_BYTES = 4000, 4 << 20


def bounded(df: DataFrame) -> None:
    """The session's workers can import this package, and its batches are bounded, in rows and in bytes."""
    conf = ship(df.sparkSession).conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(min(BATCH_ROWS, int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")))))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_rows(df: DataFrame, fn: Callable[[dict], Iterator[tuple]], schema: StructType) -> DataFrame:
    """fn takes a row as a dict and yields rows of `schema`; ROWS of them at most are held."""
    return map_values(df, lambda *row, names=tuple(df.columns): fn(dict(zip(names, row, strict=True))), schema)


def map_values(df: DataFrame, fn: Callable[..., Iterable[tuple]], schema: StructType) -> DataFrame:
    """As `map_rows`; fn takes a row's values, which spares a dict for each."""
    from pyspark.sql.pandas.types import to_arrow_schema

    bounded(df)
    arrow = to_arrow_schema(schema)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rest = iter(fn(*row))
                while True:
                    held.extend(islice(rest, ROWS - len(held)))
                    if len(held) < ROWS:
                        break
                    yield batch_of(held)
                    held = []
            if held:
                yield batch_of(held)

    return df.mapInArrow(run, schema)
