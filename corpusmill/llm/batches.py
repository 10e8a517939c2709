"""Arrow batches to flat byte slices of bounded size, and back."""

from __future__ import annotations

import ctypes
import gc
import threading
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.shipping import ship

try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:  # another C library has no such call, and needs none
    _libc = None

#: Arrow batches that reach a worker hold at most so many rows and about so many bytes.
BATCH_ROWS, BATCH_BYTES = 4000, 4 << 20
#: Bytes of a batch that a worker gives back at once.
OUTPUT_BYTES = 1 << 20
#: Bytes of text that one numpy slice holds (a longer single text is a slice of its own).
SLICE_BYTES = 1 << 19


def keyed_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """Only the columns that an operator needs, under fixed names, so that extra columns of any name cannot clash."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), *more)


def flat_utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its len + 1 offsets (null: empty)."""
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    valid, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offsets, width)[column.offset : column.offset + n + 1].astype(np.int64)
    if column.null_count:
        there = np.unpackbits(np.frombuffer(valid, np.uint8), bitorder="little")[column.offset : column.offset + n]
        if np.diff(offs)[there == 0].any():  # a null may stand over bytes
            return flat_utf8(column.fill_null(""))
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offs[0] : offs[-1]], offs - offs[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of rows of at most `limit` bytes, one row at least."""
    flat, offs = flat_utf8(column)
    row, n = 0, len(offs) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + limit, side="right")) - 1)
        end = min(end, n)
        yield row, end, flat[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


_held: dict[tuple, object] = {}
_wanted: set[tuple] = set()


def held_in_worker(key: tuple, build: Callable):
    """What `build` gives, kept in this worker for as long as its tasks ask for it: what a task does not ask for goes at
    its end, so that workers that live on do not gather what earlier operators needed."""
    _wanted.add(key)
    if key not in _held:
        _held[key] = build()
    return _held[key]


_last: list[str] = []
_idle: list[threading.Timer] = []
#: Seconds without a task after which a worker gives up what it keeps; executors have more workers than cores in turn.
IDLE_SECONDS = 2.0


def begun(name: str) -> None:
    """Starts a task in this worker: what tasks of another kind left goes at once, and Arrow takes its memory where
    `released` can give it back."""
    for timer in _idle:
        timer.cancel()
    _idle.clear()
    pa.set_memory_pool(pa.system_memory_pool())
    if _last != [name]:
        _cleared()
        _last[:] = [name]
        released()


def released() -> None:
    """Gives memory that a task no longer uses back to the machine: workers live on between tasks."""
    if gone := set(_held) - _wanted:
        for key in gone:
            del _held[key]
        gc.collect()
    _wanted.clear()
    if _held and not _idle:
        _idle.append(threading.Timer(IDLE_SECONDS, _give_up))
        _idle[0].daemon = True
        _idle[0].start()
    _trimmed()


def _give_up() -> None:
    _cleared()
    _trimmed()


def _cleared() -> None:
    """What was kept goes, cycles among it too."""
    _held.clear()
    gc.collect()


def _trimmed() -> None:
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def prepared(df: DataFrame):
    """The session of a map, its workers able to import this package and its batches bounded."""
    spark = ship(df.sparkSession)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(min(BATCH_ROWS, int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")))))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow over single batches; fn yields dicts of columns that become batches of `schema`."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    struct = _parse_datatype_string(schema)
    arrow = to_arrow_schema(struct)
    prepared(df)
    name = f"{getattr(fn, '__module__', '')}.{getattr(fn, '__qualname__', type(fn).__name__)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun(name)
        for batch in batches:
            for columns in fn(batch):
                yield from bounded(record_batch(columns, arrow))
        released()

    return df.mapInArrow(run, struct)


def map_stream(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow over a whole partition's batches."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    struct = _parse_datatype_string(schema)
    arrow = to_arrow_schema(struct)
    prepared(df)
    name = f"{getattr(fn, '__module__', '')}.{getattr(fn, '__qualname__', type(fn).__name__)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun(name)
        for columns in fn(batches):
            yield from bounded(record_batch(columns, arrow))
        released()

    return df.mapInArrow(run, struct)


def bounded(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of about OUTPUT_BYTES at most: what an executor reads at a time is direct memory, which it does not soon give back."""
    step = max(1, int(batch.num_rows * OUTPUT_BYTES / max(batch.nbytes, OUTPUT_BYTES)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def numbers(column: pa.Array) -> np.ndarray:
    """The numbers of a column without nulls. pyarrow's own ways to and from numpy load pandas, 27 MB in each worker."""
    if column.null_count:
        raise ValueError("a column with nulls has no plain numbers")
    _, data = column.buffers()
    width = np.dtype(str(column.type))
    if data is None:
        return np.zeros(0, width)
    return np.frombuffer(data, width, count=len(column), offset=column.offset * width.itemsize)


def array_of(values, kind: pa.DataType) -> pa.Array:
    """What `pa.array(values, kind)` gives, without pandas for numbers, truth values, strings and bytes."""
    if isinstance(values, list) and (pa.types.is_string(kind) or pa.types.is_binary(kind)):
        return _of_strings(values, kind)
    if isinstance(values, list) and pa.types.is_integer(kind) and all(type(x) is int for x in values):
        values = np.array(values, str(kind))
    if not isinstance(values, np.ndarray) or values.ndim != 1 or values.dtype.kind not in "biuf":
        return pa.array(values, kind)
    if pa.types.is_boolean(kind) and values.dtype.kind == "b":
        return pa.Array.from_buffers(kind, len(values), [None, pa.py_buffer(np.packbits(values, bitorder="little"))])
    if not pa.types.is_integer(kind) and not pa.types.is_float64(kind) or values.dtype.kind == "b":
        return pa.array(values, kind)
    own = np.ascontiguousarray(values, np.dtype(str(kind)))
    if own.dtype != values.dtype and pa.types.is_integer(kind) and not np.array_equal(own, values):
        raise ValueError(f"numbers that {kind} does not hold")
    return pa.Array.from_buffers(kind, len(own), [None, pa.py_buffer(own)])


def _of_strings(values: list, kind: pa.DataType) -> pa.Array:
    there = np.array([x is not None for x in values], bool)
    text = pa.types.is_string(kind)
    body = [b"" if x is None else x.encode() if text else x for x in values]
    ends = np.cumsum([0, *map(len, body)])
    if ends[-1] >= 1 << 31:
        return pa.array(values, kind)
    valid = None if there.all() else pa.py_buffer(np.packbits(there, bitorder="little"))
    return pa.Array.from_buffers(kind, len(values), [valid, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(b"".join(body))])


def record_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    arrays = []
    for field in schema:
        values = columns[field.name]
        if isinstance(values, pa.ChunkedArray):
            values = values.combine_chunks()
        arrays.append(values.cast(field.type) if isinstance(values, pa.Array) else array_of(values, field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)
