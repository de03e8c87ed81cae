"""Shared helpers: tables, Arrow maps, objects that workers keep; scratch storage is the library's."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from docweave.storage import BROADCAST_ROWS, scratch_path, scratch_root, small, stored  # noqa: F401

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders that were made by scratch_path()."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_held: dict = {}
_wanted: set = set()


def held(key: tuple, make: Callable):
    """An object that a worker process keeps between tasks (a tokeniser with its tables). It goes as soon as
    the worker has a task that does not ask for it, so operators do not pile up in a worker's memory."""
    _wanted.add(key)
    if key not in _held:
        _held[key] = make()
    return _held[key]


def trim() -> None:
    """Give memory that is free but held by the allocators back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy() -> None:
    """Let go what earlier tasks of this worker have left."""
    dropped = [k for k in _held if k not in _wanted]
    for k in dropped:
        del _held[k]
    if dropped:
        gc.collect()
    trim()


def begin() -> None:
    """The beginning of a task that asks for nothing yet."""
    _wanted.clear()


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]], schema: str | StructType) -> DataFrame:
    """mapInArrow with one set-up call in each task, which takes what it uses of held(). Free memory goes back
    after each batch, so that a worker that waits for its next task holds little."""

    def run(batches):
        begin()
        f = make()
        tidy()
        for b in batches:
            if b.num_rows:
                yield from f(b)
                trim()

    return df.mapInArrow(run, schema)


def one_array(col) -> pa.Array:
    return col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col


def filled_text(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The text column as large strings, null as empty."""
    import pyarrow.compute as pc

    return pc.fill_null(batch.column(name).cast(pa.large_string()), "")


def slices(batch: pa.RecordBatch, max_bytes: int = 8 << 20, name: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds about max_bytes of text (one row at least)."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    parts = np.cumsum(sizes) // max_bytes
    cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)
