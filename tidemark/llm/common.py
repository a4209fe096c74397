"""What the operators of this package share: row keys, text access in tasks, per-process state, written tables."""

from __future__ import annotations

import gc
import sys
import time
import types as pytypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.session import scratch_path

#: Bytes of text that a task works on at once; temporary arrays are a small multiple of it.
CHUNK_BYTES = 1 << 20
#: Seconds that Spark's cleaner gets after each collection.
CLEANER_S = 0.5


def per_process(name: str, build):
    """State kept for the life of a worker process (functions are unpickled anew for each task)."""
    home = sys.modules.setdefault("_tidemark_worker_state", pytypes.ModuleType("_tidemark_worker_state"))
    if not hasattr(home, name):
        setattr(home, name, build())
    return getattr(home, name)


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def written(df: DataFrame, label: str) -> DataFrame:
    """Written to the shared folder and read back: cuts the lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame | None) -> None:
    """Deletes the files of a table of ``written`` that nothing reads any more."""
    if df is None:
        return
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir")
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        assert root.removeprefix("file://").rstrip("/") in name
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles() -> None:
    """Lets Spark's cleaner remove the shuffle files of finished jobs: it acts when the driver collects garbage.

    What a first collection lets go of holds more; the cleaner works in a thread of its own, so it gets a moment.
    """
    spark = SparkSession.getActiveSession()
    for _ in range(2):
        gc.collect()
        if spark is not None:
            spark._jvm.System.gc()
        time.sleep(CLEANER_S)


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column end to end, and the n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def pieces(batch: pa.RecordBatch, text: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text; a row is never cut."""
    if not batch.num_rows:
        return
    column = batch.column(batch.schema.get_field_index(text))
    _, at = raw_bytes(column)
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(at, at[start] + most, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end
