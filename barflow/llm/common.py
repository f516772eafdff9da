"""Shared places, written intermediate tables and Arrow batch helpers of the llm operators."""

from __future__ import annotations

import ctypes
import tempfile
import time
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes that a Parquet writer holds before it writes them.
ROW_GROUP = 32 << 20
#: Bytes of text that one vectorised step handles; a longer document makes a step of its own.
STEP_BYTES = 1 << 20


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder under spark.checkpoint.dir, which driver and executors share.

    Only a session on one machine (local mode, as in tests) may do without that setting.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="barflow-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Cut lineage: write the rows as Parquet into the shared folder and read them back."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.options(**{"parquet.block.size": str(ROW_GROUP)} | options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Spark hand over at most ``rows`` rows to Python at once: long texts then need less memory."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def give_back() -> None:
    """Return freed memory to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def tidy(task, seconds: float = 1.0):
    """A task that gives freed memory back about every second and when it ends; workers live on between tasks."""

    def tidied(batches):
        def fed():
            last = time.monotonic()
            for b in batches:
                if time.monotonic() - last > seconds:
                    give_back()
                    last = time.monotonic()
                yield b

        yield from task(fed())
        give_back()

    return tidied


def local_path(uri: str) -> str:
    """The path of a file: URI; other schemes are left to pyarrow's file systems."""
    return uri[len("file:"):].replace("//", "", 1) if uri.startswith("file://") else uri.removeprefix("file:")


def open_uri(uri: str, mode: str):
    """Open a file of the shared folder, through pyarrow where it is not a local path."""
    import os

    if "://" in uri and not uri.startswith("file:"):
        from pyarrow import fs

        where, path = fs.FileSystem.from_uri(uri)
        return where.open_output_stream(path) if "w" in mode else where.open_input_file(path)
    path = local_path(uri)
    if "w" in mode:
        os.makedirs(os.path.dirname(path), exist_ok=True)
    return open(path, mode)


def utf8_column(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column, and the n+1 offsets of its rows in them; null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32, len(col) + 1 + col.offset)[col.offset:].astype(np.int64) if offs is not None else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0]:offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def cuts(raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.Array:
    """The bytes from ``start`` to ``stop`` of each row, as a binary column.

    They are cut as bytes: an array made of memoryviews holds on to them for good, and so to ``raw``.
    """
    first = int(start.min()) if len(start) else 0
    whole = raw[first:int(stop.max()) if len(stop) else 0].tobytes()
    return pa.array([whole[a:z] for a, z in zip((start - first).tolist(), (stop - first).tolist())], pa.binary())


def steps(offs: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, one row at least."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j
        i = j


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    """The texts of a column; null is empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def runs(batches: Iterable[pa.RecordBatch], key: str, target: int) -> Iterator[pa.Table]:
    """Batches sorted by ``key``, cut anew so that no key spans two of them.

    A cut is made once ``target`` rows are there, so memory holds that or the largest key.
    """
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(b.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        if n >= target:
            new = np.flatnonzero(k != held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py())
            if len(new):
                cut = int(new[0])
                yield pa.Table.from_batches(held + ([b.slice(0, cut)] if cut else []))
                held, n, b = [], 0, b.slice(cut)
        held.append(b)
        n += b.num_rows
    if held:
        yield pa.Table.from_batches(held)
