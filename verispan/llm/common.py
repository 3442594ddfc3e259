"""What the operators share: shared-folder tables, Arrow text buffers, hashing."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python kernel holds at once, but for a single longer text.
BLOCK_BYTES = 1 << 20
#: Spark's setting that has an execution's shuffle files deleted once it ends.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables in the shared folder, in the order in which this driver wrote them.
WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where that is unset, a temporary one in local mode only."""
    held = spark.conf.get("spark.checkpoint.dir", None)
    if not held:
        context = spark.sparkContext
        held = context.getCheckpointDir()
        if not held:
            if not re.match(r"local(\[[^-]*\])?$", context.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="verispan-"))
            held = context.getCheckpointDir()
    return held.rstrip("/")


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table written by ``materialize`` that no later plan reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and survives lost executors.

    The table is deleted when the driver's Python ends (best effort).
    """
    return stored(df, name)[0]


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As ``materialize``, with the table's path, so that the caller can drop it early."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _shuffles_freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    WRITTEN.append(path)

    def tidy() -> None:
        with contextlib.suppress(Exception):
            drop_path(spark, path)

    atexit.register(tidy)
    return spark.read.schema(df.schema).parquet(path), path


@contextlib.contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is executed inside has its shuffle files deleted at its end; the written table replaces them."""
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREED) if before is None else spark.conf.set(FREED, before)


def release(spark: SparkSession, first: int) -> None:
    """Delete the tables that ``stored`` wrote from number ``first`` on, but the last: nothing may read them any more."""
    for path in WRITTEN[first:-1]:
        drop_path(spark, path)
    del WRITTEN[first:-1]


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame, by: int = 1) -> int:
    """A partition count for shuffles of df's session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) * by


def kernel(run: Callable) -> Callable:
    """A mapInArrow function that gives its memory back to the system when its task ends.

    Python workers live on between tasks; what they keep would add up beside the executor's heap.
    """

    @functools.wraps(run)
    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return inner


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty. Offsets start at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[at[0] : at[-1]], at - at[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``size`` bytes of text each, at least one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = text_buffers(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(at, at[start] + size, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A copy of data with A-Z in lower case."""
    return LOWER[data]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def binary_column(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def signed(values: np.ndarray) -> pa.Array:
    """uint64 bits as a Spark long column."""
    return pa.array(np.ascontiguousarray(values, np.uint64).view(np.int64), pa.int64())


def hex16(column):
    """A long's 64 bits as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def pack(*parts: np.ndarray | bytes) -> bytes:
    """Parts of bytes or numbers as one compressed blob."""
    held = [p if isinstance(p, bytes) else np.ascontiguousarray(p).tobytes() for p in parts]
    return zstandard.ZstdCompressor(3).compress(b"".join([np.array([len(held), *map(len, held)], "<u4").tobytes(), *held]))


def unpack(blob: bytes) -> list[bytes]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(data, "<u4", 1)[0])
    at = np.cumsum([4 + 4 * n, *np.frombuffer(data, "<u4", n, 4)])
    return [data[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
