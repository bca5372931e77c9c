"""Arrow plumbing shared by the text operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Text handed to one vectorised step. Whole rows only: a single longer text forms a slice of its own.
SLICE_BYTES = 1 << 20
#: What Spark hands to a Python worker at once, and buffers on the way; a single longer row goes alone.
BATCH_BYTES = 4 << 20
try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim
except (OSError, AttributeError):  # another C library
    _libc = None


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by their bytes, as ten thousand rows may hold long texts; a caller's bound stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":  # what Spark has if nobody set it
        spark.conf.set(name, str(BATCH_BYTES))


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts hold at most ``limit`` bytes together."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    first = 0
    while first < batch.num_rows:
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(first, last - first)
        first = last
    release()


def release() -> None:
    """Give unused memory back: Python workers live on between tasks and stages; what they hold counts."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Texts as Python strings; null becomes the empty string."""
    return [x if x is not None else "" for x in batch.column(column).to_pylist()]


def code_points(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The texts joined, their code points as uint32, and len(texts) + 1 offsets into them."""
    joined = "".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(x) for x in texts], out=offsets[1:])
    return joined, points, offsets


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads 64-bit integers (splitmix64's, public domain)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
