"""What the corpus operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eigenframe.plans.durable import scratch_path

try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # not glibc
    _libc = None

#: A word: a run of anything but the ASCII white space 09-0D and 20.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_uri(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one, as a URI that names its store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, name))
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return f"file://{uri.removeprefix('file:')}" if uri.startswith("file:/") and not uri.startswith("file://") else uri


def remainder(col: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; NULL for a NULL id."""
    return F.crc32(F.col(col).cast("string") if isinstance(col, str) else col.cast("string")) % modulus


def slices(batches: Iterator[pa.RecordBatch], text: int, limit: int = 4 << 20, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that a slice holds about ``limit`` bytes of column ``text`` at most, or one row."""
    for batch in batches:
        for at, n in cuts(batch.column(text), limit, rows):
            yield batch.slice(at, n)
    release()


def cuts(texts: pa.Array, limit: int = 4 << 20, rows: int = 4096) -> Iterator[tuple[int, int]]:
    """(start, rows) of slices of about ``limit`` bytes at most, or one row."""
    ends = np.cumsum(np.nan_to_num(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False).astype(float)))
    at = 0
    while at < len(texts):
        base = ends[at - 1] if at else 0.0
        upto = int(np.searchsorted(ends, base + limit, side="right"))
        upto = min(max(upto, at + 1), at + rows, len(texts))
        yield at, upto - at
        at = upto


def release() -> None:
    """Give memory back at the end of a task: workers live on, and the next task may need it in the JVM."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def text_bytes(column: pa.Array) -> list[bytes]:
    """The texts of a column in UTF-8; a NULL is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def row_hash(*cols: str) -> Column:
    """A hash of whole rows that repeats in every run; NULLs count."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00null")) for c in cols])
