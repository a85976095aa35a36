"""What the operators share: table reading, the shared scratch folder, Arrow text buffers."""

from __future__ import annotations

import contextlib
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.sinks.files import discard, scratch, settle

__all__ = ["byte_buckets", "discard", "fold", "give_back", "scratch", "settle", "single_thread", "table", "text_bytes"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the named tables, by Spark's reader alone (any store that Spark reads)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Freed memory of this Python worker goes back to the machine: idle workers keep none from an earlier stage."""
    import ctypes

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library has no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def fold(doc_id: str, n: int):
    """crc32 of the id as text, modulo n; null ids have a null fold."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def byte_buckets(docs: DataFrame, column: str, target: int) -> int:
    """How many buckets of about `target` text bytes the table needs, measured over all rows."""
    total = docs.agg(F.sum(F.octet_length(F.coalesce(F.col(column), F.lit("")))).alias("b")).first()["b"] or 0
    return max(1, -(-int(total) // target))


def text_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All texts of an Arrow string column as one uint8 array, and the n + 1 offsets; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    if col.null_count:
        col = col.fill_null("")
    large = pa.types.is_large_string(col.type)
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bufs = col.buffers()
    off = np.frombuffer(bufs[1], np.int64 if large else np.int32, count=n + 1 + col.offset)[col.offset :].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8)[off[0] : off[-1]] if bufs[2] is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def single_thread() -> None:
    """Tokenizer libraries stay on one thread in each task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
