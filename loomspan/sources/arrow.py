"""Arrow shards as tables, several tasks a file.

A shard is a sequence of messages, each with its sizes in front: a schema, dictionaries, record batches, as a stream (.arrow
files of dataset libraries) or between the marks of a file. A first job reads no more than the messages' heads and tells
where each record batch lies; a second one reads the batches in ranges of about `range_bytes`, each task with the
schema and the dictionaries in front of its range. So no task holds a whole shard, however long it is, and only the wanted
columns leave a task. Files are read by pyarrow's file systems, in the tasks.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from loomspan.sinks.files import list_files

RANGE_BYTES = 32 << 20
# Fixed values of the format: what a file begins with, what stands in front of a message, kinds of messages.
MAGIC = b"ARROW1\0\0"
CONTINUED = 0xFFFFFFFF
SCHEMA, DICTIONARY, BATCH = 1, 2, 3
#: Places of a message's kind and of its body's length among its fields.
KIND_FIELD, BODY_FIELD = 1, 3


def field_at(head: bytes, field: int) -> int:
    """Where a field of a message's root table lies; 0 if it has its default."""
    table = struct.unpack_from("<I", head, 0)[0]
    fields = table - struct.unpack_from("<i", head, table)[0]
    at = 4 + 2 * field
    if at >= struct.unpack_from("<H", head, fields)[0]:
        return 0
    offset = struct.unpack_from("<H", head, fields + at)[0]
    return table + offset if offset else 0


def messages(source: BinaryIO) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end) of each message, by their heads alone."""
    at = len(MAGIC) if source.read(len(MAGIC)) == MAGIC else 0
    while True:
        source.seek(at)
        front = source.read(8)
        if len(front) < 8:
            return
        mark, size = struct.unpack("<II", front)
        if mark != CONTINUED:  # the older form has no mark
            mark, size, skip = CONTINUED, mark, 4
        else:
            skip = 8
        if size == 0:
            return
        source.seek(at + skip)
        head = source.read(size)
        kind, body = field_at(head, KIND_FIELD), field_at(head, BODY_FIELD)
        end = at + skip + size + (struct.unpack_from("<q", head, body)[0] if body else 0)
        yield head[kind] if kind else 0, at, end
        at = end


def open_file(path: str):
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
    return store.open_input_file(at)


def schema_of(path: str) -> pa.Schema:
    """The schema of a shard, by its first message."""
    with open_file(path) as f:
        kind, start, end = next(messages(f))
        if kind != SCHEMA:
            raise ValueError(f"{path} doesn't begin with a schema")
        f.seek(start)
        return pa.ipc.read_schema(pa.BufferReader(f.read(end - start)))


def ranges(path: str, range_bytes: int) -> Iterator[tuple[str, int, int, int, list[int]]]:
    """(path, number of the range, start, end, bounds of the messages that it needs from in front): a shard's record batches in
    ranges of about range_bytes, a larger batch by itself."""
    with open_file(path) as f:
        needed: list[int] = []
        number, first, last = 0, None, 0
        for kind, start, end in messages(f):
            if kind == BATCH:
                if first is not None and end - first > range_bytes:
                    yield path, number, first, last, list(needed)
                    number, first = number + 1, None
                first, last = start if first is None else first, end
            else:
                if first is not None:  # later batches may need what comes now
                    yield path, number, first, last, list(needed)
                    number, first = number + 1, None
                needed += [start, end]
        if first is not None:
            yield path, number, first, last, list(needed)


def read_shards(spark: SparkSession, folder: str, columns: list[str] | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The rows of a folder's *.arrow files, which share the schema of the first one; with `columns` those alone."""
    paths = list_files(spark, folder, ".arrow")
    if not paths:
        raise FileNotFoundError(f"no .arrow files in {folder}")
    schema = schema_of(paths[0])
    if columns is not None:
        schema = pa.schema([schema.field(c) for c in columns])
    plain = pa.schema([pa.field(f.name, f.type.value_type if pa.types.is_dictionary(f.type) else f.type, f.nullable) for f in schema])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                got = list(ranges(path, range_bytes))
                yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())))], ["path", "number", "start", "end", "needed"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, _, start, end, needed in zip(*(c.to_pylist() for c in b.columns)):
                with open_file(path) as f:
                    parts = []
                    for lo, hi in [*zip(needed[::2], needed[1::2]), (start, end)]:
                        f.seek(lo)
                        parts.append(f.read(hi - lo))
                with pa.ipc.open_stream(pa.BufferReader(b"".join(parts))) as stream:
                    for batch in stream:
                        # a shard that lacks a column has nulls there
                        have = [batch.column(batch.schema.names.index(x.name)).cast(x.type) if x.name in batch.schema.names else pa.nulls(batch.num_rows, x.type) for x in plain]
                        yield pa.RecordBatch.from_arrays(have, schema=plain)

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(min(len(paths), 10_000))
    found = files.mapInArrow(places, "path string, number long, start long, end long, needed array<long>")
    # dealt by place: ranges of one shard go to several tasks
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(paths))
    return found.repartition(tasks, F.col("path"), F.col("number")).mapInArrow(read, from_arrow_schema(plain))
