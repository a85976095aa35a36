"""WARC archives compressed record by record with a Zstandard dictionary.

Each archive is a .warc.zst file: a leading skippable frame (magic 0x184D2A5D) holds the dictionary, and each record is a
Zstandard frame of its own, compressed with it, so that any record can be read from its offset alone. The dictionary is
trained on records of at most SAMPLE_ROWS pages, those with the smallest digest, of each the first SAMPLE_CHARS
characters; only the dictionary is bounded so, every record is written whole.

Records with equal payloads of at least `least_bytes` bytes: the one with the smallest page id is the response, the
others are revisits that refer to it and carry no payload. Smaller payloads are all responses. A group of
copies is told by a partial minimum over digests; only groups of two and more are joined back, under SALTS salts,
so that a page with very many copies meets its id in several tasks.

Writers are tasks: each writes archives of about `archive_bytes` under names of their own to the shared folder, and
the manifest, a settled table, lists the archives of the tasks that ended well. What a lost task leaves behind is in no
manifest and isn't read. Readers stream one archive at a time, record by record.

A null html is an empty payload. A null page id is written as "null" and refers to the smallest id of its group, if there is
one; rows that tie for the smallest id are all responses, with one record id. A null url has no target header; characters
of a url that would break a header are percent-encoded. Pages of any size are written whole; empty tables give no
archive and no rows; further columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import give_back, scratch, settle
from loomspan.sinks.files import store

# Fixed values of the formats: WARC 1.1, its Zstandard form, and the revisit profile for equal payloads.
MAGIC = 0x184D2A5D
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:page:"

SAMPLE_ROWS, SAMPLE_CHARS, DICTIONARY_BYTES = 1000, 8192, 64 << 10
ARCHIVE_BYTES = 64 << 20
SALTS = 16
LEVEL = 6
READ_ROWS = 64
FIELDS = "page_id long, url string, html string, first long, first_url string"
READ = "page_id long, record_type string, url string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def clean(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", url)


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None = None, first_url: str | None = None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One record: a response, or a revisit of page `first`. The HTTP header of both names the full payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    name = lambda i: f"<{ID}{'null' if i is None else i}>"
    head = [VERSION, f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {clean(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if first is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(first)}"]
        if first_url is not None:
            head.append(f"WARC-Refers-To-Target-URI: {clean(first_url)}")
    block = http if first is not None else http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(source: io.BufferedReader) -> dict[str, str] | None:
    """A header block up to its empty line, names in lower case; "" holds the first line. None at the end."""
    line = source.readline()
    if not line:
        return None
    out = {"": line.decode().strip()}
    while (line := source.readline()) not in (b"\r\n", b""):
        name, _, value = line.decode().partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def parse(source: io.BufferedReader) -> Iterator[dict]:
    """The records of an uncompressed archive, one after another; a payload that differs from its digest is an error."""

    def page(name: str | None) -> int | None:
        name = (name or "").strip("<>").removeprefix(ID)
        return int(name) if name and name != "null" else None

    while (head := headers(source)) is not None:
        block = source.read(int(head["content-length"]))
        source.read(4)
        inside = io.BufferedReader(io.BytesIO(block))
        http = headers(inside)
        told, size = head["warc-payload-digest"].removeprefix("sha1:"), int(http["content-length"])
        out = {"page_id": page(head["warc-record-id"]), "record_type": head["warc-type"], "url": head.get("warc-target-uri"), "payload_bytes": size, "payload_digest": told, "refers_to": None, "payload": None}
        if head["warc-type"] == "response":
            out["payload"] = inside.read()
            if digest(out["payload"]) != told or len(out["payload"]) != size:
                raise ValueError(f"payload of {head['warc-record-id']} differs from its digest")
        else:
            out["refers_to"] = page(head["warc-refers-to"])
        yield out


def train(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from records; where they are too few or too much alike to train one, their own last bytes serve as it."""
    import zstandard

    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def leading_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", MAGIC, len(dictionary)) + dictionary


def read_archive(source) -> Iterator[dict]:
    """The records of one archive from an open binary file."""
    import zstandard

    magic, size = struct.unpack("<II", source.read(8))
    if magic != MAGIC:
        raise ValueError("no dictionary frame in front")
    words = zstandard.ZstdCompressionDict(source.read(size))
    with zstandard.ZstdDecompressor(dict_data=words).stream_reader(source, read_across_frames=True) as plain:
        yield from parse(io.BufferedReader(plain, 1 << 20))


def file_system(path: str):
    """(the file system of a path, the path in it), in a task: any store that pyarrow reaches."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))


def with_first(pages: DataFrame, least_bytes: int) -> DataFrame:
    """page_id, url, html, and for revisits first and first_url, the page that they repeat."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("key", F.unhex(F.sha2("html", 256)))
    large = rows if least_bytes <= 0 else rows.where(F.octet_length("html") >= least_bytes)
    copies = large.groupBy("key").agg(F.min("page_id").alias("first"), F.min_by("url", "page_id").alias("first_url"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    copies = copies.select("key", "first", "first_url", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    again = ~F.col("page_id").eqNullSafe(F.col("first"))
    met = salted.join(copies, ["key", "salt"], "left")
    return met.select("page_id", "url", "html", F.when(again, F.col("first")).alias("first"), F.when(again, F.col("first_url")).alias("first_url"))


def dictionary_of(pages: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> bytes:
    """Trained on a bounded sample: the `rows` pages with the smallest digests, `chars` characters of each."""
    part = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.substring(F.coalesce("html", F.lit("")), 1, chars).alias("html"))
    # the last digest of the sample first: tasks send numbers, not pages, for the driver to choose from
    part = part.withColumn("order", F.xxhash64("page_id", "url", "html"))
    last = part.select("order").orderBy("order").limit(rows).agg(F.max("order").alias("last")).first()["last"]
    drawn = part.where(F.col("order") <= F.lit(last)).limit(rows).collect() if last is not None else []
    return train([record(r["page_id"], r["url"], r["html"].encode()) for r in drawn]) if drawn else b""


def write_archives(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, level: int = LEVEL) -> DataFrame:
    """Archives of all pages (page_id, url, html) in `folder`, by default a scratch folder that goes with the application.
    Returns the manifest: path, n_records, n_bytes."""
    spark = pages.sparkSession
    if folder is None:
        folder = scratch(spark)
        files, at = store(spark, folder)
        files.mkdirs(at)
        files.deleteOnExit(at)
    words = dictionary_of(pages)
    shared = spark.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(shared.value), write_content_size=True)
        store_, base = file_system(folder)
        store_.create_dir(base, recursive=True)
        out, path, records, size, done = None, "", 0, 0, []
        for b in batches:
            for page_id, url, html, first, first_url in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    path, records = f"{uuid.uuid4().hex}.warc.zst", 0
                    out = store_.open_output_stream(f"{base}/{path}", compression=None)
                    out.write(leading_frame(shared.value))
                    size = 8 + len(shared.value)
                frame = press.compress(record(page_id, url, html.encode(), first, first_url))
                out.write(frame)
                records, size = records + 1, size + len(frame)
                if size >= archive_bytes:
                    out.close()
                    done.append((f"{folder}/{path}", records, size))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{path}", records, size))
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], ["path", "n_records", "n_bytes"])

    return settle(with_first(pages, least_bytes).mapInArrow(run, "path string, n_records long, n_bytes long"))


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """One row for each record of the archives that the manifest lists: page_id, record_type, url, refers_to (the page that a
    revisit repeats), payload_bytes and payload_digest (of the full payload), and, if wanted, the payload of responses."""
    schema = READ if payloads else READ.rsplit(",", 1)[0]
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    arrow = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                store_, at = file_system(path)
                rows: list[dict] = []
                with store_.open_input_stream(at, compression=None) as source:
                    for r in read_archive(source):
                        rows.append({n: r[n] for n in names})
                        if len(rows) >= (READ_ROWS if payloads else 4096):
                            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)
        give_back()

    n = max(1, min(manifest.count(), 10_000))
    return manifest.select("path").repartition(n).mapInArrow(run, schema)
