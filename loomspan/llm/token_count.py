"""Token counts with the `tokenizers` library, lengths only.

Texts are cut at boundaries which the byte-level pre-tokenizer always cuts at itself: in front of a run of
blanks, tabs and line ends that follows any other character. A piece's count is then independent of its
neighbours, so each worker keeps the counts of short pieces it has met (a cache bounded in entries and bytes)
and the library is called on batches of unmet pieces, balanced by their UTF-8 bytes. Other Unicode white
space joins the blanks beside it to one run, in front of which no cut is made: a piece then begins at the run.

Null and empty texts have no tokens; repeated rows are counted row by row; very long texts are cut like any
other, and a single piece of any length (no blank in it) goes to the library alone. Empty tables stay empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import give_back, single_thread

# Unicode's white space.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECE = re.compile(rf"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
BATCH_BYTES = 256 * 1024
CACHE_ENTRIES, CACHE_BYTES = 400_000, 24 << 20
#: Longer pieces are not kept.
LONG = 64


class Counter:
    """Counts tokens of texts; exact for any text, the cache only saves calls."""

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES, batch_bytes: int = BATCH_BYTES):
        single_thread()
        from tokenizers import Tokenizer

        self.encode = Tokenizer.from_file(path).encode_batch_fast
        self.cache: dict[str, int] = {}
        self.kept = 0
        self.cache_entries, self.batch_bytes = cache_entries, batch_bytes

    def lengths(self, pieces: list[str]) -> list[int]:
        """Library counts, in batches of about batch_bytes UTF-8 bytes, short pieces with short ones."""
        bytes_ = [len(p) if p.isascii() else len(p.encode()) for p in pieces]
        order = sorted(range(len(pieces)), key=bytes_.__getitem__)
        out, batch, size = [0] * len(pieces), [], 0
        for n, i in enumerate(order):
            batch.append(i)
            size += bytes_[i]
            if size >= self.batch_bytes or n + 1 == len(order):
                for j, e in zip(batch, self.encode([pieces[j] for j in batch], add_special_tokens=False)):
                    out[j] = len(e)
                batch, size = [], 0
        return out

    def count(self, texts: list[str | None]) -> list[int]:
        cut = [PIECE.findall(t) if t else [] for t in texts]
        if len(self.cache) > self.cache_entries or self.kept > CACHE_BYTES:
            self.cache, self.kept = {}, 0
        new = [c for c in set().union(*cut) if c not in self.cache]
        told = dict(zip(new, self.lengths(new)))
        short = {c: n for c, n in told.items() if len(c) <= LONG}
        self.cache.update(short)
        self.kept += sum(map(len, short))
        if len(short) == len(told):
            get = self.cache.__getitem__
            return [sum(map(get, c)) for c in cut]
        return [sum(self.cache[p] if p in self.cache else told[p] for p in c) for c in cut]


@lru_cache(maxsize=1)
def counter_of(path: str) -> Counter:
    """One counter a Python worker, whose cache the worker's later tasks find filled."""
    return Counter(path)


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row; null text counts as empty. No shuffle.

    tokenizer_path: a .json file of `tokenizers`; special strings inside texts are handled as by default.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(tokenizer_path)
        for b in batches:
            texts = b.column(1).to_pylist()
            for i in range(0, len(texts), 256):
                part = counter.count(texts[i : i + 256])
                yield pa.RecordBatch.from_arrays([b.column(0)[i : i + 256], b.column(2)[i : i + 256], pa.array(part, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])
        give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
