"""Ranked lexical search: every document's integer score for every item of a query table, the best k kept.

Terms are the maximal stretches of ASCII letters and digits and of all characters beyond ASCII, only A-Z lower-cased.
Postings are rows (bucket, term, document, tf, n); an item's terms meet them by bucket and term, each match has an
integer score, the scores of an item and a document are added, and a window numbers each item's documents.

Where the work lies:

* One pass over the texts writes, for each document, its length and the postings of terms that items hold. Whether items
  hold a term is asked of a bitmap of fixed size (FILTER_BITS, built by Spark): a false positive costs a posting that
  meets no item, nothing else, and a huge query table only fills it.
* Document frequencies are partial counts of that table. A term in every document is one row a task there.
* Documents are dealt by their id, whole, before their postings are laid out, and stay where they are: matches are
  added up inside the document's partition, without a shuffle of matches, and a term that nearly every document holds
  is spread like the documents. The items are taken in blocks of at most about BLOCK_TERMS terms, whose broadcast is
  bounded by that, and each block passes over the postings.
* Before the ranks, the documents of one part in FLOOR_PARTS are scored alone: the k-th best score there is a floor for
  the k-th best of all, so only sums at or above it are sorted and numbered. The floor decides what is sorted, never
  what is returned.

A null or empty text, or one without a term, has no postings and isn't counted. Rows with equal ids are documents of their
own, both ranked (equal scores: by ascending id, null ids last). An item without terms, or whose terms occur nowhere, has no rows;
items with equal ids are one item with the terms of all their rows. Texts are read whole at any length. Empty tables give
no rows, further columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.common import discard, give_back, settle

FILTER_BITS = 23
BUCKETS = 256
BLOCK_TERMS = 100_000
FLOOR_PARTS = 64
#: Scores of this many pairs of item and document, at most, are added up in one task (unless tasks would be too many).
TASK_PAIRS, MOST_TASKS = 4_000_000, 100_000
CHUNK = 256

TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def terms(text: Column) -> Column:
    """The array of a text's terms, in order, with repeats."""
    small = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(small, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))


def term_hash(term: Column) -> Column:
    return F.crc32(term.cast("binary"))


def bucket(term: Column) -> Column:
    return (term_hash(term) % BUCKETS).cast("int")


def term_filter(wanted: DataFrame) -> bytes:
    """A bitmap of 2 ** FILTER_BITS bits: those of the hashes of all wanted terms are set. Its pieces come out of Spark's partial
    aggregates, one row for 4096 bytes."""
    at = (term_hash(F.col("term")) % (1 << FILTER_BITS)).cast("long") + 1
    parts = wanted.select(F.bitmap_bucket_number(at).alias("b"), F.bitmap_bit_position(at).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits")).collect()
    out = bytearray(1 << (FILTER_BITS - 3))
    for r in parts:
        out[(r["b"] - 1) * 4096 : r["b"] * 4096] = r["bits"]
    return bytes(out)


def document_postings(docs: DataFrame, wanted: bytes) -> DataFrame:
    """doc_id, n (terms with repeats) and postings (array of term, tf) of the terms in the filter, for documents with a term."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)
    mask = (1 << FILTER_BITS) - 1
    kind = pa.struct([("term", pa.string()), ("tf", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for b in batches:
            for i in range(0, b.num_rows, CHUNK):
                part = b.slice(i, CHUNK)
                lengths, ends, found, counts = [], [0], [], []
                for t in part.column(1).cast(pa.large_binary()).to_pylist():
                    words = TERM.findall(t.translate(LOWER)) if t else []
                    lengths.append(len(words))
                    for w, tf in Counter(words).items():
                        h = zlib.crc32(w) & mask
                        if bits[h >> 3] >> (h & 7) & 1:
                            found.append(w)
                            counts.append(tf)
                    ends.append(len(found))
                flat = pa.StructArray.from_arrays([pa.array(found, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], fields=list(kind))
                rows = pa.RecordBatch.from_arrays([part.column(0), pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], ["doc_id", "n", "postings"])
                yield rows.filter(pa.compute.greater(rows.column(1), 0))
        give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n long, postings array<struct<term:string,tf:long>>")


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term, k (occurrences in the item)."""
    words = items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(terms(F.col("text"))).alias("term"))
    return words.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("k"))


def postings(by_doc: DataFrame) -> DataFrame:
    """One row for each document and term: bucket, term, doc_id, row (tells rows of one id apart), n, tf. Partitioned like by_doc."""
    rows = by_doc.withColumn("row", F.monotonically_increasing_id()).select("doc_id", "row", "n", F.explode("postings").alias("p"))
    return rows.select(bucket(F.col("p.term")).alias("bucket"), F.col("p.term").alias("term"), "doc_id", "row", "n", F.col("p.tf").alias("tf"))


def scores(by_doc: DataFrame, block: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """item_id, doc_id, row, score of each pair with a term in common; by_doc is dealt by doc_id, the block is small."""
    m = F.expr(f"100 - 75 + ((75L * n * {n_docs}L) div {n_terms}L)")
    rows = postings(by_doc).withColumn("m", m).join(F.broadcast(block), ["bucket", "term"])
    match = rows.select("item_id", "doc_id", "row", F.expr("k * w * ((1000000000L * tf) div (1000L * tf + 8L * m))").alias("s"))
    return match.groupBy("item_id", "doc_id", "row").agg(F.sum("s").alias("score")).where("score > 0")


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_documents(docs: DataFrame, items: DataFrame, k: int = 10, block_terms: int = BLOCK_TERMS, floor_parts: int = FLOOR_PARTS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's k highest-scoring documents with a score above 0."""
    spark = docs.sparkSession
    wanted = settle(item_terms(items))
    by_doc = settle(document_postings(docs, term_filter(wanted)))
    size = by_doc.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    n_docs, n_terms = int(size["docs"]), max(1, int(size["terms"]))
    df = by_doc.select(F.explode("postings.term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log((2.0 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1))).cast("long")
    weighted = settle(wanted.join(df, "term").select("item_id", bucket(F.col("term")).alias("bucket"), "term", "k", weight.alias("w")))
    discard(wanted)
    many = weighted.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("item_id").alias("items")).first()
    blocks = max(1, -(-many["rows"] // block_terms))
    tasks = min(MOST_TASKS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_docs * many["items"] // blocks // TASK_PAIRS + 1))
    dealt = by_doc.repartition(tasks, "doc_id")
    out = None
    for b in range(blocks):
        block = weighted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        part = by_doc.where(F.pmod(F.xxhash64("doc_id"), F.lit(floor_parts)) == 0).repartition(tasks, "doc_id")
        floor = best(scores(part, block, n_docs, n_terms), k).where(F.col("rank") == k).select("item_id", F.col("score").alias("floor"))
        kept = scores(dealt, block, n_docs, n_terms).join(F.broadcast(floor), "item_id", "left").where("floor is null or score >= floor")
        ranked = best(kept, k).select("item_id", "rank", "doc_id", "score")
        out = ranked if out is None else out.unionByName(ranked)
    return out
