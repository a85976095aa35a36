"""Cleaning a corpus in five stages: each takes the documents its predecessor kept and writes its own.

Each function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
`documents`, further ones of any name too: rows travel as one struct, so no column can clash with those that
stages use inside. Null and empty texts pass every filter that finds nothing in them; repeated rows and rows
without an id are rows like any other; empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from loomspan.llm.common import settle, table


def packed(docs: DataFrame, *out: Column) -> DataFrame:
    """The rows as one struct `row`, their text, and further columns."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"), *out)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores under 0.7. The model learns from labelled rows of `docs` itself, on ids whose crc32
    modulo 3 is not 1."""
    from loomspan.llm import toxicity
    from loomspan.llm.common import fold

    labels = table(spark, sf_dir, "labels").selectExpr("cast(doc_id as bigint) doc_id", "toxic as label").where(fold("doc_id", 3) != 1)
    model = toxicity.fit(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), labels)
    return toxicity.score(packed(docs), model, threshold=0.7, carry=("row",)).where("predicted = 0").select("row.*")


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: five-word shingles, similarity about 0.8 or more. It has the group's smallest
    doc_id; repeated ids go by the text's hash, then by place, and rows without an id stay only in groups without ids."""
    from loomspan.llm.simhash import near_duplicates

    rows = settle(packed(docs, F.monotonically_increasing_id().alias("place")))
    groups = near_duplicates(rows.select(F.col("place").alias("doc_id"), "text"), words=5, radius=26, bits=128)
    # a group's first place reaches its rows by itself, so only places meet, not texts
    order = F.struct(F.isnull("row.doc_id").alias("none"), F.col("row.doc_id").alias("doc_id"), F.xxhash64("text").alias("hash"), F.col("place"))
    kin = rows.select("place", order.alias("order")).join(groups.select(F.col("doc_id").alias("place"), "component_id"), "place")
    first = kin.groupBy("component_id").agg(F.min("order").alias("first")).select(F.col("first.place").alias("place"))
    return rows.join(first, "place", "left_semi").select("row.*")


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that a string of 200 bytes found elsewhere covers; every row stays, n_chars follows the text."""
    from loomspan.llm.suffix_dedup import remove_repeats, texts_left

    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    keyed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"))
    schema = StructType([StructField("doc_id", LongType()), keyed.schema["row"], StructField("text", StringType())])
    left = remove_repeats(keyed, texts_left, schema, carry="row")
    new = {"text": F.col("text"), "n_chars": F.length("text")}
    return left.select(*[(new[c] if c in new else F.col("row").getField(c)).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no benchmark item occurs within its edit budget."""
    from loomspan.llm.decontam import mark

    return mark(packed(docs), table(spark, sf_dir, "benchmark"), into="matches").where(F.size("matches") == 0).select("row.*")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row that is left."""
    import public_tokenizers

    from loomspan.llm.piece_codec import encode_digest

    return encode_digest(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", one_of_near_copies),
    ("suffix_array", drop_repeated_passages),
    ("decontamination", drop_contaminated),
    ("pieces", encode_pieces),
]

#: SQL expresses neither the trained model nor the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = settle(docs)
    return docs
