"""What query modules share: registration, tables, digests that both engines compute alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query of (spark, sf_dir) under `name`, with its DuckDB twin where SQL can say it."""

    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Text work is dealt out in parts of about this size, so that tasks, and the batches that Python gets, stay as small as they
#: are however large a table is and however few files it lies in.
PART_BYTES = 4 << 20


def spread(df: DataFrame, source: DataFrame | None = None, part: int | None = None) -> DataFrame:
    """For text work: parts of PART_BYTES or `part`, one a core at least. The size is the planner's estimate of df, or of the table that it
    comes from, where joins make an estimate useless; nothing is read for it. Rows go by their hash, which needs no sort."""
    size = int(str((df if source is None else source)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-size // (part or PART_BYTES)))
    return df.repartition(parts, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))


def digest(parts: Column) -> Column:
    """One md5 of an array of strings."""
    return F.md5(F.array_join(F.transform(parts, lambda x: x.cast("string")), "\x1f", "\x00"))


# The same in DuckDB.
def q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def d_digest(parts: str) -> str:
    return f"md5(coalesce(array_to_string(list_transform({parts}, lambda x: coalesce(CAST(x AS VARCHAR), chr(0))), chr(31)), ''))"


# Written by hand, apart from the library's own pattern.
STRIP_D = r"\A[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+|[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+\z"


def d_strip(x: str) -> str:
    return f"regexp_replace({x}, {q(STRIP_D)}, '', 'g')"


def d_all(x: str, pattern: str) -> str:
    return f"regexp_extract_all({x}, {q(pattern)})"


def d_stripped(parts: str, whole: str) -> str:
    kept = f"list_filter(list_transform({parts}, lambda s: {d_strip('s')}), lambda s: s <> '')"
    return f"CASE WHEN len({kept}) > 0 THEN {kept} ELSE list_filter([{d_strip(whole)}], lambda s: s <> '') END"
