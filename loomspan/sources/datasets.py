"""Datasets on disk: one table with a split column, or a folder of splits in parquet or in Arrow shards."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.sinks.files import exists, list_files, list_folders
from loomspan.sources.arrow import read_shards


def load_split(df: DataFrame, split: str, column: str = "split") -> DataFrame:
    """The rows of one split of a table that has a split column; an unknown one is a KeyError that lists the known ones."""
    if not df.where(F.col(column) == split).limit(1).count():
        known = sorted(str(r[0]) for r in df.select(column).distinct().limit(1000).collect())
        raise KeyError(f"no split {split!r}; there are {', '.join(known)}")
    return df.where(F.col(column) == split)


def head(df: DataFrame, n: int | None, order: str) -> DataFrame:
    """The first n rows by a stable order, all of them without n."""
    return df if n is None else df.orderBy(order).limit(max(0, n))


def slice_of(df: DataFrame, expression: str, order: str, limit: int | None = None) -> tuple[str, DataFrame]:
    """(split, rows) of an expression such as test or test[:100]; a limit holds only where the expression has none."""
    name, _, rest = expression.partition("[")
    if rest:
        text = rest.rstrip("]").removeprefix(":")
        if not text.isdigit():
            raise ValueError(f"{expression!r} is neither a split nor split[:n]")
        limit = int(text)
    return name, head(load_split(df, name), limit, order)


def load_dataset(spark: SparkSession, path: str, subset: str | None = None) -> DataFrame:
    """All splits of a dataset folder as one table with a `split` column.

    It may be parquet, partitioned by split or with a folder for each, or, where that can't be read, Arrow shards: a
    folder of *.arrow files for each split, or one folder without splits (split "train").
    """
    at = f"{path.rstrip('/')}/{subset}" if subset else path.rstrip("/")
    if not exists(spark, at):
        raise FileNotFoundError(at)
    folders = list_folders(spark, at)
    if any(f.startswith("split=") for f in folders) or list_files(spark, at, ".parquet"):
        df = spark.read.parquet(at)
        return df if "split" in df.columns else df.withColumn("split", F.lit("train"))
    parts = []
    for name in folders:
        if list_files(spark, f"{at}/{name}", ".parquet"):
            parts.append(spark.read.parquet(f"{at}/{name}").withColumn("split", F.lit(name)))
        elif list_files(spark, f"{at}/{name}", ".arrow"):
            parts.append(read_arrow(spark, f"{at}/{name}").withColumn("split", F.lit(name)))
        else:
            warnings.warn(f"{at}/{name} holds neither parquet nor Arrow files: skipped", stacklevel=2)
    if not parts and list_files(spark, at, ".arrow"):
        return read_arrow(spark, at).withColumn("split", F.lit("train"))
    if not parts:
        raise FileNotFoundError(f"no splits in {at}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def read_arrow(spark: SparkSession, folder: str, columns: list[str] | None = None) -> DataFrame:
    """The rows of a folder's *.arrow shards (IPC streams or files), a shard's record batches in several tasks."""
    return read_shards(spark, folder, columns)
