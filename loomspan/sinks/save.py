"""Saving datasets: whole or not at all, by split, filtered with their records, and in shards of a given size."""

from __future__ import annotations

import json
import time
import uuid
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators import datasets as D
from loomspan.sinks.files import exists, list_folders, read_bytes, settle, store, write_text


def save(df: DataFrame, path: str, overwrite: bool = False, by: str | None = None) -> None:
    """A dataset folder that is there as a whole or not at all: written beside its place, then renamed. An older one stays
    until then, and is an error unless overwrite; reading from it while it is replaced is allowed. by: a column whose values
    get a folder each, such as the split."""
    spark = df.sparkSession
    files, at = store(spark, path.rstrip("/"))
    if files.exists(at) and not overwrite:
        raise FileExistsError(path)
    beside = at.suffix(".tmpwrite") if at.getParent() is None else store(spark, f"{at.getParent()}/.{at.getName()}.tmpwrite")[1]
    files.delete(beside, True)
    writer = df.write.partitionBy(by) if by else df.write
    try:
        writer.parquet(beside.toString())
        files.delete(at, True)
        if not files.rename(beside, at):
            raise OSError(f"{beside} could not become {path}")
    finally:
        files.delete(beside, True)


def save_splits(splits: dict[str, DataFrame], path: str, overwrite: bool = False) -> None:
    """One folder a split under a dataset's folder."""
    parts = [df.withColumn("split", F.lit(name)) for name, df in splits.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    save(out, path, overwrite, by="split")


def save_shards(df: DataFrame, path: str, shards: int | None = None, rows_each: int | None = None, overwrite: bool = False) -> None:
    """For handing a dataset on: so many files, or files of so many rows."""
    spark = df.sparkSession
    if exists(spark, path) and not overwrite:
        raise FileExistsError(path)
    writer = (df.repartition(shards) if shards else df).write.mode("overwrite")
    (writer.option("maxRecordsPerFile", rows_each) if rows_each else writer).parquet(path)


def save_filtered(train: DataFrame, others: dict[str, DataFrame], path: str, thresholds: list[int], idx: str = "idx", texts: str = "texts", ident: str = "id", name: str = "") -> dict[int, dict[str, Any]]:
    """The frequency filter's results: for each threshold a dataset whose train split is filtered, frequency_filter_ds_summary.md,
    and drop_ids.txt, the sorted ids of dropped rows, if there are any; in a folder freq{N} each if there are several
    thresholds. frequency_filter_metadata.json tells of the whole run. All rows of a dropped id go. Returns the numbers."""
    spark, told = train.sparkSession, {}
    for n in thresholds:
        folder = f"{path.rstrip('/')}/freq{n}" if len(thresholds) > 1 else path.rstrip("/")
        decided = settle(D.frequency_filter(train, n, idx, texts))
        dropped = train.join(decided.where("not kept").withColumnRenamed("idx", idx).select(idx), idx, "left_semi").select(F.col(ident).cast("string").alias(ident)).distinct()
        kept = train.join(dropped.withColumnRenamed(ident, "gone_"), F.col(ident).cast("string") == F.col("gone_"), "left_anti")
        before, after = (D.duplicate_stats(df.select(F.explode(texts).alias("text"))).first() for df in (train, kept))
        rows, stays = train.count(), kept.count()
        histogram = [r.asDict() for r in D.dup_histogram(decided).orderBy("dup_count").collect()]
        save_splits({"train": kept, **others}, f"{folder}/data", overwrite=True)
        count = dropped.count()
        if count:
            # as many ids as there are dropped rows: written by the executors, in order, as one file
            dropped.orderBy(ident).coalesce(1).write.mode("overwrite").text(f"{folder}/drop_ids")
            _single_file(spark, f"{folder}/drop_ids", f"{folder}/drop_ids.txt")
        numbers = {"rows": rows, "kept": stays, "removed": rows - stays, "drop_ids": count, "before": before.asDict(), "after": after.asDict(), "histogram": histogram}
        write_text(spark, f"{folder}/frequency_filter_ds_summary.md", summary(name, n, numbers))
        told[n] = numbers
    write_text(spark, f"{path.rstrip('/')}/frequency_filter_metadata.json", json.dumps({"dataset": name, "thresholds": thresholds, "output_root": path, "generated_at": _now()}, indent=2))
    return told


def _single_file(spark: SparkSession, folder: str, path: str) -> None:
    files, at = store(spark, folder)
    part = next(s.getPath() for s in files.listStatus(at) if s.getPath().getName().startswith("part-"))
    target = store(spark, path)[1]
    files.delete(target, False)
    files.rename(part, target)
    files.delete(at, True)


def summary(name: str, threshold: int, numbers: dict[str, Any]) -> str:
    """The frequency filter's numbers in Markdown."""
    lines = ["# Frequency filter", "", f"- Dataset: `{name}`", f"- Threshold: {threshold}", f"- Written (UTC): {_now()}", ""]
    lines += [f"- Rows: {numbers['rows']:,}, kept {numbers['kept']:,}, removed {numbers['removed']:,}, ids dropped {numbers['drop_ids']:,}"]
    for label, key in (("before", "before"), ("after", "after")):
        s = numbers[key]
        lines.append(f"- Texts {label}: {s['total']:,}, unique {s['n_unique']:,}, duplicates {s['duplicates']:,}, ratio {s['ratio']:.4%}")
    lines += ["", "| Duplicate texts | Rows | Kept | Removed |", "| --- | ---: | ---: | ---: |"]
    lines += [f"| {h['dup_count']} | {h['total']:,} | {h['kept']:,} | {h['removed']:,} |" for h in numbers["histogram"]]
    return "\n".join(lines) + "\n"


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()


CURRENT = "CURRENT"


def publish(df: DataFrame, folder: str, keep: int = 2, partition_by: list[str] | None = None) -> str:
    """A new version of a table in a folder, for stores without a rename of folders: the rows go to a subfolder of their own, then
    the file CURRENT, which names the version to read, is replaced by one write. A reader sees the old version or the new one;
    after a crash the old one stays. The `keep` latest versions stay, for readers that are still at one. Returns the version."""
    spark = df.sparkSession
    version = f"v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(f"{folder}/{version}")
    write_text(spark, f"{folder}/{CURRENT}", version)
    # versions behind the current one that no crash left newer than it
    old = [v for v in list_folders(spark, folder) if v < version]
    for v in old[: max(0, len(old) - (keep - 1))]:
        files, at = store(spark, f"{folder}/{v}")
        files.delete(at, True)
    return version


def read_published(spark: SparkSession, folder: str) -> DataFrame:
    """The current version of a published table."""
    if not exists(spark, f"{folder}/{CURRENT}"):
        raise FileNotFoundError(f"nothing is published in {folder}")
    return spark.read.parquet(f"{folder}/{read_bytes(spark, f'{folder}/{CURRENT}').decode()}")
