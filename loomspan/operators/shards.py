"""Long work in stored shards: a run that is killed goes on where it stopped, with no row lost and none done twice.

The rows are dealt once into shards, ranges of their key's hash, and written to `input`, one folder a shard. Shards are
worked on `at_once` in a job; a job's results go to a folder of their own under `data`, and only then does each of
its shards get an entry in `done`, one small file that names where its rows lie. Readers go by the entries alone: what
a killed job left behind has no entry, isn't read, and its shards are worked on again.

`plan.json` holds the number of shards, the key, and the rows' count and sum of hashes; another input for the same folder is
an error. Rows with a null key belong to one shard; repeated keys are fine.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.sinks.files import exists, list_files, read_bytes, store, write_text

SHARD = "shard_"


def shard_of(key: Column, shards: int) -> Column:
    """Which of equal ranges of 64-bit hashes a key's hash lies in: 0 .. shards - 1."""
    high = F.shiftrightunsigned(F.xxhash64(key), 32)
    return F.floor(high * shards / F.lit(1 << 32)).cast("int")


def write_entry(spark: SparkSession, path: str, value: dict) -> None:
    """A small file that is there whole or not at all: written aside, then renamed."""
    aside = f"{path}.{uuid.uuid4().hex}.tmp"
    write_text(spark, aside, json.dumps(value))
    files, at = store(spark, path)
    if files.exists(at):
        files.delete(at, False)
    if not files.rename(store(spark, aside)[1], at):
        raise OSError(f"cannot rename {aside} to {path}")


def entries(spark: SparkSession, folder: str) -> dict[int, dict]:
    """shard -> what is stored of it: path (null if it has no rows), low, high (the range of shards' hashes), rows."""
    got = [json.loads(read_bytes(spark, p)) for p in list_files(spark, f"{folder}/done", ".json")]
    return {int(e["shard"]): e for e in got}


def _plan(rows: DataFrame, key: str, folder: str, shards: int) -> dict:
    told = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64(key).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("s")).first()
    return {"shards": shards, "key": key, "rows": int(told["n"]), "hashes": told["s"]}


def stored(spark: SparkSession, folder: str) -> DataFrame | None:
    """The results of all shards that are done; None while there is none with rows."""
    paths = [e["path"] for _, e in sorted(entries(spark, folder).items()) if e["path"]]
    return spark.read.parquet(*paths) if paths else None


def in_shards(rows: DataFrame, key: str, folder: str, work: Callable[[DataFrame], DataFrame], shards: int = 64, at_once: int = 8, force: bool = False, after_job: Callable[[list[int]], None] | None = None) -> DataFrame:
    """work(rows), done shard by shard and kept in `folder`; shards that are done already are read. work keeps the key of its
    rows. force: everything anew. after_job is called with the shards of each job."""
    spark = rows.sparkSession
    if SHARD in rows.columns:
        raise ValueError(f"rows have a column {SHARD}")
    files, root = store(spark, folder)
    if force and files.exists(root):
        files.delete(root, True)
    plan, at = _plan(rows, key, folder, shards), f"{folder}/plan.json"
    if exists(spark, at):
        if json.loads(read_bytes(spark, at)) != plan:
            raise ValueError(f"{folder} holds shards of another input; force=True begins anew")
    else:
        rows.withColumn(SHARD, shard_of(F.col(key), shards)).repartition(SHARD).write.mode("overwrite").partitionBy(SHARD).parquet(f"{folder}/input")
        write_entry(spark, at, plan)
    source = spark.read.schema(rows.withColumn(SHARD, F.lit(0)).schema).parquet(f"{folder}/input")
    left = [k for k in range(shards) if k not in entries(spark, folder)]
    for i in range(0, len(left), at_once):
        some = left[i : i + at_once]
        path = f"{folder}/data/{uuid.uuid4().hex}"
        done = work(source.where(F.col(SHARD).isin(some)).drop(SHARD))
        done.withColumn(SHARD, shard_of(F.col(key), shards)).write.partitionBy(SHARD).parquet(path)
        counts = {r[SHARD]: r["n"] for r in spark.read.schema(f"{SHARD} int").parquet(path).groupBy(SHARD).agg(F.count(F.lit(1)).alias("n")).collect()}
        for k in some:
            low, high = ((k << 32) + shards - 1) // shards, ((k + 1 << 32) + shards - 1) // shards
            write_entry(spark, f"{folder}/done/{k:06d}.json", {"shard": k, "low": low, "high": high, "rows": counts.get(k, 0), "path": f"{path}/{SHARD}={k}" if counts.get(k) else None})
        if after_job:
            after_job(some)
    out = stored(spark, folder)
    return out if out is not None else work(source.where("false").drop(SHARD))
