"""Files in any store that Spark reaches, and the shared scratch folder for intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_SCRATCH = "/tmp/loomspan-scratch"


def store(spark: SparkSession, path: str):
    """(the path's file system, the path), by Hadoop's classes."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    files, at = store(spark, path)
    return files.exists(at)


def write_text(spark: SparkSession, path: str, content: str) -> None:
    """A small text file, its folders made, an older one replaced."""
    files, at = store(spark, path)
    out = files.create(at, True)
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()


def read_bytes(spark: SparkSession, path: str, most: int | None = None) -> bytes:
    """A small file's bytes, the first `most` of them."""
    files, at = store(spark, path)
    size = files.getFileStatus(at).getLen()
    src = files.open(at)
    try:
        return bytes(src.readNBytes(int(size if most is None else min(size, most))))
    finally:
        src.close()


def list_files(spark: SparkSession, path: str, suffix: str) -> list[str]:
    """Paths of the files in a folder whose names end in `suffix`, sorted."""
    files, at = store(spark, path)
    if not files.exists(at):
        return []
    return sorted(s.getPath().toString() for s in files.listStatus(at) if s.isFile() and s.getPath().getName().endswith(suffix))


def list_folders(spark: SparkSession, path: str) -> list[str]:
    files, at = store(spark, path)
    if not files.exists(at):
        return []
    return sorted(s.getPath().getName() for s in files.listStatus(at) if s.isDirectory())


def scratch(spark: SparkSession) -> str:
    """A new folder under the shared spark.checkpoint.dir. Where that is unset, a local folder serves a local master (tests);
    on a cluster, whose machines don't share local folders, it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master.split("[")[0] != "local":
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all machines share (master {master})")
        base = f"file://{LOCAL_SCRATCH}"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read again: the lineage is cut and any executor may go. The folder is
    deleted when the application ends, or by discard()."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.parquet(path)
    files, at = store(spark, path)
    files.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete settled tables that nothing reads any more."""
    for t in tables:
        files, at = store(t.sparkSession, t.__dict__["settled_at"])
        files.delete(at, True)
        files.cancelDeleteOnExit(at)
