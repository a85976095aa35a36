"""Structured Streaming forms of what has a streaming form.

Each takes and returns a DataFrame; on a batch table they give the same rows as on a stream that has read it
whole. Late rows beyond the watermark are left out, as are their windows' later changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomspan.operators.datasets import frequency_filter, text_hashes
from loomspan.operators.prune import prune
from loomspan.sinks.files import discard, list_folders, settle, store


def windowed(events: DataFrame, time: str = "ts", kind: str = "event_type", value: str = "value", length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """start, end, kind, n, total: counts and sums in tumbling windows, sliding ones with `slide`."""
    w = F.window(time, length, slide) if slide else F.window(time, length)
    out = events.withWatermark(time, late).groupBy(w.alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), kind, "n", "total")


def sessions(events: DataFrame, time: str = "ts", user: str = "user_id", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """start, end, user, n: a user's events that follow one another within the gap."""
    out = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), user).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), user, "n")


def first_copies(rows: DataFrame, text: str = "text", order: str = "seq", limit: int = 0) -> DataFrame:
    """text_hash, order, seen, kept for each row of a stream: how often its text came before, in the order of arrival and of
    `order` within a batch; kept while it came at most `limit` times. The state is one number a distinct text."""
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        own = pd.concat(list(batches)).sort_values(order, kind="stable")
        seen = range(n, n + len(own))
        state.update((n + len(own),))
        yield pd.DataFrame({"text_hash": key[0], order: own[order].to_numpy(), "seen": list(seen), "kept": [k <= limit for k in seen]})

    keyed = rows.select(F.md5(text).alias("text_hash"), F.col(order).cast("long").alias(order))
    return keyed.groupBy("text_hash").applyInPandasWithState(step, f"text_hash string, {order} long, seen long, kept boolean", "n long", "append", GroupStateTimeout.NoTimeout)


def filter_stream(rows: DataFrame, folder: str, limit: int = 0, idx: str = "idx", texts: str = "texts", expire: int | None = None, **how) -> DataStreamWriter:
    """The frequency filter on a stream of rows with several texts each, which arrive in row order: start it, and read the
    decisions with decided(). One batch's rows are decided together, as in a batch table, against the texts of the kept rows of the
    batches before, so the stream decides like one batch over all of its rows.

    Under `folder` lie, for each batch, the decisions (idx, dup_count, kept) and the hashes of its kept rows' texts. A batch that is
    run again after a failure reads only what earlier batches left and replaces its own. expire: texts that no kept row of
    the last `expire` batches has are forgotten, which bounds the state; None keeps all.
    """

    def work(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        settled = settle(batch.select(F.col(idx).cast("long").alias("idx"), F.col(texts).alias("texts")))
        first = 0 if expire is None else max(0, number - expire)
        known = [f for f in list_folders(spark, f"{folder}/seen") if first <= int(f.removeprefix("batch=")) < number]
        seen = spark.read.parquet(*[f"{folder}/seen/{f}" for f in known]) if known else None
        told = frequency_filter(settled, limit, seen=seen, **how)
        told.write.mode("overwrite").parquet(f"{folder}/decided/batch={number}")
        kept = spark.read.parquet(f"{folder}/decided/batch={number}").where("kept").select("idx")
        hashes = settled.join(kept, "idx", "left_semi").select(F.explode(text_hashes("texts")).alias("h")).distinct()
        hashes.write.mode("overwrite").parquet(f"{folder}/seen/batch={number}")
        discard(settled)
        if expire is not None:
            for f in list_folders(spark, f"{folder}/seen"):
                if int(f.removeprefix("batch=")) < first:
                    files, at = store(spark, f"{folder}/seen/{f}")
                    files.delete(at, True)

    return rows.writeStream.foreachBatch(work).option("checkpointLocation", f"{folder}/checkpoint")


def decided(spark: SparkSession, folder: str) -> DataFrame:
    """idx, dup_count, kept and batch of all rows that filter_stream() has decided."""
    return spark.read.parquet(f"{folder}/decided")


def pruned(contexts: DataFrame, **options) -> DataFrame:
    """prune() on a stream: contexts are pruned one by one, without state. Reordering needs a question's contexts together
    and is refused."""
    if options.get("reorder"):
        raise ValueError("a stream can't be reordered")
    return prune(contexts, **options)
