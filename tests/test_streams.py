"""Streams against the same rows as a batch."""

import datetime
import random
import time

import pytest
from pyspark.sql import functions as F

from loomspan.operators.prune import prune
from loomspan.streaming import streams as S


def run(df, tmp_path, spark, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return sorted(tuple(r) for r in spark.table(name).collect())


@pytest.fixture
def events(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    rows = [(i, t + datetime.timedelta(minutes=7 * i), i % 3, "ab"[i % 2], float(i)) for i in range(200)]
    kind = "event_id long, ts timestamp, user_id int, event_type string, value double"
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/e")
    return spark.read.parquet(f"{tmp_path}/e"), spark.readStream.schema(kind).parquet(f"{tmp_path}/e")


def test_windows(spark, tmp_path, events):
    batch, stream = events
    want = sorted(tuple(r) for r in S.windowed(batch).collect())
    assert run(S.windowed(stream), tmp_path, spark, "w", "complete") == want and sum(r[3] for r in want) == 200
    twice = sorted(tuple(r) for r in S.windowed(batch, slide="30 minutes").collect())
    assert sum(r[3] for r in twice) == 400
    closed = run(S.windowed(stream), tmp_path, spark, "closed")
    assert set(closed) < set(want) and len(closed) >= len(want) - 4


def test_sessions(spark, tmp_path, events):
    batch, stream = events
    want = sorted(tuple(r) for r in S.sessions(batch, gap="20 minutes").collect())
    assert len(want) == 200 and len(S.sessions(batch, gap="30 minutes").collect()) == 3
    got = run(S.sessions(stream, gap="20 minutes"), tmp_path, spark, "s")
    assert set(got) <= set(want) and len(got) >= 190


def test_first_copies(spark, tmp_path):
    rows = [(i, "xyz"[i * i % 3]) for i in range(20)]
    spark.createDataFrame(rows, "seq long, text string").coalesce(1).write.parquet(f"{tmp_path}/t")
    stream = spark.readStream.schema("seq long, text string").parquet(f"{tmp_path}/t")
    got = {r[1]: (r[2], r[3]) for r in run(S.first_copies(stream, limit=1), tmp_path, spark, "f")}
    seen, want = {}, {}
    for i, t in rows:
        want[i] = (seen.get(t, 0), seen.get(t, 0) <= 1)
        seen[t] = seen.get(t, 0) + 1
    assert got == want


def several_texts(n=90):
    rng = random.Random(8)
    return [(i, [rng.choice("abcdefghijklmnopqrstuv") for _ in range(rng.randint(0, 4))]) for i in range(n)]


def one_after_another(rows, limit):
    seen, want = set(), []
    for i, texts in rows:
        n = sum(t in seen for t in texts)
        want.append((i, n, n <= limit))
        if n <= limit:
            seen |= set(texts)
    return want


def batches_of(spark, rows, path, size):
    for k in range(0, len(rows), size):
        spark.createDataFrame(rows[k : k + size], "idx long, texts array<string>").coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.02)  # files are read in the order of their times
    return spark.readStream.schema("idx long, texts array<string>").option("maxFilesPerTrigger", 1).parquet(path)


@pytest.mark.parametrize("limit", [0, 1])
def test_a_filtered_stream_equals_the_batch(spark, tmp_path, limit):
    rows = several_texts()
    stream = batches_of(spark, rows, f"{tmp_path}/in", 30)
    S.filter_stream(stream, f"file://{tmp_path}/f", limit).trigger(availableNow=True).start().awaitTermination(120)
    got = S.decided(spark, f"file://{tmp_path}/f")
    assert got.select("batch").distinct().count() == 3
    assert sorted(tuple(r) for r in got.select("idx", "dup_count", "kept").collect()) == one_after_another(rows, limit)


def test_a_failed_batch_is_done_again(spark, tmp_path):
    """What a failed batch left behind counts for nothing, and a restarted stream goes on from its checkpoint."""
    rows, folder = several_texts(60), f"file://{tmp_path}/f"
    first = batches_of(spark, rows[:30], f"{tmp_path}/in", 30)
    S.filter_stream(first, folder).trigger(availableNow=True).start().awaitTermination(120)
    # a batch 1 that wrote the texts of rows it then failed on
    spark.createDataFrame([(chr(c),) for c in range(97, 119)], "t string").select(F.unhex(F.md5("t")).alias("h")).write.parquet(f"{tmp_path}/f/seen/batch=1")
    second = batches_of(spark, rows[30:], f"{tmp_path}/in", 30)
    S.filter_stream(second, folder).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(tuple(r) for r in S.decided(spark, folder).select("idx", "dup_count", "kept").collect()) == one_after_another(rows, 0)


def test_texts_expire(spark, tmp_path):
    rows = [(0, ["a"]), (1, ["b"]), (2, ["a"]), (3, ["b"])]
    stream = batches_of(spark, rows, f"{tmp_path}/in", 1)
    S.filter_stream(stream, f"file://{tmp_path}/f", expire=1).trigger(availableNow=True).start().awaitTermination(120)
    assert {r["idx"]: r["kept"] for r in S.decided(spark, f"file://{tmp_path}/f").collect()} == dict.fromkeys(range(4), True)
    assert len(list((tmp_path / "f/seen").iterdir())) <= 2


def test_pruning_a_stream(spark, tmp_path):
    rows = [(0, k, "red fox", t) for k, t in enumerate(["A red fox ran. The sky is blue.", "", "Nothing."])]
    kind = "query_idx int, context_idx int, query string, context_text string"
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/c")
    want = sorted(tuple(r) for r in prune(spark.read.parquet(f"{tmp_path}/c")).select("context_idx", "pruned_context", "reranking_score").collect())
    got = run(S.pruned(spark.readStream.schema(kind).parquet(f"{tmp_path}/c")).select("context_idx", "pruned_context", "reranking_score"), tmp_path, spark, "p")
    assert got == want and got[0][1].startswith("A red fox ran.")
    with pytest.raises(ValueError):
        S.pruned(spark.read.parquet(f"{tmp_path}/c"), reorder=True)
