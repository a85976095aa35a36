"""Concurrent calls with deadlines, work in stored shards that survives kills, versions behind a pointer."""

import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from loomspan.operators import labeling as L
from loomspan.operators.calls import NOT_ASKED, call_all, concurrent_calls, concurrent_replies
from loomspan.operators.shards import entries, in_shards, shard_of, stored
from loomspan.sinks.save import publish, read_published


def test_replies_come_in_order_and_at_once():
    most, now, lock = 0, 0, threading.Lock()

    def slow(p):
        nonlocal most, now
        with lock:
            now += 1
            most = max(most, now)
        time.sleep(0.05)
        with lock:
            now -= 1
        return p.upper()

    began = time.monotonic()
    got = call_all(slow, [*"abcdefgh", None] * 4, workers=8)
    assert [o.reply for o in got] == [*"ABCDEFGH", None] * 4 and most == 8
    assert time.monotonic() - began < 0.05 * 32 / 2  # one after another they take 1.6 s
    assert got[8].attempts == 0 and got[8].error is None and got[0].attempts == 1


def test_failing_and_hanging_functions():
    tried = {}

    def fn(p):
        tried[p] = tried.get(p, 0) + 1
        if p == "hang":
            time.sleep(60)
        if p == "bad" or (p == "once" and tried[p] == 1):
            raise RuntimeError("no " + p)
        return p

    began = time.monotonic()
    got = {p: o for p, o in zip(["hang", "bad", "once", "good"], call_all(fn, ["hang", "bad", "once", "good"], workers=2, timeout=0.3, tries=2, pause=0.05))}
    assert time.monotonic() - began < 5
    assert got["hang"].reply is None and "0.3 s" in got["hang"].error and got["hang"].attempts == 2
    assert got["bad"].error == "RuntimeError: no bad" and got["bad"].attempts == 2 == tried["bad"]
    assert got["once"].reply == "once" and got["once"].attempts == 2 and got["once"].error is None
    assert got["good"].attempts == 1


def test_pauses_double():
    at = []

    def fn(p):
        at.append(time.monotonic())
        raise ValueError

    call_all(fn, ["x"], tries=4, pause=0.05)
    gaps = [b - a for a, b in zip(at, at[1:])]
    assert len(at) == 4 and gaps[0] >= 0.05 and gaps[1] >= 0.1 and gaps[2] >= 0.2


def test_a_dead_model_is_left_alone():
    asked = []

    def fn(p):
        asked.append(p)
        raise OSError("gone")

    got = call_all(fn, [str(i) for i in range(1000)], workers=4, tries=1, most_failures=10)
    assert len(asked) < 20 and sum(o.error == NOT_ASKED for o in got) > 980
    assert sum(o.error == "OSError: gone" for o in got) >= 10


def test_calls_in_tasks(spark):
    def fn(p):
        if p.startswith("x"):
            raise RuntimeError("x")
        return p + "!"

    df = spark.createDataFrame([("a",), ("xb",), (None,)], "p string").repartition(2)
    got = {r["p"]: r["c"] for r in df.select("p", concurrent_calls(fn, tries=2, pause=0.01)(F.col("p")).alias("c")).collect()}
    assert got["a"]["reply"] == "a!" and got["a"]["attempts"] == 1 and got["a"]["error"] is None
    assert got["xb"]["reply"] is None and got["xb"]["attempts"] == 2 and got["xb"]["error"] == "RuntimeError: x"
    assert got[None]["reply"] is None and got[None]["attempts"] == 0


def test_judging_with_concurrent_replies(spark):
    def fn(prompt):
        if "boom" in prompt:
            raise RuntimeError
        return '{"has_answer": 1, "answer_score": 0.5, "reasoning": "r"}'

    rows = spark.createDataFrame([(1, "q", "fine"), (2, "q", "boom")], "i int, question string, text string")
    got = {r["i"]: r for r in L.judge(rows, concurrent_replies(fn, tries=1)).collect()}
    assert got[1]["has_answer"] == 1 and got[2]["has_answer"] is None


# --- shards


def rows(spark, n=500):
    return spark.range(n).select(F.col("id").cast("string").alias("k"), (F.col("id") * 3).alias("v"))


def doubled(df):
    return df.select("k", (F.col("v") * 2).alias("w"))


def test_shards_are_even_ranges(spark):
    got = [r["count"] for r in spark.range(20000).groupBy(shard_of(F.col("id"), 16).alias("s")).count().orderBy("s").collect()]
    assert len(got) == 16 and min(got) > 1000


@pytest.mark.parametrize("kill_after", [0, 1, 3])
def test_a_killed_run_goes_on(spark, tmp_path, kill_after):
    folder, worked = f"file://{tmp_path}/s", []

    class Killed(Exception):
        pass

    def work(df):
        if len(worked) == kill_after:
            # the job's rows are on the disk, its entries aren't
            df.transform(doubled).withColumn("shard_", F.lit(0)).write.partitionBy("shard_").parquet(f"{folder}/data/half")
            raise Killed
        worked.append(df.count())
        return doubled(df)

    with pytest.raises(Killed):
        in_shards(rows(spark), "k", folder, work, shards=10, at_once=2)
    assert len(entries(spark, folder)) == 2 * kill_after
    before = {p: os.stat(p).st_mtime_ns for p in tmp_path.glob("s/done/*.json")}
    jobs = []
    got = in_shards(rows(spark), "k", folder, doubled, shards=10, at_once=2, after_job=jobs.append)
    assert sorted((r["k"], r["w"]) for r in got.collect()) == sorted((str(i), i * 6) for i in range(500))
    assert sum(map(len, jobs)) == 10 - 2 * kill_after and all(os.stat(p).st_mtime_ns == t for p, t in before.items())
    told = entries(spark, folder)
    assert sum(e["rows"] for e in told.values()) == 500 and told[0]["low"] == 0 and told[9]["high"] == 1 << 32 and all(told[k]["high"] == told[k + 1]["low"] for k in range(9))
    # a third run reads alone
    again = in_shards(rows(spark), "k", folder, lambda df: pytest.fail("nothing is left to do"), shards=10)
    assert again.count() == 500


def test_shards_of_awkward_rows(spark, tmp_path):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("a", 3)], "k string, v int")
    got = in_shards(df, "k", f"file://{tmp_path}/a", doubled, shards=4)
    assert sorted(r["w"] for r in got.collect()) == [2, 4, 6, 6]
    empty = in_shards(df.where("false"), "k", f"file://{tmp_path}/e", doubled, shards=4)
    assert empty.count() == 0 and empty.columns == ["k", "w"] and stored(spark, f"file://{tmp_path}/none") is None
    with pytest.raises(ValueError, match="another input"):
        in_shards(df.limit(1), "k", f"file://{tmp_path}/a", doubled, shards=4)
    assert in_shards(df.limit(1), "k", f"file://{tmp_path}/a", doubled, shards=4, force=True).count() == 1
    with pytest.raises(ValueError, match="shard_"):
        in_shards(df.withColumn("shard_", F.lit(1)), "k", f"file://{tmp_path}/x", doubled)


def test_labels_in_shards(spark, tmp_path):
    """The relevance labels of a dataset, asked shard by shard; the model fails half way, the next run asks for the rest alone."""
    df = spark.createDataFrame([(i, f"q{i}", ["one", "two", "three"]) for i in range(40)], "id int, query string, chunks array<string>")
    log, folder = tmp_path / "asked", f"file://{tmp_path}/labels"

    def ask(prompt):
        with open(log, "a") as f:
            f.write(prompt.split("\n")[0] + "\n")
        return "1, 3"

    def label(broken):
        def work(part):
            if broken and len(entries(spark, folder)) >= 4:
                raise RuntimeError("gone")
            return L.label_chunks(part, concurrent_replies(ask)).select("id", "relevance")

        return work

    with pytest.raises(RuntimeError):
        in_shards(df, "id", folder, label(True), shards=8, at_once=2)
    got = in_shards(df, "id", folder, label(False), shards=8, at_once=2)
    assert {(r["id"], tuple(r["relevance"])) for r in got.collect()} == {(i, (1, 0, 1)) for i in range(40)}
    asked = log.read_text().split()
    assert sorted(asked) == sorted(f"q{i}" for i in range(40))  # each once, over both runs


# --- versions


def test_readers_see_the_old_or_the_new_version(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    with pytest.raises(FileNotFoundError):
        read_published(spark, folder)
    publish(spark.range(3), folder)
    open_ = read_published(spark, folder)
    # a crash behind the rows and in front of the pointer
    spark.range(7).write.parquet(f"{folder}/v99999999999999999999-crash")
    assert read_published(spark, folder).count() == 3
    publish(spark.range(5), folder)
    assert read_published(spark, folder).count() == 5 and open_.count() == 3
    publish(spark.range(6), folder)
    assert read_published(spark, folder).count() == 6
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("v0")]) == 2
