"""Arrow shards read in ranges of record batches by several tasks."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomspan.sources import arrow


def table(n, first=0):
    words = pa.array([f"w{i % 7}" for i in range(first, first + n)]).dictionary_encode()
    return pa.table({"id": pa.array(range(first, first + n), pa.int64()), "texts": pa.array([[f"t{i}", None] if i % 5 else None for i in range(first, first + n)], pa.list_(pa.string())), "kind": words, "x": pa.array([i / 2 for i in range(first, first + n)])})


def write(path, t, kind, batch):
    path.parent.mkdir(parents=True, exist_ok=True)
    with (pa.ipc.new_stream if kind == "stream" else pa.ipc.new_file)(str(path), t.schema) as w:
        w.write_table(t, max_chunksize=batch)


@pytest.mark.parametrize("kind", ["stream", "file"])
def test_messages_by_their_heads(tmp_path, kind):
    write(tmp_path / "s.arrow", table(1000), kind, 100)
    with open(tmp_path / "s.arrow", "rb") as f:
        got = list(arrow.messages(f))
    assert [k for k, _, _ in got] == [arrow.SCHEMA, arrow.DICTIONARY, *[arrow.BATCH] * 10]
    assert all(a[2] == b[1] for a, b in zip(got, got[1:]))
    assert arrow.schema_of(f"file://{tmp_path}/s.arrow").names == ["id", "texts", "kind", "x"]


@pytest.mark.parametrize("kind", ["stream", "file"])
def test_a_shard_of_many_batches_goes_to_several_tasks(spark, tmp_path, kind):
    write(tmp_path / "d/a.arrow", table(2000), kind, 50)
    write(tmp_path / "d/b.arrow", table(300, 2000), kind, 1000)
    some = arrow.read_shards(spark, f"file://{tmp_path}/d", range_bytes=4000)
    got = some.withColumn("task", F.spark_partition_id()).collect()
    assert sorted(r["id"] for r in got) == list(range(2300))
    for r in got:
        i = r["id"]
        assert (r["texts"], r["kind"], r["x"]) == ([f"t{i}", None] if i % 5 else None, f"w{i % 7}", i / 2)
    assert len({r["task"] for r in got if r["id"] < 2000}) > 1
    few = arrow.read_shards(spark, f"file://{tmp_path}/d", ["x", "id"])
    assert few.columns == ["x", "id"] and few.count() == 2300


def test_shards_that_differ(spark, tmp_path):
    write(tmp_path / "d/a.arrow", table(5), "stream", 5)
    write(tmp_path / "d/b.arrow", table(5, 5).drop_columns(["x"]), "stream", 5)
    got = {r["id"]: r["x"] for r in arrow.read_shards(spark, f"file://{tmp_path}/d").collect()}
    assert got[4] == 2.0 and got[5] is None and len(got) == 10
    write(tmp_path / "e/a.arrow", table(0), "stream", 5)
    assert arrow.read_shards(spark, f"file://{tmp_path}/e").count() == 0
    with pytest.raises(FileNotFoundError):
        arrow.read_shards(spark, f"file://{tmp_path}/none")
