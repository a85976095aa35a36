"""Token-level operators against hand-written values and plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from loomspan.functions import arrays as A
from loomspan.operators import tokens as K


def one(spark, value, fn, kind="array<int>"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first()["y"]


def pairs(rows):
    return [tuple(r) for r in rows]


def test_tokenize(spark):
    assert one(spark, "aé寿😀\n", K.tokenize, "string") == [97, 233, 0x5BFF, 0x1F600, 10]
    assert one(spark, None, K.tokenize, "string") == [] == one(spark, "", K.tokenize, "string")


def test_ranges(spark):
    assert pairs(one(spark, [3, 3], lambda c: K.running_ranges(c, offset=3))) == [(3, 6), (6, 9)]
    assert pairs(one(spark, [3, 2, 4], lambda c: K.running_ranges(c, gap=1, offset=5))) == [(5, 8), (9, 11), (12, 16)]
    assert pairs(one(spark, [3, 2, 4], lambda c: K.cumulative_ranges(c, 8))) == [(0, 3), (3, 6), (6, 8)]
    assert pairs(one(spark, [], K.running_ranges)) == []
    assert pairs(one(spark, 12, lambda c: K.pieces(c, 5), "int")) == [(0, 0, 5), (1, 5, 10), (2, 10, 12)] and one(spark, 0, lambda c: K.pieces(c, 5), "int") == []


def test_long_scans_copy_little(spark):
    n = 20_000
    got = one(spark, list(range(n)), lambda c: A.scan(c, F.lit(0), "int", lambda a, x: a + 1, lambda a, y: y))
    assert got == list(range(1, n + 1))


def test_merged_ranges(spark):
    kind = "array<struct<a:int,b:int>>"
    assert pairs(one(spark, [(0, 3), (3, 5), (7, 9)], K.merge_ranges, kind)) == [(0, 5), (7, 9)]
    assert pairs(one(spark, [(0, 9), (1, 2), (4, 12), (13, 14)], K.merge_ranges, kind)) == [(0, 12), (13, 14)]
    assert one(spark, [], K.merge_ranges, kind) == []
    rows = spark.createDataFrame([(1, 0, 9), (1, 1, 2), (1, 4, 12), (1, 13, 14), (2, 5, 6)], "k int, a int, b int")
    assert sorted(pairs(K.merged_rows(rows, "k").select("k", "a", "b").collect())) == [(1, 0, 12), (1, 13, 14), (2, 5, 6)]


def test_pruned_tokens(spark):
    df = spark.createDataFrame([("abcdefghij", [(0, 2), (2, 4), (5, 7), (8, 10)], [0.9, 0.8, 0.1, 0.7]), ("", [], [])], "t string, k array<struct<a:int,b:int>>, p array<double>")
    got = [tuple(r["y"]) for r in df.select(K.prune_tokens(F.col("t"), F.col("k"), F.col("p"), 0.5).alias("y")).collect()]
    assert got == [("abcd ij", 2, 3, 0.25), ("", 0, 0, 0.0)]


@pytest.mark.parametrize("width", [1, 7, 64, 1000])
def test_overlaps_as_brute_force(spark, width):
    rng = random.Random(width)
    cut = lambda: sorted((rng.randint(0, 200), rng.randint(0, 200)))
    tok = [(k % 3, k, *cut()) for k in range(60)]
    ch = [(k % 3, k, *cut()) for k in range(30)]
    want = sorted((k, i, j) for k, i, a, b in tok for m, j, c, d in ch if k == m and a < d and b > c and b > a and d > c)
    t = spark.createDataFrame(tok, "key int, i int, a int, b int")
    c = spark.createDataFrame(ch, "key int, chunk int, c int, d int")
    assert sorted(pairs(K.overlap_join(t, c, "key", width).select("key", "i", "chunk").collect())) == want


def test_chunks(spark):
    t = spark.createDataFrame([(1, 0, 0, 4, 0.9), (1, 1, 4, 8, 0.1), (1, 2, 9, 12, 0.2)], "key int, i int, a int, b int, p double")
    c = spark.createDataFrame([(1, 0, 0, 8), (1, 1, 8, 12), (1, 2, 50, 60)], "key int, chunk int, c int, d int")
    s = K.chunk_scores(t, c, "key", 0.5, 0.5)
    assert {r["chunk"]: (r["score"], r["keep"]) for r in s.collect()} == {0: (0.5, True), 1: (0.2, False), 2: (0.0, False)}
    r = K.chunk_predict(s, "key").first()
    assert r["kept"] == 1 and abs(r["compression"] - 2 / 3) < 1e-9


def test_pooling(spark):
    v = [0.2, 0.9, 0.4]
    assert [one(spark, v, lambda c, m=m: K.pool(c, m), "array<double>") for m in ("max", "first", "last")] == [0.9, 0.2, 0.4]
    assert one(spark, v, lambda c: K.pool(c, "other"), "array<double>") == pytest.approx(0.5) and one(spark, [], K.pool, "array<double>") == 0.5
    assert tuple(one(spark, [0.9, 0.1, 0.1], lambda c: K.threshold_decisions(c, F.lit(0.3)), "array<double>")) == (True, False)
    assert tuple(one(spark, [], lambda c: K.threshold_decisions(c, F.lit(0.3)), "array<double>")) == (True, True)


def test_labels(spark):
    spans = "array<struct<a:int,b:int,label:int>>"
    labels = lambda s, n: one(spark, s, lambda c: K.span_labels(F.lit(n), c), spans)
    assert labels([(1, 3, 1), (4, 6, 0)], 8) == [-100, 1, 1, -100, 0, 0, -100, -100]
    assert labels([(1, 3, 1), (4, 9, 0)], 5) == [-100, 1, 1, -100, 0] and labels([], 2) == [-100, -100] and labels([(7, 9, 1)], 2) == [-100, -100]
    tokens = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(a + 2).alias("b")) for a in (0, 2, 4, 6)])
    relevant = F.array(F.struct(F.lit(3).alias("a"), F.lit(5).alias("b")))
    assert one(spark, 0, lambda c: K.overlap_labels(tokens, relevant), "int") == [0, 1, 1, 0]
    document = F.struct(F.lit(2).alias("a"), F.lit(6).alias("b"))
    assert one(spark, 0, lambda c: K.overlap_labels(tokens, relevant, document), "int") == [-100, 1, 1, -100]


def test_blocks_and_documents(spark):
    got = one(spark, [5, 6, 7], lambda c: K.block_inputs(F.array(F.lit(9)), c))
    assert tuple(got) == ([1, 9, 2, 5, 6, 7, 2], [0, 0, 0, 1, 1, 1, 1], 3, 6)
    assert tuple(one(spark, [], lambda c: K.block_inputs(F.array(F.lit(9)), c)))[0] == [1, 9, 2]
    ids, types = [1, 9, 2, 5, 6, 7, 2], F.array(*[F.lit(x) for x in (0, 0, 0, 1, 1, 1, 1)])
    assert tuple(one(spark, ids, lambda c: K.document_span(c, types))) == (3, 6) == tuple(one(spark, ids, K.document_span))
    assert tuple(one(spark, [5, 6], K.document_span)) == (0, 2) and tuple(one(spark, [1, 2, 2], K.document_span)) == (2, 2)
    assert tuple(one(spark, [1, 9, 2, 2, 5, 2], K.document_span)) == (4, 5)
    assert one(spark, [4, 5], lambda c: K.pad(c, F.lit(4))) == [4, 5, 0, 0] and one(spark, [4, 5], lambda c: K.pad(c, F.lit(1))) == [4, 5]


def test_chunk_sums_as_pairs(spark):
    """Against all pairs: ranges without an order, overlapping, empty; two chunks of one number; no tokens; no chunks."""
    rng = random.Random(5)
    some = lambda n, most: [(rng.randrange(9), a, a + rng.randrange(most)) for a in (rng.randrange(200) for _ in range(n))]
    rows = [(k, some(rng.randrange(60), 30), some(rng.randrange(12), 50)) for k in range(20)] + [(20, [], some(3, 9)), (21, some(3, 9), []), (22, [], [])]
    rows = [(k, t, [rng.randrange(100) / 100 for _ in t], c) for k, t, c in rows]
    kind = "array<struct<i:int,a:int,b:int>>"
    d = spark.createDataFrame(rows, f"k int, t {kind}, p array<double>, c {kind}").repartition(2)
    got = {r["k"]: r["s"] for r in d.select("k", K.chunk_sums(F.col("t"), F.col("p"), F.col("c"), 0.4).alias("s")).collect()}
    for k, t, p, c in rows:
        want = {i: [0, 0, 0.0, 0] for i, _, _ in c}
        for i, x, y in c:
            for (j, a, b), v in zip(t, p):
                if max(a, x) < min(b, y):
                    want[i] = [want[i][0] + 1, want[i][1] + j, want[i][2] + v, want[i][3] + (v > 0.4)]
        assert {s["chunk"]: [s["tokens"], s["index_sum"], s["over"]] for s in got[k]} == {i: [w[0], w[1], w[3]] for i, w in want.items()}
        assert all(abs(s["p_sum"] - want[s["chunk"]][2]) < 1e-9 for s in got[k])


def test_chunk_queries_shuffle_no_tokens(spark):
    """Tokens are never rows: before, each was one in the shuffle of a join."""
    from loomspan.plans.registry import queries

    for name in ("chunk_overlap", "chunk_eval", "chunk_predict"):
        plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan


def test_scan_of_long_arrays(spark):
    """Results in order, nulls among them, for lengths around the stretches' bounds; null and empty arrays as they are. A long
    array costs far less than the square of its length."""
    import time

    rows = [(list(range(n)),) for n in (0, 1, 2, 3, 4, 5, 8, 9, 10, 99, 100, 101, 1000)] + [(None,)]
    d = spark.createDataFrame(rows, "x array<int>")
    sums = A.scan(F.col("x"), F.lit(0), "int", lambda at, n: F.when(n % 3 != 1, at + n), lambda at, end: F.coalesce(end, at))
    for r in d.select("x", sums.alias("y")).collect():
        at, want = 0, []
        for n in r["x"] or []:
            want.append(at + n if n % 3 != 1 else None)
            at = want[-1] if want[-1] is not None else at
        assert r["y"] == (None if r["x"] is None else want)
    long = spark.range(1).select(F.sequence(F.lit(1), F.lit(60_000)).alias("x"))
    began = time.time()
    assert long.select(F.element_at(A.scan(F.col("x"), F.lit(0), "bigint", lambda at, n: at + n, lambda at, end: end, "bigint"), -1)).first()[0] == 60_000 * 60_001 // 2
    assert time.time() - began < 20


def test_text_is_dealt_by_size(spark):
    """One part a core at least, more for larger tables; before, a table of over 128 MB was read in as few parts as it lay in."""
    from loomspan.plans import base

    rows = spark.range(1000).select("id", F.repeat(F.lit("x"), 100).alias("t"))
    size, before = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())), base.PART_BYTES
    try:
        base.PART_BYTES = size // 50
        assert base.spread(rows).rdd.getNumPartitions() in (50, 51)
    finally:
        base.PART_BYTES = before
    assert base.spread(rows).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
