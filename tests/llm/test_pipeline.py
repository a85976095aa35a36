"""The stages one by one, each against a brute-force twin, on a small corpus."""

import hashlib
import json
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as C
from loomspan.llm import decontam, simhash, toxicity
from loomspan.llm.common import settle, table
from tests.llm.helpers import AWKWARD, brute_bytes, documents, least

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, FOLDER, "documents")
    columns = docs.columns
    bench = [r["text"] for r in table(spark, FOLDER, "benchmark").collect()]
    for k, (name, stage) in enumerate(C.STAGES):
        before = docs
        docs = settle(stage(spark, docs, FOLDER))
        if k + 1 < len(C.STAGES):
            assert docs.columns == columns and docs.schema["doc_id"].dataType == before.schema["doc_id"].dataType
        if name == "suffix_array":
            assert docs.count() == before.count() and docs.where("length(text) <> n_chars").count() == 0
        if name == "decontamination":
            kept = {r["doc_id"] for r in docs.collect()}
            m = decontam.Matcher(list(enumerate(bench)))
            assert kept == {r["doc_id"] for r in before.collect() if not m.match(r["text"])}
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r["doc_id"]: r for r in docs.collect()}
    for r in before.collect():
        ids = sp.encode(r["text"] or "", add_eos=True)
        assert got[r["doc_id"]]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[r["doc_id"]]["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


CLASHING = ("score", "predicted", "matches", "row", "place", "component_id", "fp", "node", "db", "label", "rank", "scored text", "a.b", "row_")


def test_columns_that_clash(spark, tmp_path):
    """Columns of any name pass all stages unchanged, beside null ids, repeated rows and an empty text."""
    rng = random.Random(3)
    text = lambda n: " ".join(f"w{rng.randint(0, 9000)}" for _ in range(n))
    rows = [(i, text(80), "en", "s", 1) for i in range(30)] + [(7, "", "en", "s", 0), (None, text(50), None, None, None)]
    rows += [rows[3], (40, None, None, None, None)]
    base = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    docs = base.select("*", *[F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in CLASHING])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, i % 3 == 0) for i in range(30)], "doc_id long, quality int, toxic boolean").selectExpr("doc_id", "quality", "cast(toxic as int) toxic").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "quite another item that occurs nowhere")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = table(spark, f"file://{tmp_path}", "documents")
    columns, seen = docs.columns, []
    for _, stage in C.STAGES[:-1]:
        docs = settle(stage(spark, docs, f"file://{tmp_path}"))
        assert docs.columns == columns
        seen.append(docs.count())
    assert seen[0] >= 15 and seen[-1] == seen[1]
    for r in docs.collect():
        assert all(r[c] == c + ("none" if r["doc_id"] is None else str(r["doc_id"])) for c in CLASHING)
    assert C.STAGES[-1][1](spark, docs, f"file://{tmp_path}").count() == seen[-1]


def test_stages_as_brute_force(spark):
    """Toxicity, SimHash and suffix arrays on a small corpus, each against a plain loop over what it was given."""
    folder = "/root/testdata/sf0.001"
    docs = table(spark, folder, "documents")
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, folder, "labels").collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    learn = [(t, labels[i]) for i, t in rows if i in labels and zlib.crc32(str(i).encode()) % 3 != 1]
    # order of the sample is by the ids' hash; a model doesn't depend on it beyond rounding
    model = toxicity.train([Counter(toxicity.words_of(t)) for t, _ in learn], np.array([y for _, y in learn]))
    mine = dict(zip([i for i, _ in rows], model.score([t for _, t in rows])))
    kept = {r["doc_id"] for r in C.drop_toxic(spark, docs, folder).collect()}
    sure = {i for i, s in mine.items() if s < 0.6}
    assert sure <= kept and not kept & {i for i, s in mine.items() if s >= 0.8}
    # one of each class of all pairs of fingerprints within the radius
    fp = np.stack([simhash.fingerprint(t, 5, 128) for _, t in rows])
    near = np.bitwise_count(fp[:, None] ^ fp[None]).sum(2) <= 26
    root = least(len(rows), [(int(a), int(b)) for a, b in np.argwhere(near)])
    want = {min(i for (i, _), r in zip(rows, root) if r == k) for k in set(root)}
    assert {r["doc_id"] for r in C.one_of_near_copies(spark, docs, folder).collect()} == want
    # bytes that brute force leaves
    want = brute_bytes(rows, 200)
    for r in C.drop_repeated_passages(spark, docs, folder).collect():
        n_bytes, gone, _, digest = want[r["doc_id"]][0]
        whole = len(r["text"].encode()) == n_bytes - gone  # else a character was cut in part
        assert hashlib.sha256(r["text"].encode()).hexdigest() == digest if whole else len(r["text"].encode()) < n_bytes - gone


def test_one_row_of_each_group(spark):
    rng = random.Random(7)
    a, b, c = (" ".join(f"w{rng.randint(0, 5000)}" for _ in range(200)) for _ in range(3))
    rows = [(5, a), (5, a), (5, a + " more"), (9, a), (None, a), (None, b), (None, b), (None, b + " more"), (5, c), (3, c + " more")]
    got = C.one_of_near_copies(spark, documents(spark, rows), FOLDER)
    assert got.columns == documents(spark, rows).columns
    kept = [(r["doc_id"], r["text"]) for r in got.collect()]
    assert len(kept) == 3 and {(i, t.removesuffix(" more")) for i, t in kept} == {(5, a), (None, b), (3, c)}


def test_awkward_rows(spark, tmp_path):
    rows = [(i, t, None, None, None) for i, t in AWKWARD]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = C.run(spark, f"file://{tmp_path}").collect()
    assert {r["doc_id"] for r in got} == {1, 4, 5, 6, 7, None}
    assert json.dumps([n for n, _ in C.STAGES])
