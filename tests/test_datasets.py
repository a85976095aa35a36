"""Datasets, labels, configurations, files and reports on small inputs."""

import json
import random
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomspan.functions import formats
from loomspan.operators import datasets as D
from loomspan.operators import evaluate as E
from loomspan.operators import labeling as L
from loomspan.sinks import files, reports, save
from loomspan.sources import configs
from loomspan.sources import datasets as S


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def sequential(data, limit):
    seen, out = {}, {}
    for i, texts in data:
        dup = sum(1 for t in texts if seen.get(t, 0) > 0)
        out[i] = (dup, dup <= limit)
        if dup <= limit:
            for t in texts:
                seen[t] = seen.get(t, 0) + 1
    return out


@pytest.mark.parametrize("limit", [0, 1, 2])
def test_frequency_filter_equals_sequential(spark, limit):
    rng = random.Random(4 + limit)
    data = [(i, [str(rng.randint(0, 25)) for _ in range(rng.randint(0, 4))]) for i in range(60)]
    got = D.frequency_filter(spark.createDataFrame(data, "idx long, texts array<string>"), limit).collect()
    assert {r["idx"]: (r["dup_count"], r["kept"]) for r in got} == sequential(data, limit)


@pytest.mark.parametrize("limit,at_once", [(0, 7), (1, 40), (2, 3), (5, 1)])
def test_frequency_filter_in_ranges(spark, limit, at_once):
    """Many small ranges, rows that share much, against the rows one after another."""
    rng = random.Random(at_once)
    data = [(i * 3 - 50, [rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(rng.randint(0, 5))]) for i in range(150)]
    seen, want = set(), []
    for i, texts in sorted(data):
        n = sum(t in seen for t in texts)
        want.append((i, n, n <= limit))
        if n <= limit:
            seen |= set(texts)
    left = []
    got = D.frequency_filter(spark.createDataFrame(data, "idx long, texts array<string>").repartition(3), limit, at_once=at_once, after_round=left.append)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert left[-1] == 0 and left == sorted(left, reverse=True)


def test_a_long_chain_takes_few_rounds(spark):
    """Each row depends on the one before; every other one goes."""
    n = 100_000
    chain = spark.range(n).select(F.col("id").alias("idx"), F.array(F.col("id").cast("string"), (F.col("id") + 1).cast("string")).alias("texts"))
    left = []
    got = D.frequency_filter(chain, 0, at_once=20_000, after_round=left.append)
    assert got.where("kept").count() == n // 2 and got.where("kept <> (idx % 2 = 0)").count() == 0 and len(left) < 20


def test_frequency_filter_by_hand(spark):
    df = spark.createDataFrame([(1, ["a"]), (2, ["a"]), (3, ["b", "a"])], "idx long, texts array<string>")
    kept = lambda n: [r["idx"] for r in D.frequency_filter(df, n).where("kept").orderBy("idx").collect()]
    assert kept(0) == [1] and kept(1) == [1, 2, 3]
    # each row depends on the one before
    chain = [(i, [f"t{i}", f"t{i + 1}"]) for i in range(8)]
    got = D.frequency_filter(spark.createDataFrame(chain, "idx long, texts array<string>"), 0).collect()
    assert {r["idx"]: r["kept"] for r in got} == {i: i % 2 == 0 for i in range(8)}
    assert D.frequency_filter(df.where("false"), 0).count() == 0
    with pytest.raises(ValueError):
        D.frequency_filter(df, -1)


def test_triplets(spark):
    df = spark.createDataFrame([(1, "", "q", "a", "n10", "n2", ""), (2, "x", None, "b", None, "", "m")], "i int, query string, question string, answer string, neg10 string, neg2 string, negative string")
    got = D.extract_fields(df, "i").orderBy("i").collect()
    assert [tuple(r) for r in got] == [(1, "q", "a", ["n10", "n2"]), (2, "x", "b", ["m"])]
    r = D.build_records(D.extract_fields(df, "i"), D.slug("a/b", "c"), "train", "i").orderBy("id").first()
    assert r["id"] == "a_b_c:train:1" and r["texts"] == ["a", "n10", "n2"] and r["labels"] == [1, 0, 0] and r["context_spans"] == [[[0, 1]], [[0, 3]], [[0, 2]]]
    listed = spark.createDataFrame([(["a", "", "b"], "p")], "question array<string>, pos string")
    assert D.extract_fields(listed).first()["query"] == "a b"
    for bad in ("", None):
        with pytest.raises(Exception, match="empty positive"):
            D.extract_fields(spark.createDataFrame([("q", bad)], "query string, pos string")).collect()


def test_items(spark):
    df = spark.createDataFrame([("a", [[0], [1, 0], [1, 1], [0, 0], [1, 0]], ["t0", "t1", "t2", "t3", "t4"], ["x"]), ("b", [[1]], ["u"], ["y"]), ("c", None, None, None)], "id string, r array<array<int>>, t array<string>, z array<string>")
    got = D.filter_items(df, "r", 2, ["t", "z"]).collect()
    assert [(r["id"], r["t"], r["z"]) for r in got] == [("a", ["t1", "t2"], ["x"])]
    assert D.filter_items(df, "r", 2, ["t"], reverse=True).first()["t"] == ["t1", "t4"]
    assert D.filter_items(df, "r", 2, ["t"], keep_first=True).first()["t"] == ["t0", "t2"]


def test_sampled_items(spark):
    kind = "id string, labels array<int>, texts array<string>, scores array<double>"
    df = spark.createDataFrame([("long", [1, 0, 0, 0], ["p", "a", "b", "c"], [0.1, 0.2, 0.3, 0.4]), ("short", [1, 0], ["p", "a"], [0.1, 0.2])], kind)
    got = D.sample_any_items(df, 3, 1, "id").collect()
    assert [r["id"] for r in got] == ["long"] and got[0]["texts"][0] == "p" and len(got[0]["texts"]) == len(got[0]["scores"]) == 3
    both = D.sample_any_items(spark.createDataFrame([("x", [1, 1, 0, 0], ["p1", "p2", "n1", "n2"], None)], kind), 2, 1, "id").first()
    assert both["texts"] == ["p1", "p2"] and both["scores"] is None
    assert len(D.sample_any_items(spark.createDataFrame([("x", [0] * 4, list("abcd"), [0.0] * 4)], kind), 2, 1, "id").first()["texts"]) == 2
    plain = df.drop("labels")
    assert D.reference_column(plain) == "texts" and D.reference_column(df.select("scores", "id")) == "scores" and D.reference_column(df.select("id")) is None
    one, two = (D.sample_any_items(plain, 2, 5, "id").orderBy("id").collect() for _ in range(2))
    assert one == two and all(len(r["texts"]) == len(r["scores"]) == 2 for r in one)
    assert D.sample_any_items(df.select("id"), 2, 1, "id").count() == 2


def test_prepared_mix(spark):
    a = spark.range(10).select(F.col("id").cast("string").alias("id"), F.lit("q").alias("query"), F.lit(1.0).alias("teacher.x"), F.lit(1).alias("only_a"))
    b = spark.range(10, 14).select(F.col("id").cast("string").alias("id"), F.lit("q").alias("query"), F.lit(2.0).alias("teacher_score"))
    train, val = D.prepare([D.Part(a, a.limit(6), teacher_column="teacher.x", n_samples=5), D.Part(b, upsample=1.5)])
    assert train.columns == ["query", "teacher_score", "copy", "id"] and train.count() == 5 + 6 and val.count() == 3
    train, val = D.prepare([D.Part(a, n_samples=0.2), D.Part(b, b.drop("query"))], validation=2)
    assert train.count() + val.count() == 2 + 4 and val.count() == 2
    assert D.prepare([D.Part(a)], max_train=3)[0].count() == 3 and D.prepare([D.Part(a)])[1] is None
    for bad in (0, 10, 1.5e9):
        with pytest.raises(ValueError):
            D.prepare([D.Part(a)], validation=bad)
    with pytest.raises(ValueError):
        D.prepare([D.Part(a, n_samples=0)])
    items = spark.createDataFrame([("x", [[1], [0], [1]], ["a", "b", "c"]), ("y", [[0]], ["d"])], "id string, context_spans_relevance array<array<int>>, texts array<string>")
    assert [r["texts"] for r in D.prepare([D.Part(items)], relevant_items=2, items=1)[0].collect()] in (["a"], [["a"]], [["c"]])


def test_ignored_questions(spark):
    p = spark.createDataFrame([(1, "fine?", "T", "x" * 50), (1, "fine?", "T", "y"), (2, "??", None, None), (3, "ok", "", "short")], "qid int, question string, title string, text string")

    def ask(prompt):
        assert "Positive passages:" in prompt
        return json.dumps({"ignore": 1, "reason": " malformed question" if "??" in prompt else "no answer in the passage"})

    got = rows(L.ignore_flags(p, 40, L.python_replies(ask)), "qid", "question", "reason")
    assert got == [(1, "fine?", "positive passage of 52 characters"), (2, "??", "malformed question")]
    assert L.ignore_flags(p, 1000).count() == 0


def test_pairs(spark):
    df = spark.createDataFrame([(1, [1, 0], None), (2, [1], [0.5])], "k int, l array<int>, s array<double>")
    assert rows(D.flatten_pairs(df, "k", "l", "s"), "k", "doc_index", "target", "docs_per_query") == [(1, 0, 1.0, 2), (1, 1, 0.0, 2), (2, 0, 0.5, 1)]
    with pytest.raises(Exception, match="neither"):
        D.flatten_pairs(spark.createDataFrame([(1, None, None)], "k int, l array<int>, s array<double>"), "k", "l", "s").collect()


def test_small_rules(spark):
    assert D.step_schedule(1000) == (50, 10) and D.step_schedule(3) == (1, 1)
    assert E.thresholds_of("0.1, 0.3,,0.1") == [0.1, 0.3] and E.threshold_label(1.0) == "1" and E.threshold_label(0.1234567) == "0.123457"
    assert E.pick_targets(["a", "b:x"], ["b:x"]) == ["b:x"] and E.pick_targets(["a"], None) == ["a"]
    with pytest.raises(ValueError, match="unknown"):
        E.pick_targets(["a"], ["c"])
    assert [formats.size(x) for x in (None, 5, 2048, 3 << 40, 1 << 60)] == ["unknown", "5.00B", "2.00KB", "3.00TB", "1048576.00TB"]
    assert formats.seconds(-1) == "00:00:00" and formats.seconds(3725.9) == "01:02:05" and formats.number(None) == "N/A" and formats.number(0.5) == "0.5000"
    assert formats.timing("x", {"total_seconds": 1.234}) == "[timing] x total=1.23s"
    first = D.sample_rows(spark.range(100), 3, 10, "id").collect()
    assert sorted(first) == sorted(D.sample_rows(spark.range(100).repartition(7), 3, 10, "id").collect()) and len(first) == 10
    places = D.shuffle_take(spark.range(100), 3, 10, "id").orderBy("place").collect()
    assert sorted(r["id"] for r in places) == sorted(r["id"] for r in first) and [r["place"] for r in places] == list(range(1, 11))


def test_reasons(spark):
    said = {"The question is malformed": True, "the passage has it": False, "query is fine, no answer in it": False, "Blank prompt; the passage is empty": True, "text only": False}
    df = spark.createDataFrame([(k,) for k in said], "r string").select("r", L.accepted_reason(F.col("r")).alias("a"))
    assert {r["r"]: r["a"] for r in df.collect()} == said


def test_ladder(spark):
    df = spark.createDataFrame([("q" * 300, ["c" * 300] * 12)], "q string, c array<string>")
    step = lambda n: df.select(L.prompt_ladder(F.col("q"), F.col("c"), n).alias("p")).first()["p"]
    assert [step(n)["step"] for n in (10_000, 3000, 1500, 600, 200, 50)] == [1, 2, 3, 4, 5, 0]
    assert step(10_000)["prompt"].startswith("q" * 256 + "\n---\n[1] ccc") and step(600)["prompt"].count("...") == 5 and step(200)["prompt"] == "q" * 100 + "\n---\n[1] none" and step(50)["prompt"] is None


def test_labeler(spark):
    df = spark.createDataFrame([(1, "which?", ["a", "b", "c"]), (2, "fail", ["a"]), (3, "none", [])], "id int, query string, chunks array<string>")

    def reply(prompt):
        if prompt.startswith("fail"):
            raise RuntimeError("no model")
        return "3, 1, 1, 99"

    got = {r["id"]: r["relevance"] for r in L.label_chunks(df, L.python_replies(reply)).collect()}
    assert got == {1: [1, 0, 1], 2: None, 3: []}


def test_judge(spark):
    df = spark.createDataFrame([(1, " ", "text"), (2, "q", None), (3, "boom", "x")], "id int, question string, text string")
    calls = []

    def reply(prompt):
        calls.append(prompt)
        if "boom" in prompt:
            raise RuntimeError
        return json.dumps({"contains_answer": int("(empty question)" in prompt), "answer_score": 0.5, "reason": "r"})

    got = L.judge(df, L.python_replies(reply, tries=2))
    assert rows(got, "id", "has_answer", "answer_score", "reasoning")[:2] == [(1, 1, 0.5, "r"), (2, 0, 0.5, "r")]
    assert got.where("id = 3").first()["has_answer"] is None
    assert tuple(L.judge_summary(got).first()) == (1, 1, 1, 0.5, 0.5, 0.5, 0.5)


def test_teacher_scores(spark):
    df = spark.createDataFrame([(1, ["aa", "b"]), (2, [])], "id int, texts array<string>")
    score = lambda p: p.repartition(3).select("id", "pos", F.length("text").cast("double").alias("score"))
    got = L.teacher_scores(df, "id", "texts", score)
    assert rows(got, "id", "teacher_scores") == [(1, [2.0, 1.0]), (2, [])]
    with pytest.raises(ValueError):
        L.teacher_scores(got, "id", "texts", score)
    assert rows(L.teacher_scores(got, "id", "texts", score, overwrite=True), "id", "teacher_scores") == [(1, [2.0, 1.0]), (2, [])]


def test_resume_and_upsert(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string")
    stored = spark.createDataFrame([(2, "old"), (9, "gone")], "id int, v string")
    assert rows(L.resume(base, stored, "id", lambda d: d.select("id", F.col("t").alias("v"))), "id", "v") == [(1, "a"), (2, "old")]
    assert rows(L.resume(base, None, "id", lambda d: d), "id") == [(1,), (2,)]
    assert rows(L.upsert(stored, base.select("id", F.col("t").alias("v")), "id"), "id", "v") == [(1, "a"), (2, "b"), (9, "gone")]


def test_long_records(spark):
    df = spark.createDataFrame([(1, float("nan")), (1, 0.5), (0, None)], "label int, score double")
    assert rows(E.label_stats(df), "label", "mean_score", "n") == [(0, None, 1), (1, 0.5, 2)]
    r = spark.createDataFrame([(q, i, "q", "t", i % 2, float(i)) for q in range(7) for i in range(3)], "query_id int, doc_index int, query string, title string, label int, reranking_score double")
    got = E.report_rows(r)
    assert got.select("query_id").distinct().count() == 5 and [x["doc_index"] for x in got.where("query_id = 0").orderBy("place").collect()] == [1, 2, 0]
    e = spark.createDataFrame([(1, 1, "abc"), (2, 1, "abc"), (3, 0, "abc")], "query_id int, label int, text string")
    assert rows(E.eligible(e, e.where("query_id = 2"), max_text_chars=2), "query_id", "text") == [(1, "ab")]
    assert E.eligible(e, include_negatives=True, max_text_chars=0).count() == 3


def test_losses(spark):
    df = spark.createDataFrame([(0.5, 1.0, 1), (0.0, -100.0, 0), (0.0, 0.0, -100)], "s double, t double, y int")
    assert E.ranking_mse(df, F.col("s"), F.col("t")).first()[0] == 0.125 and E.ranking_mse(df.where("false"), F.col("s"), F.col("t")).first()[0] == 0.0
    ce = E.pruning_ce(df, F.lit(0.0), F.lit(0.0), F.col("y")).first()[0]
    assert abs(ce - 0.693147) < 1e-5 and E.pruning_ce(df.where("y = -100"), F.lit(0.0), F.lit(0.0), F.col("y")).first()[0] == 0.0
    assert E.pruning_ce(df.limit(1), F.lit(float("nan")), F.lit(0.0), F.col("y")).first()[0] == 0.001
    assert df.select(E.total_loss(F.lit(2.0), F.lit(3.0)).alias("x")).first()["x"] == pytest.approx(3.1)
    steps = spark.createDataFrame([(i, float(i)) for i in range(1, 6)], "step int, loss double")
    assert rows(E.loss_means(steps, "step", 2, "loss"), "log_step", "loss") == [(2, 1.5), (4, 3.5), (6, 5.0)]


def test_saving(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    df = spark.range(5).withColumn("split", F.when(F.col("id") < 3, "train").otherwise("test"))
    save.save(df, path, by="split")
    with pytest.raises(FileExistsError):
        save.save(df, path)
    back = spark.read.parquet(path)
    save.save(back.where("id > 0"), path, overwrite=True, by="split")  # while it is read
    assert sorted(p.name for p in tmp_path.iterdir()) == ["out"]
    assert rows(S.load_split(S.load_dataset(spark, path), "train"), "id") == [(1,), (2,)]
    with pytest.raises(KeyError, match="test, train"):
        S.load_split(S.load_dataset(spark, path), "dev")
    name, part = S.slice_of(S.load_dataset(spark, path), "test[:1]", "id", limit=9)
    assert name == "test" and rows(part, "id") == [(3,)] and S.slice_of(S.load_dataset(spark, path), "test", "id", 1)[1].count() == 1
    with pytest.raises(ValueError):
        S.slice_of(df, "test[3:]", "id")
    save.save_shards(df, f"{path}2", shards=3)
    assert len(list((tmp_path / "out2").glob("part-*"))) == 3


def test_arrow_shards(spark, tmp_path):
    for split, parts in {"train": 2, "test": 1}.items():
        (tmp_path / split).mkdir()
        for k in range(parts):
            t = pa.table({"id": pa.array([k * 10, k * 10 + 1]), "text": ["a", None]})
            kind = pa.ipc.new_stream if k == 0 else pa.ipc.new_file
            with kind(str(tmp_path / split / f"data-{k}.arrow"), t.schema) as w:
                w.write_table(t)
    (tmp_path / "notes").mkdir()
    with pytest.warns(UserWarning, match="notes"):
        got = S.load_dataset(spark, f"file://{tmp_path}")
    assert rows(got.where("split = 'train'"), "id") == [(0,), (1,), (10,), (11,)] and got.where("split = 'test'").count() == 2
    assert rows(S.load_dataset(spark, f"file://{tmp_path}/train"), "id", "split")[0] == (0, "train")
    with pytest.raises(FileNotFoundError):
        S.load_dataset(spark, f"file://{tmp_path}/nothing")


def test_filtered(spark, tmp_path):
    train = spark.createDataFrame([(1, "i1", ["a"]), (2, "i2", ["a"]), (3, "i3", ["b", "a"]), (4, "i2", ["c"])], "idx long, id string, texts array<string>")
    told = save.save_filtered(train, {"test": train.limit(1)}, f"file://{tmp_path}/f", [0, 1], name="d")
    assert told[0]["rows"] == 4 and told[0]["drop_ids"] == 2 and told[0]["kept"] == 1 and told[1]["removed"] == 0
    assert (tmp_path / "f/freq0/drop_ids.txt").read_text().split() == ["i2", "i3"] and not (tmp_path / "f/freq1/drop_ids.txt").exists()
    assert json.loads((tmp_path / "f/frequency_filter_metadata.json").read_text())["thresholds"] == [0, 1]
    assert "| 1 | 2 | 0 | 2 |" in (tmp_path / "f/freq0/frequency_filter_ds_summary.md").read_text()
    assert S.load_split(S.load_dataset(spark, f"file://{tmp_path}/f/freq0/data"), "train").count() == 1
    save.save_filtered(train, {}, f"file://{tmp_path}/g", [0])
    assert (tmp_path / "g/drop_ids.txt").exists()


def test_evaluation_plan():
    raw = configs.parse('{"datasets": ["a", {"dataset_name": "b", "subset": "s", "split": "dev", "n_samples": "5"}]}')
    told = lambda split=None: [(d["key"], d["split"], d["n_samples"]) for d in configs.evaluation_plan(raw, split)]
    assert told() == [("a", "test", None), ("b:s", "dev", 5)] and told("x") == [("a", "x", None), ("b:s", "dev", 5)]
    assert configs.evaluation_plan({"datasets": ["a"], "split": "dev"})[0]["split"] == "dev"
    bad = {"is a mapping, not list": [], "datasets is missing": {}, "one entry at least": {"datasets": []}, r"datasets\[1\].dataset_name is missing": {"datasets": ["a", {}]}, r"datasets\[0\] is a mapping, not int": {"datasets": [3]}, "n_samples is int": {"datasets": [{"dataset_name": "a", "n_samples": "many"}]}}
    for message, payload in bad.items():
        with pytest.raises(configs.ConfigError, match=message):
            configs.evaluation_plan(payload)
    with pytest.warns(UserWarning, match=r"datasets\[0\].odd"):
        configs.evaluation_plan({"datasets": [{"dataset_name": "a", "odd": 1}]})


def test_mix_plan():
    plan = configs.mix_plan({"data_args": {"items": 3, "datasets": [{"dataset_name": "a"}, {"dataset_name": "b", "items": 5, "n_samples": 0.5}]}, "training_args": {"bf16": True}})
    assert [(d["dataset_name"], d["items"], d["n_samples"]) for d in plan["datasets"]] == [("a", 3, None), ("b", 5, 0.5)]
    alone = configs.mix_plan({"data_args": {"dataset_name": "a", "subset": "s", "teacher_column": "t"}})
    assert [(d["dataset_name"], d["subset"], d["teacher_column"]) for d in alone["datasets"]] == [("a", "s", "t")]
    for payload in ({}, {"data_args": {}}, {"data_args": {"dataset_name": "a", "filter_keep_first_item": "yes"}}):
        with pytest.raises(configs.ConfigError):
            configs.mix_plan(payload)


def test_ignore_lists(spark):
    lists = {"en": [{"qid": 1, "reason": " r "}, {"reason": "x"}, {"qid": "2"}]}
    assert rows(configs.ignore_list(spark, lists, "en"), "qid", "reason") == [("1", "r"), ("2", "")] and configs.ignore_list(spark, None, "jp").count() == 0
    merged = configs.merge_ignore_list(lists, "en", [{"qid": 2, "reason": "new"}, {"qid": 7}])
    assert [str(e["qid"]) for e in merged["en"]] == ["1", "2", "7"] and merged["en"][1]["reason"] == "new"


def test_files_of_configurations(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"split": "dev", "datasets": ["a", {"dataset_name": "b"}]}')
    plan = configs.evaluation_plan(configs.read(spark, f"file://{tmp_path}/c.json"))
    assert [(d["key"], d["split"]) for d in plan] == [("a", "dev"), ("b", "dev")]


def test_yaml(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("split: dev\ndatasets:\n  - a\n  - dataset_name: b\n")
    plan = configs.evaluation_plan(configs.read(spark, f"file://{tmp_path}/c.yaml"))
    assert [(d["key"], d["split"]) for d in plan] == [("a", "dev"), ("b", "dev")]


def test_reports(spark, tmp_path):
    results = {0.1: {"a": {"f2": 0.5, "recall": None, "tp": 3}}, 1.0: {}}
    text = reports.evaluation_markdown(results, {"Model": "m"})
    assert "* Model: m" in text and "* Thresholds: 0.1, 1" in text and "| a | 0.5000 | N/A | N/A | 0 | 3 |" in text and "(no datasets)" in text
    reports.write_evaluation(spark, f"file://{tmp_path}/r", results)
    assert json.loads((tmp_path / "r/report.json").read_text())["results"][0]["dataset"] == "a"
    r = spark.createDataFrame([(q, i, f"q{q}", "T", i % 2, 0.5, 10.0) for q in range(7) for i in range(2)], "query_id int, doc_index int, query string, title string, label int, reranking_score double, compression_rate double")
    text = reports.long_document_markdown(r)
    assert text.count("## ") == 5 and "| 1 | yes | 0.5000 | 10.00 | T |" in text
    j = spark.createDataFrame([(1, 1, 0.5, "r"), (2, None, None, None)], "id int, has_answer int, answer_score double, reasoning string")
    s = reports.write_judgements(j, f"file://{tmp_path}/j", {"language": "en"}, skipped=2)
    assert s["counts"] == {"has_answer_1": 1, "has_answer_0": 0, "failed": 1} and json.loads((tmp_path / "j/summary.json").read_text())["ignored_count"] == 2
    assert "- mean: 0.5000" in (tmp_path / "j/summary.md").read_text() and spark.read.parquet(f"file://{tmp_path}/j/records").count() == 2
    assert reports.write_judgements(j.where("id = 2"), f"file://{tmp_path}/k")["answer_score_stats"] is None
    assert reports.rows_by(j.where("id = 1"), "id", ["has_answer"]) == {"1": {"has_answer": 1}}


def test_scratch(spark):
    t = files.settle(spark.range(3))
    assert t.count() == 3 and files.exists(spark, t.settled_at)
    files.discard(t)
    assert not files.exists(spark, t.settled_at)
    session = lambda folder, master: SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=SimpleNamespace(master=master))
    assert files.scratch(session("hdfs://x/y/", "spark://host:7077")).startswith("hdfs://x/y/")
    assert files.scratch(session(None, "local[2]")).startswith("file:///tmp/")
    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(RuntimeError, match="checkpoint"):
            files.scratch(session(None, master))
