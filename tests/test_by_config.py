"""From configurations to results: evaluations, mixes, and the library functions behind them, against plain loops."""

import json
import warnings

import pytest
from pyspark.sql import functions as F

from loomspan.operators import by_config
from loomspan.operators import datasets as D
from loomspan.operators import evaluate as E
from loomspan.operators import prune as P
from loomspan.operators import tokens as K
from loomspan.operators.process import SHAPES, process, shape_check
from loomspan.sources.configs import ConfigError

RECORD = "id string, query string, texts array<string>, context_spans array<array<array<int>>>, context_spans_relevance array<array<int>>, labels array<int>"


def spans(*sentences):
    out, at = [], 0
    for s in sentences:
        out.append([at, at + len(s)])
        at += len(s)
    return "".join(sentences), out


def records(name, n):
    out = []
    for i in range(n):
        a, sa = spans("The red fox ran. ", "Nothing here. ", " ", "Fox and hound. ")
        b, sb = spans("Blue sky. ", "A red sun. ")
        # relevance as a mask, as a list of indices, and missing
        relevance = [[1, 0, 0, 1], [1]] if i % 3 else [[1, 0, 0, 0], None]
        out.append((f"{name}{i}", None if i % 5 == 4 else ("red fox" if i % 2 else "sky"), [a, b], [sa, sb], relevance, [1, 0]))
    return out


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("data")
    for name, n in (("one", 9), ("two/sub", 6)):
        for split, k in (("train", n), ("test", n), ("validation", 3)):
            spark.createDataFrame(records(f"{name[:3]}-{split}-", k), RECORD).write.parquet(f"file://{at}/{name}/{split}")
    return f"file://{at}"


def plain(rows, threshold):
    tp = fp = tn = fn = contexts = 0
    rates = []
    for _, query, texts, all_spans, relevance, _ in rows:
        if query is None:
            continue
        q = set(query.split())
        for text, own, flags in zip(texts, all_spans, relevance):
            sentences = [text[a:b] for a, b in own]
            if flags is None:
                gold = [0] * len(own)
            elif len(flags) == len(own):
                gold = [int(f != 0) for f in flags]
            else:
                gold = [int(i in flags) for i in range(len(own))]
            kept = []
            for s, g in zip(sentences, gold):
                if s.strip():
                    words = set(s.lower().replace(".", "").split())
                    p = int(round(len(q & words) / len(q), 6) > threshold)
                    kept.append(s * p)
                    tp, fp, tn, fn = tp + (g and p), fp + (p and not g), tn + (not p and not g), fn + (g and not p)
            contexts += 1
            whole = "".join(s for s in sentences if s.strip())
            rates.append((len(whole) - len("".join(kept))) / len(whole) * 100)
    return {"contexts": contexts, "tp": tp, "fp": fp, "tn": tn, "fn": fn, "mean_compression": sum(rates) / len(rates)}


def test_an_evaluation_by_configuration(spark, root, tmp_path):
    config = {"datasets": ["one", {"dataset_name": "two", "subset": "sub", "n_samples": 4}], "split": "test"}
    got = by_config.evaluate(spark, config, root, [0.1, 0.5], report=f"file://{tmp_path}/r").collect()
    assert {(r["dataset"], r["threshold"]) for r in got} == {(d, t) for d in ("one", "two:sub") for t in (0.1, 0.5)}
    for r in got:
        want = plain(records("one-test-", 9) if r["dataset"] == "one" else records("two-test-", 4), r["threshold"])
        assert {k: r[k] for k in ("contexts", "tp", "fp", "tn", "fn")} == {k: want[k] for k in ("contexts", "tp", "fp", "tn", "fn")}
        assert r["mean_compression"] == pytest.approx(want["mean_compression"], abs=1e-5) and r["span_skipped"] == 0
        p, q = r["tp"] / (r["tp"] + r["fp"]), r["tp"] / (r["tp"] + r["fn"])
        assert r["f2"] == pytest.approx(5 * p * q / (4 * p + q))
    told = json.loads((tmp_path / "r/report.json").read_text())["results"]
    assert len(told) == 4 and {x["dataset"] for x in told} == {"one", "two:sub"} and "### Threshold 0.5" in (tmp_path / "r/report.md").read_text()
    one = by_config.evaluate(spark, config, root, [0.5], targets=["two:sub"])
    assert [r["dataset"] for r in one.collect()] == ["two:sub"]
    with pytest.raises(ValueError, match="unknown datasets"):
        by_config.evaluate(spark, config, root, [0.5], targets=["three"])
    with pytest.raises(KeyError):
        by_config.evaluate(spark, {"datasets": ["one"], "split": "dev"}, root, [0.5])


def test_a_mix_by_configuration(spark, root):
    section = {"datasets": [{"dataset_name": "one", "upsample_factor": 2}, {"dataset_name": "two", "subset": "sub", "n_samples": 4}], "items": 1, "max_eval_samples": 5}
    train, held = by_config.mix(spark, {"data_args": section}, root, seed=3)
    got = train.collect()
    assert len(got) == 18 + 4 and {r["id"][:3] for r in got} == {"one", "two"} and all(len(r["texts"]) == len(r["labels"]) == 1 for r in got)
    assert held.count() == 5 and all("validation" in r["id"] for r in held.collect())
    alone, carved = by_config.mix(spark, {"data_args": {"dataset_name": "one", "validation_split_name": "none", "validation_split_samples": 2, "max_train_samples": 5}}, root)
    assert alone.count() == 5 and carved.count() == 2
    # a dataset's own items go before the section's
    own, _ = by_config.mix(spark, {"data_args": {"datasets": [{"dataset_name": "one", "items": 2}], "items": 1}}, root)
    assert {len(r["texts"]) for r in own.collect()} == {2}
    with pytest.raises(ConfigError):
        by_config.mix(spark, {"data_args": {}}, root)


def test_long_documents_with_a_function_of_ones_own(spark):
    rows = spark.createDataFrame([(1, 0, "red fox", "A red fox ran. The sky is blue. ", 1, " T ")], "query_id int, doc_index int, query string, text string, label int, given_title string")
    assert E.long_evaluation(rows, title=None, threshold=0.1, language="en").first()["pruned_text"] == "A red fox ran. "
    seen = {}

    def mine(contexts, threshold=0.5):
        seen["threshold"] = threshold
        return P.prune(contexts, None, threshold=threshold, language="en")

    got = E.long_evaluation(rows, mine, threshold=2.0, batch_size=3).first()  # batch_size isn't known and left out
    assert seen == {"threshold": 2.0} and got["pruned_text"] == "" and got["title"] == "T" and got["original_chars"] == 32


def test_losses_of_ones_own(spark):
    ranking = spark.createDataFrame([(1.0, 0.0), (2.0, 2.0), (9.0, -100.0)], "logit double, target double")
    tokens = spark.createDataFrame([(0.0, 0.0, 1), (0.0, 5.0, -100)], "drop double, keep double, label int")
    got = E.losses(ranking, tokens).first()
    assert got["ranking_loss"] == 0.5 and got["pruning_loss"] == pytest.approx(0.693147, abs=1e-6) and got["loss"] == pytest.approx(0.05 * 0.5 + got["pruning_loss"])
    mine = E.losses(ranking, tokens, ranking_loss_fn=lambda d: d.where("target > -100").agg(F.avg(F.abs(F.col("logit") - F.col("target"))).alias("ranking_loss")), pruning_loss_fn=lambda d: d.agg(F.lit(2.0).alias("pruning_loss"))).first()
    assert (mine["ranking_loss"], mine["pruning_loss"], mine["loss"]) == (0.5, 2.0, 2.025)


def test_shape_check(spark):
    told = shape_check(spark)
    assert [r["case"] for r in told] == list(SHAPES) and all(r["ok"] and r["error"] is None for r in told)
    assert {r["case"]: r["pruned_context"] for r in told}["nested"] == [["str", "str"], ["str"]]
    broken = shape_check(spark, lambda *a, **k: {"pruned_context": "x", "reranking_score": 1.0})
    assert [r["ok"] for r in broken] == [True, False, False, False, False]
    assert all("no model" in r["error"] for r in shape_check(spark, lambda *a, **k: (_ for _ in ()).throw(RuntimeError("no model"))))
    assert process(spark, *SHAPES["split"])["pruned_context"] == ["A red fox ran."]


def test_label_stats_with_compression(spark):
    r = spark.createDataFrame([(1, 0.5, 10.0), (1, float("nan"), 20.0), (0, None, 99.0)], "label int, score double, rate double")
    got = {x["label"]: x for x in E.label_stats(r, compression="rate").collect()}
    assert got[1]["mean_score"] == 0.5 and got[1]["mean_compression"] == 15.0 and got[0]["mean_score"] is None and got[0]["mean_compression"] == 99.0


def test_rows_of_datasets(spark):
    left = spark.createDataFrame([(1, [[0, 1]]), (2, [[0, 1], [1, 2]]), (3, None), (None, [])], "id int, spans array<array<int>>")
    values = spark.createDataFrame([(1, [[1]]), (2, [])], "id int, rel array<array<int>>")
    got = {r["id"]: r["rel"] for r in D.attach_by_id(left, values, "id", "rel", "spans").collect()}
    assert got == {1: [[1]], 2: [[], []], 3: [], None: []}
    q = spark.createDataFrame([(None, ["a"]), (" ", ["a"]), ("q", []), ("q", ["b"])], "query string, t array<string>")
    assert D.asked(q).count() == 3 and D.asked(q, blank=True).count() == 2 and D.asked(q, texts="t", blank=True).count() == 1
    p = spark.createDataFrame([(1, [("d1", "x")], [("d2", "y"), ("d3", "z")]), (2, None, [("d4", "w")])], "q int, positive_passages array<struct<docid:string,text:string>>, negative_passages array<struct<docid:string,text:string>>")
    got = D.unnest_passages(p, "positive_passages", "negative_passages", "q").collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, 0, "d2", "y"), (1, 0, 1, "d3", "z"), (1, 1, 0, "d1", "x"), (2, 0, 0, "d4", "w")]


def test_moving_average_and_time_left(spark):
    s = spark.createDataFrame([(1, i, float(i)) for i in range(1, 13)], "k int, step int, seconds double")
    got = {r["step"]: r for r in D.moving_average(s, "k", "step", F.col("seconds"), total=20).collect()}
    assert got[1]["mean"] == 1 and got[12]["mean"] == sum(range(3, 13)) / 10 and got[12]["eta"] == got[12]["mean"] * 8


def test_touched_by_a_plain_loop(spark):
    import random

    rng = random.Random(2)
    data = []
    for i in range(80):
        tok = sorted((a, a + rng.randint(0, 4)) for a in (rng.randint(0, 40) for _ in range(rng.randint(0, 12))))
        ranges = [(a, a + rng.randint(-1, 9)) for a in (rng.randint(0, 40) for _ in range(rng.randint(0, 5)))]
        data.append((i, tok, ranges))
    df = spark.createDataFrame(data, "i int, t array<struct<a:int,b:int>>, r array<struct<a:int,b:int>>")
    got = {x["i"]: x["h"] for x in df.select("i", K.touched(F.col("t"), F.col("r")).alias("h")).collect()}
    for i, tok, ranges in data:
        assert got[i] == [any(a < y and b > x and y > x and b > a for x, y in ranges) for a, b in tok]


def test_no_warnings_for_what_is_known(root, spark):
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        by_config.configs.mix_plan({"data_args": {"dataset_name": "one"}, "model_args": {"max_length": 64}, "training_args": {"bf16": True}})
