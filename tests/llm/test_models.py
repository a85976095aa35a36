import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomspan.llm import decontam, langid, queries, toxicity
from loomspan.llm.common import text_bytes
from tests.llm.helpers import AWKWARD, documents

SMALL = "/root/testdata/sf0.01"


def test_language_accuracy_on_held_out(spark):
    got = queries.op1_language_id(spark, SMALL)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang")
    r = got.where("held_out").join(docs, "doc_id").where("lang is not null").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert r["a"] >= 0.95 and r["lo"] >= 0 and r["hi"] <= 1


def test_language_edges(spark):
    labelled = spark.createDataFrame([(i, "the and of it is " * 3, "en") for i in range(20)] + [(50 + i, "der die und das ist " * 3, "de") for i in range(20)] + [(90 + i, "que los por la es " * 3, "es") for i in range(9)], "key long, text string, lang string")
    model = langid.fit(labelled)
    rows = documents(spark, AWKWARD + [(20, "12 !?"), (21, "und die das")])
    got = {r["doc_id"]: r for r in langid.predict(rows, model).collect()}
    assert got[1]["lang_pred"] == got[2]["lang_pred"] == got[3]["lang_pred"] == got[20]["lang_pred"] == "und" and got[20]["score"] == 0
    assert got[21]["lang_pred"] == "de"
    assert langid.fit(labelled.where("false")) is None
    assert {r["lang_pred"] for r in langid.predict(rows, None).collect()} == {"und"}


def test_language_of_a_text_alone(spark):
    """Each text's prediction, bit by bit, is the same alone and among any neighbours."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs.select(F.col("doc_id").alias("key"), "text", "lang"), per_language=60)
    a = {r["doc_id"]: tuple(r) for r in langid.predict(docs, model).collect()}
    b = {r["doc_id"]: tuple(r) for r in langid.predict(docs.orderBy(F.xxhash64("doc_id")).repartition(7), model).collect()}
    assert a == b and len(a) == 10000
    for t in ("es ist", "a", "é", "es ist " * 500):
        raw = t.encode()
        lone = model.predict(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        more = model.predict(np.frombuffer(b"the of " + raw + b"que los", np.uint8), np.array([0, 7, 7 + len(raw), 14 + len(raw)]))
        assert lone[0][0] == more[0][1] and lone[1][0] == more[1][1]


def test_toxicity_on_held_out(spark):
    got = queries.op5_toxicity(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    r = got.where("held_out").join(labels, "doc_id").groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()
    by = {x["toxic"]: x["p"] for x in r}
    assert by[1] >= 0.85 and by[0] <= 0.02


def test_misspellings_share_grams():
    rng = random.Random(0)
    plain = ["river", "stone", "table", "green", "window", "paper", "garden", "silver"]
    texts = [" ".join(rng.choice(plain) for _ in range(30)) for _ in range(200)]
    for i in range(60):
        ws = texts[i].split()
        ws[rng.randrange(30)] = rng.choice(["horrible", "horribly", "horrid"])
        texts[i] = " ".join(ws)
    m = toxicity.train([Counter(toxicity.words_of(t)) for t in texts], np.array([1] * 60 + [0] * 140))
    a, b, c, none = m.score(["river stone horribble green paper table stone garden", "river stone green paper table", "", None])
    assert a > 0.7 > 0.2 > b and c == none == 0


def test_score_is_the_softmax_of_the_weighted_average():
    """Against a plain loop over words and their subwords."""
    rng = np.random.default_rng(2)
    m = toxicity.ToxicityModel(rng.normal(size=toxicity.BUCKETS), rng.normal(size=toxicity.BUCKETS), -0.3)
    texts = ["a b b c", "lonely", "x" * 3000 + " y", "the " * 500 + "end", None, " ", "a b b c"]
    got = m.score(texts)
    for t, g in zip(texts, got):
        top = low = 0.0
        for w in toxicity.words_of(t):
            ids = toxicity.subwords(w)
            a = np.exp(np.clip(np.mean([m.salience[i] for i in ids]), -12, 12))
            top, low = top + a * np.mean([m.bucket[i] for i in ids]), low + a
        assert g == 0 if not low else abs(g - 1 / (1 + np.exp(-(top / low - 0.3)))) < 1e-9
    assert got[0] == got[6] and m.score([texts[3]])[0] == got[3]


def test_repeated_ids(spark):
    docs = spark.createDataFrame([(i % 30, f"plain words here {i}" if i % 2 else f"nasty words there {i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 30, 1 - i % 2) for i in range(60)], "doc_id long, label int")
    out = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(out) == 60 and all(r["predicted"] == 1 - r["doc_id"] % 2 for r in out)


def test_toxicity_edges(spark):
    docs = documents(spark, AWKWARD)
    labels = spark.createDataFrame([(1, 1), (2, 1), (4, 0), (None, 1), (6, None)], "doc_id long, label int")
    assert toxicity.fit(docs, labels.where("label = 1")) is None
    rows = toxicity.score(docs, None).collect()
    assert len(rows) == len(AWKWARD) and all(r["score"] == 0 and r["predicted"] == 0 for r in rows)


def distance(item, text):
    prev, best = list(range(len(item) + 1)), len(item)
    for c in text:
        cur = [0]
        for j in range(1, len(item) + 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (item[j - 1] != c)))
        prev = cur
        best = min(best, cur[-1])
    return best


def edit(s, k, rng):
    s = list(s)
    for _ in range(k):
        i, o = rng.randrange(len(s)), rng.random()
        if o < 0.33:
            s[i] = rng.choice("abxyz")
        elif o < 0.66:
            s.insert(i, rng.choice("abxyz"))
        elif len(s) > 1:
            del s[i]
    return "".join(s)


def test_decontamination_as_brute_force(spark):
    rng = random.Random(5)
    rnd = lambda n: " ".join("".join(rng.choice("abcdef ") for _ in range(n)).split())
    items = [(i, rnd(rng.randint(24, 90))) for i in range(10)] + [(10, None), (11, ""), (12, "short")]
    docs = []
    for k in range(60):
        t = decontam.normal(rng.choice(items[:10])[1])
        docs.append((k, rnd(60).upper() + "\n" + edit(t, rng.randint(0, len(t) // 6), rng) + "  " + rnd(60)))
    docs += AWKWARD
    want = set()
    for i, t in docs:
        for j, u in items:
            u = decontam.normal(u)
            if len(u) >= decontam.MIN_CHARS:
                d = distance(u, decontam.normal(t))
                if d <= int(len(u) * decontam.RATE):
                    want.add((i, j, d))
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(r) for r in decontam.contaminated(documents(spark, docs), bench).collect()} == want and len(want) > 20
    assert decontam.contaminated(documents(spark, docs), bench.where("false")).count() == 0


def test_short_items_match_verbatim(spark):
    items = [(1, "Who  won?"), (2, "x"), (3, " "), (4, "a" * 23), (5, "(b)"), (6, "Who won?"), (7, "cat sat")]
    docs = [(1, "so WHO\nwon? They"), (2, "who wonn? xx"), (3, "x"), (4, "a" * 23), (5, "a" * 24), (6, "f(b)g"), (7, "concat sat cat sat."), (8, "concat sat"), (9, ""), (10, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in decontam.contaminated(documents(spark, docs), bench).collect()}
    assert got == {(1, 1, 0), (1, 6, 0), (3, 2, 0), (4, 4, 0), (6, 5, 0), (7, 7, 0)}


def test_item_blocks_cover_all(spark):
    bench = spark.createDataFrame([(i, "x" * 50) for i in range(20)], "item_id long, text string")
    blocks = decontam.item_blocks(bench, 200)
    assert len(blocks) == 5 and sum(b.count() for b in blocks) == 20


def test_ids_repeated_very_often_are_no_larger_sample(spark, monkeypatch):
    """One id a thousand times among others: it is drawn once."""
    seen = {}
    monkeypatch.setattr(langid, "LanguageModel", lambda x, lang: seen.setdefault("lang", list(lang)))
    rows = [(7, f"the same words again {i % 3}", "en") for i in range(1000)] + [(100 + i, "und noch ein Satz", "de") for i in range(5)]
    langid.fit(spark.createDataFrame(rows, "key long, text string, lang string").repartition(4))
    assert seen["lang"] == ["de"] * 5 + ["en"]
    monkeypatch.setattr(toxicity, "train", lambda bags, y: seen.setdefault("y", (len(list(bags)), y.tolist())))
    docs = spark.createDataFrame([(7, "bad words")] * 300 + [(8 + i, f"good words {i}") for i in range(4)], "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1)] * 200 + [(8 + i, 0) for i in range(4)], "doc_id long, label int")
    toxicity.fit(docs.repartition(3), labels)
    assert seen["y"] == (5, [0, 0, 0, 0, 1])


def plain_language(model, text):
    """(language, score) by a plain loop: the family with the largest margin, then every duel inside it."""
    x = langid.features(text).astype(np.float64)
    margin = {f: float(x @ model.family_w[:, i].astype(np.float64) + model.family_b[i]) for i, f in enumerate(model.families)}
    family = max(margin, key=margin.get)
    sure = 1 / (1 + math.exp(-2 * margin[family]))
    own = model.members[family]
    if len(own) == 1:
        return own[0], sure
    wins, sums = dict.fromkeys(own, 0), dict.fromkeys(own, 0.0)
    duels, w, b = model.pairs[family]
    for j, (p, q) in enumerate(duels):
        m = float(x @ w[:, j].astype(np.float64) + b[j])
        wins[p if m >= 0 else q] += 1
        sums[p] += m
        sums[q] -= m
    best = max(own, key=lambda a: (wins[a], sums[a]))
    return best, sure / (1 + math.exp(-2 * sums[best] / (len(own) - 1)))


def test_prediction_by_a_plain_loop():
    rng = np.random.default_rng(4)
    words = {"en": "the and of house water", "de": "und der das haus wasser", "nl": "en het van huis water", "fr": "le la et maison eau", "es": "el los y casa agua", "fi": "ja talo vesi on se"}
    texts = [(lang, " ".join(rng.choice(w.split(), 12))) for lang, w in words.items() for _ in range(10)]
    model = langid.LanguageModel(np.stack([langid.features(t) for _, t in texts]), [lang for lang, _ in texts])
    assert len(model.families) == 3 and len(model.pairs) == 2
    mixed = [" ".join(rng.choice([w for v in words.values() for w in v.split()], rng.integers(1, 15))) for _ in range(60)]
    every = [t for _, t in texts] + mixed
    got, sure = model.predict(*text_bytes(pa.array(every)))
    for t, lang, s in zip(every, got, sure):
        want, score = plain_language(model, t)
        assert lang == want and s == pytest.approx(score, abs=1e-5)
