"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly.

A word's vector is the mean of the vectors of its hashed character 3- to 5-grams (with word ends) and of the
word itself, so an unseen misspelling shares most of its vector with the word it came from. A text is the bag
of all its words: their vectors are averaged, each weighted by its salience, the exponential of a learned
linear function of the same vector, so that one slur counts in a book as it does in a line. A two-class
softmax scores the average; embeddings, salience and softmax are trained together in numpy by full-batch Adam.

Training takes a bounded sample: at most `per_class` labelled rows of each class, those with the smallest hash
of their id, as whole texts; of repeated ids each row counts as one. It is all that reaches the driver, as
bags of distinct words. Scores read nothing but the text: repeated rows get equal ones. Texts without words,
null ones too, get the score 0; very long texts are read whole. Without both classes in the labels every
score is 0. Empty tables stay empty.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from loomspan.llm.common import give_back

WORD = re.compile(r"\w+(?:[@$*#]\w+)*")
BUCKETS = 1 << 17
DIM = 6
#: Words whose score and salience a worker keeps; a longer one than LONG characters is not kept.
CACHE_ENTRIES, LONG = 200_000, 64
#: Saliences lie between exp(-SPAN) and exp(SPAN).
SPAN = 12.0


def subwords(word: str) -> list[int]:
    """Buckets of the word and of its character n-grams."""
    w = f"<{word}>".encode("utf-32-le")
    n = len(w) // 4
    crc = zlib.crc32
    out = [crc(w) % BUCKETS]
    for k in (3, 4, 5):
        out += [crc(w[4 * i : 4 * (i + k)]) % BUCKETS for i in range(n - k + 1)]
    return out


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def means(words: list[str], *columns: np.ndarray) -> list[np.ndarray]:
    """The mean of each column over each word's subwords."""
    ids, ends = array("i"), [0]
    for w in words:
        ids.extend(subwords(w))
        ends.append(len(ids))
    at = np.frombuffer(ids, np.int32)
    size = np.diff(ends)
    return [np.add.reduceat(c[at], ends[:-1]) / size for c in columns]


class ToxicityModel:
    """What prediction needs: the score and the salience of each bucket, and a bias."""

    def __init__(self, score: np.ndarray, salience: np.ndarray, bias: float):
        self.bucket, self.salience, self.bias = score.astype(np.float64), salience.astype(np.float64), float(bias)
        self.reset()

    def reset(self) -> None:
        self.place: dict[str, int] = {}
        self.value, self.weight = np.zeros(0), np.zeros(0)

    def __getstate__(self):
        return {"bucket": self.bucket, "salience": self.salience, "bias": self.bias}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.reset()

    def learn(self, new: list[str]) -> None:
        if new:
            s, z = means(new, self.bucket, self.salience)
            self.place.update(zip(new, range(len(self.value), len(self.value) + len(new))))
            self.value = np.concatenate([self.value, s])
            self.weight = np.concatenate([self.weight, np.exp(np.clip(z, -SPAN, SPAN))])

    def score(self, texts: list[str | None]) -> list[float]:
        if len(self.place) > CACHE_ENTRIES:
            self.reset()
        cut = [words_of(t) for t in texts]
        new = set().union(*cut).difference(self.place)
        self.learn(sorted(new))
        size = np.fromiter(map(len, cut), np.int64, len(cut))
        full = np.flatnonzero(size)
        out = np.zeros(len(cut))
        if len(full):
            get = self.place.__getitem__
            at = np.fromiter((get(w) for ws in cut for w in ws), np.int64, int(size.sum()))
            start = (np.cumsum(size) - size)[full]
            a = self.weight[at]
            logit = np.add.reduceat(a * self.value[at], start) / np.add.reduceat(a, start) + self.bias
            out[full] = 1 / (1 + np.exp(-np.clip(logit, -50, 50)))
        if any(len(w) > LONG for w in new):
            self.reset()
        return out.tolist()


def train(bags: Iterable[dict[str, int]], labels: np.ndarray, steps: int = 160, rate: float = 0.06, decay: float = 1e-4, seed: int = 7) -> ToxicityModel:
    """Joint training on whole texts' bags (word -> how often, none empty); labels 0/1, both weighing the same in all."""
    vocab: dict[str, int] = {}
    word, count, size = array("i"), array("f"), []
    for bag in bags:
        for w, n in bag.items():
            word.append(vocab.setdefault(w, len(vocab)))
            count.append(n)
        size.append(len(bag))
    packed, cnt = array("i"), array("i")
    for w in vocab:
        x = subwords(w)
        packed.extend(x)
        cnt.append(len(x))
    sub, cnt = np.frombuffer(packed, np.int32), np.array(cnt)
    known = np.zeros(BUCKETS, bool)
    known[sub] = True
    used = np.flatnonzero(known)
    sub = (np.cumsum(known, dtype=np.int32) - 1)[sub]
    sub_at = np.cumsum(cnt) - cnt
    del packed, vocab
    word, count = np.frombuffer(word, np.int32), np.frombuffer(count, np.float32).astype(np.float64)
    text_at = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(size), dtype=np.int32), size)
    y = labels.astype(np.float64)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    rng = np.random.default_rng(seed)
    # salience begins along the score's direction: what speaks for toxicity speaks loudest
    soft = rng.normal(0, 1, (DIM, 2))
    par = [np.zeros((len(used), DIM)), soft, np.array([0.0, -2.0]), 0.5 * (soft[:, 1] - soft[:, 0])]
    mom = [[np.zeros_like(p), np.zeros_like(p)] for p in par]
    for step in range(1, steps + 1):
        emb, soft, bias, salient = par
        diff = soft[:, 1] - soft[:, 0]
        s = np.add.reduceat((emb @ diff)[sub], sub_at) / cnt
        z = np.add.reduceat((emb @ salient)[sub], sub_at) / cnt
        a = np.exp(np.clip(z, -SPAN, SPAN))[word] * count
        total = np.add.reduceat(a, text_at)
        share = a / total[owner]
        mean = np.add.reduceat(share * s[word], text_at)
        p = 1 / (1 + np.exp(-np.clip(mean + bias[1] - bias[0], -50, 50)))
        d = weight * (p - y)
        back = d[owner] * share
        g_s = np.bincount(word, back, len(cnt)) / cnt
        g_z = np.bincount(word, back * (s[word] - mean[owner]), len(cnt)) * (np.abs(z) < SPAN) / cnt
        by_s, by_z = np.bincount(sub, np.repeat(g_s, cnt), len(used)), np.bincount(sub, np.repeat(g_z, cnt), len(used))
        g_diff = by_s @ emb
        grads = [np.outer(by_s, diff) + np.outer(by_z, salient) + decay * emb, np.stack([-g_diff, g_diff], 1), np.array([-d.sum(), d.sum()]), by_z @ emb]
        for i, g in enumerate(grads):
            m, v = mom[i]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            par[i] = par[i] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    emb, soft, bias, salient = par
    value, loud = np.zeros(BUCKETS), np.zeros(BUCKETS)
    value[used], loud[used] = emb @ (soft[:, 1] - soft[:, 0]), emb @ salient
    return ToxicityModel(value, loud, bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, per_class: tuple[int, int] = (3000, 1200)) -> ToxicityModel | None:
    """docs: doc_id, text; labels: doc_id, label 0/1 (the caller leaves out what mustn't be learned from).

    At most per_class[label] rows of each class are taken, by the smallest hash of their id, one of each id.
    """
    known = labels.where("doc_id is not null and label in (0, 1)").select("doc_id", "label")
    n = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.approx_count_distinct("doc_id").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return None
    rank = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), F.lit(1 << 31)) / float(1 << 31)
    limit = F.when(F.col("label") == 1, min(1.0, (1.3 * per_class[1] + 40) / n[1])).otherwise(min(1.0, (1.3 * per_class[0] + 40) / n[0]))
    picked = known.withColumn("rank", rank).where(F.col("rank") < limit).distinct()

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rank, label, text in zip(*(c.to_pylist() for c in b.columns)):
                got = sorted(Counter(words_of(text)).items())
                yield pa.RecordBatch.from_pydict({"rank": [rank], "label": pa.array([label], pa.int32()), "words": pa.array(["\n".join(w for w, _ in got)]), "counts": pa.array([np.array([c for _, c in got], np.int32).tobytes()], pa.binary())})

    # the sample's distinct ids are bounded by per_class, so they may be broadcast; the texts become bags in place, and of rows
    # with equal ids one is drawn
    drawn = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("rank", F.col("label").cast("int").alias("label"), "text")
    each = drawn.mapInArrow(bags, "rank double, label int, words string, counts binary").where("words <> ''")
    got = each.groupBy("rank", "label").agg(F.min(F.struct("words", "counts")).alias("bag")).select("rank", "label", "bag.words", "bag.counts").toArrow().to_pylist()
    got.sort(key=lambda r: (r["label"], r["rank"], r["words"], r["counts"]))
    rows = [r for y in (0, 1) for r in [g for g in got if g["label"] == y][: per_class[y]]]
    del got
    y = np.array([r["label"] for r in rows])
    if len(set(y.tolist())) < 2:
        return None
    return train((dict(zip(r["words"].split("\n"), np.frombuffer(r["counts"], np.int32).tolist())) for r in rows), y)


def score(docs: DataFrame, model: ToxicityModel | None, threshold: float = 0.7, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns, score and predicted for each row. No shuffle; the model has a fixed size. Carried columns named
    score or predicted are an error: pack them in a struct."""
    if {"score", "predicted"} & {c.lower() for c in carry}:
        raise ValueError("score and predicted are names of results")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            k = b.num_columns - 1
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                s = np.array(m.score(part.column(k).to_pylist()) if m else [0.0] * part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.columns[:k], pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], [*carry, "score", "predicted"])
        if m:
            m.reset()
        give_back()

    rows = docs.select(*carry, F.col("text").alias("scored text"))
    schema = StructType([*rows.schema.fields[: len(carry)], StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    return rows.mapInArrow(run, schema)
