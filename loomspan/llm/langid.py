"""Language identification: language family first, then one-versus-one linear SVMs inside the family.

Features are relative frequencies of hashed byte 2-, 3- and 4-grams of the whole text, letters of ASCII in
lower case, all other ASCII characters as one blank; the last grams of a text end in blanks. A family classifier (one linear SVM a family) picks the
family; inside it every pair of languages has a linear SVM, the language with the most pairs won is
predicted (ties: the larger sum of margins). A family with one language needs no second step.

Training takes a bounded sample: at most `per_language` rows of each language, those with the smallest hash
of their id; of rows with equal ids one is drawn. Prediction reads nothing
but the text: each text has its score whatever rows stand beside it, repeated rows get equal ones, and whole
texts of any length count. Null texts and texts without a letter are `und`, score 0. Without any labelled row
every text is `und`; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import text_bytes

# ISO 639-1 codes by family. A language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi fo",
    "romance": "fr es it pt ro ca gl oc la co sc",
    "slavic": "ru uk be pl cs sk bg mk sr hr bs sl",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "indo-aryan": "hi bn ur mr gu pa ne si as or",
    "iranian": "fa ps ku tg",
    "turkic": "tr az kk uz ky tk tt",
    "uralic": "fi et hu",
    "semitic": "ar he am mt",
    "dravidian": "ta te kn ml",
    "austronesian": "id ms tl jv su mg",
}
FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
BITS = 13
SIZE = 1 << BITS
WIDTH = 3 * SIZE
SCALE = 200.0


def _fold_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[:128] = 32
    t[97:123] = np.arange(97, 123)
    t[65:91] = np.arange(97, 123)
    return t


FOLD = _fold_table()


GAP = 3


def apart(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with GAP blanks behind each, and where each begins: no gram reads two texts."""
    size = np.diff(off)
    first = off[:-1] + GAP * np.arange(len(size))
    out = np.full(len(data) + GAP * len(size), 32, np.uint8)
    out[np.arange(len(data)) + GAP * np.repeat(np.arange(len(size)), size)] = data
    return out, first


def grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the 2-, 3- and 4-gram that starts at each byte (the last ones wrap into blanks)."""
    b = np.concatenate([FOLD[data], np.full(GAP, 32, np.uint8)]).astype(np.uint32)
    two = (b[:-3] << np.uint32(8)) | b[1:-2]
    three = (two << np.uint32(8)) | b[2:-1]
    four = (three << np.uint32(8)) | b[3:]
    mix = lambda x, m: ((x * np.uint32(m)) >> np.uint32(32 - BITS)).astype(np.int32)
    return mix(two, 0x9E3779B1), mix(three, 0x85EBCA6B) + np.int32(SIZE), mix(four, 0xC2B2AE35) + np.int32(2 * SIZE)


def scores(data: np.ndarray, off: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Mean weight rows over all grams of each text: (texts, columns), each a function of its text alone."""
    n = len(off) - 1
    out = np.zeros((n, weights.shape[1]))
    size = np.diff(off)
    full = np.flatnonzero(size > 0)
    if not len(full):
        return out
    wide, first = apart(data, off)
    g = grams(wide)
    bounds = np.stack([first[full], first[full] + size[full]], 1).ravel()  # the gaps are sums of their own
    for c in range(weights.shape[1]):
        w = weights[:, c].astype(np.float64)
        total = w[g[0]]
        total += w[g[1]]
        total += w[g[2]]
        out[full, c] = np.add.reduceat(total, bounds)[::2]
    out[full] *= SCALE / size[full, None]
    return out


def features(text: str) -> np.ndarray:
    """Dense feature row of one whole text, consistent with scores()."""
    data = np.frombuffer(text.encode(), np.uint8)
    x = np.zeros(WIDTH, np.float32)
    if len(data):
        for g in grams(data):
            x += np.bincount(g, minlength=WIDTH).astype(np.float32)
        x *= SCALE / len(data)
    return x


def train_svm(x: np.ndarray, gram: np.ndarray, y: np.ndarray, decay: float = 1e-3, steps: int = 400) -> tuple[np.ndarray, float]:
    """Linear SVM (squared hinge, y in -1/1, classes weighted equally) by accelerated full-batch descent.

    The weights stay a combination of the rows, so each step works on the Gram matrix (bias included).
    """
    cls = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    k = gram.astype(np.float64) + 1.0
    rate = 1 / (2 * float((np.diag(k) * cls).sum()) + decay)
    a = v = np.zeros(len(y))
    t = 1.0
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (k @ v))
        na = v - rate * (decay * v - 2 * cls * y * slack)
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v = na + ((t - 1) / nt) * (na - a)
        a, t = na, nt
    return (a.astype(np.float32) @ x).astype(np.float32), float(a.sum())


class LanguageModel:
    """families -> languages; weights as (WIDTH, columns) float32 and biases."""

    def __init__(self, x: np.ndarray, lang: list[str]):
        langs = np.array(lang, dtype=object)
        names = sorted(set(lang))
        fam = {a: FAMILY_OF.get(a, f"only {a}") for a in names}
        self.families = sorted(set(fam.values()))
        self.members = {f: [a for a in names if fam[a] == f] for f in self.families}
        of = np.array([fam[a] for a in lang], dtype=object)
        gram = x @ x.T
        fitted = [train_svm(x, gram, np.where(of == f, 1.0, -1.0).astype(np.float32)) for f in self.families] if len(self.families) > 1 else []
        self.family_w = np.stack([w for w, _ in fitted], 1) if fitted else None
        self.family_b = np.array([b for _, b in fitted])
        self.pairs = {}
        for f, own in self.members.items():
            duels = list(combinations(own, 2))
            if duels:
                part = []
                for a, b in duels:
                    rows = np.flatnonzero((langs == a) | (langs == b))
                    part.append(train_svm(x[rows], gram[np.ix_(rows, rows)], np.where(langs[rows] == a, 1.0, -1.0).astype(np.float32)))
                self.pairs[f] = (duels, np.stack([w for w, _ in part], 1), np.array([b for _, b in part]))

    def predict(self, data: np.ndarray, off: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(off) - 1
        sure = np.ones(n)
        if self.family_w is not None:
            m = scores(data, off, self.family_w) + self.family_b
            pick = m.argmax(1)
            sure = 1 / (1 + np.exp(-2 * m[np.arange(n), pick]))
        else:
            pick = np.zeros(n, int)
        out = np.empty(n, dtype=object)
        for k, f in enumerate(self.families):
            rows = np.flatnonzero(pick == k)
            own = self.members[f]
            if not len(rows):
                continue
            if len(own) == 1:
                out[rows] = own[0]
                continue
            duels, w, b = self.pairs[f]
            size = np.diff(off)[rows]
            part = np.concatenate([data[off[i] : off[i + 1]] for i in rows]) if len(rows) < n else data
            m = scores(part, np.concatenate([[0], np.cumsum(size)]), w) + b
            wins, sums = np.zeros((len(rows), len(own))), np.zeros((len(rows), len(own)))
            for j, (a, c) in enumerate(duels):
                ia, ic = own.index(a), own.index(c)
                wins[:, ia] += m[:, j] >= 0
                wins[:, ic] += m[:, j] < 0
                sums[:, ia] += m[:, j]
                sums[:, ic] -= m[:, j]
            best = (wins + 0.49 * sums / (1 + np.abs(sums))).argmax(1)
            out[rows] = np.array(own, dtype=object)[best]
            sure[rows] *= 1 / (1 + np.exp(-2 * sums[np.arange(len(rows)), best] / max(1, len(own) - 1)))
        return out.tolist(), sure


def fit(labelled: DataFrame, per_language: int = 300, max_rows: int = 1500) -> LanguageModel | None:
    """labelled: key (any), text, lang; the caller leaves out what mustn't be learned from.

    The sample is bounded: per_language rows a language, max_rows in all. Feature rows are made on the
    executors, so whole texts count and none travels.
    """
    rows = labelled.where("lang is not null").where(F.col("text").rlike(r"\p{L}"))
    sizes = {r["lang"]: max(1, r["n"]) for r in rows.groupBy("lang").agg(F.approx_count_distinct("key").alias("n")).collect()}
    if not sizes:
        return None
    each = max(1, min(per_language, max_rows // len(sizes)))
    rank = F.pmod(F.xxhash64(F.col("key").cast("string"), F.lit("sample")), F.lit(1 << 31)) / float(1 << 31)
    # about 1.5 times the wanted rows pass; the driver keeps the smallest ranks of each language
    limit = F.lit(0.0)
    for a, n in sizes.items():
        limit = F.when(F.col("lang") == a, F.lit(min(1.0, (1.5 * each + 40) / n))).otherwise(limit)
    # one row of each id, so that an id repeated very often is no larger sample
    picked = rows.select("lang", "text", rank.alias("rank")).where(F.col("rank") < limit).groupBy("lang", "rank").agg(F.min("text").alias("text")).select("lang", "text", "rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, text, r in zip(*(c.to_pylist() for c in b.columns)):
                x = features(text)
                at = np.flatnonzero(x)
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([r]), pa.array([at.astype(np.int16 if WIDTH < 32768 else np.int32).tobytes()], pa.binary()), pa.array([x[at].astype(np.float16).tobytes()], pa.binary())], ["lang", "rank", "at", "x"])

    got = picked.mapInArrow(run, "lang string, rank double, at binary, x binary").toArrow().to_pylist()
    got.sort(key=lambda r: (r["lang"], r["rank"], r["at"]))
    seen: dict[str, int] = {}
    x, lang = [], []
    for r in got:
        seen[r["lang"]] = seen.get(r["lang"], 0) + 1
        if seen[r["lang"]] <= each:
            row = np.zeros(WIDTH, np.float32)
            row[np.frombuffer(r["at"], np.int16 if WIDTH < 32768 else np.int32)] = np.frombuffer(r["x"], np.float16)
            x.append(row)
            lang.append(r["lang"])
    return LanguageModel(np.stack(x), lang)


def predict(docs: DataFrame, model: LanguageModel | None, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns, lang_pred and score for each row of docs. No shuffle; the model is bounded."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            k = b.num_columns - 2
            known = b.column(k + 1).to_numpy(zero_copy_only=False).astype(bool)
            step = 64
            for i in range(0, b.num_rows, step):
                part = b.slice(i, step)
                data, off = text_bytes(part.column(k))
                ok = known[i : i + step]
                if m is None:
                    lang, sure = ["und"] * part.num_rows, np.zeros(part.num_rows)
                else:
                    lang, sure = m.predict(data, off)
                    lang = [a if o else "und" for a, o in zip(lang, ok)]
                    sure = np.where(ok, np.clip(sure, 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([*part.columns[:k], pa.array(lang, pa.string()), pa.array(sure, pa.float64())], [*carry, "lang_pred", "score"])

    rows = docs.select(*carry, "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("has letters"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(carry)])
    return rows.mapInArrow(run, f"{schema}, lang_pred string, score double")
