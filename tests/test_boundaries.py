"""Learned sentence boundaries against a plain loop, and the Japanese splitter's golden values."""

import math
import re
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from loomspan.functions import splitters
from loomspan.functions import text as T
from loomspan.operators import boundaries as B

TOKEN = regex.compile(r"[\p{L}\p{N}]+(?:[.'’-][\p{L}\p{N}]+)*\.?")
NUMBER = regex.compile(r"\p{N}+(?:[.,:-]\p{N}+)*")
TEXTS = (
    [f"Mr. No met Dr. Smith in hall {i}. The doctor left at once. They saw a man. The end came {i}. 3 men went." for i in range(30)]
    + [f"Das ist z. B. so gut. Wir sehen z. B. so etwas im Jahr {1900 + i}. Wir gehen. Die Leute kamen." for i in range(30)]
    + ["The hall is big. The doctor is gut. At once they left, they came. So etwas sehen wir. It is no man, it is so. A man went to smith."] * 20
    + [None, "", "...", "no end", "A. b. C. D"]
)


def plain(texts):
    kinds = lambda w: "##" if NUMBER.fullmatch(w[:-1] if w.endswith(".") else w) else (w[:-1] if w.endswith(".") else w).lower()
    pairs = []
    for t in texts:
        w = TOKEN.findall(t or "")
        k = [kinds(x) for x in w]
        pairs += [(k[i], w[i].endswith("."), k[i + 1] if i + 1 < len(w) else None) for i in range(len(w))]
    n, dots = Counter(k for k, _, _ in pairs), Counter(k for k, d, _ in pairs if d)
    total, periods = len(pairs), sum(dots.values())

    def ll(k, m, p):
        p = min(max(p, 1e-12), 1 - 1e-12)
        return k * math.log(p) + (m - k) * math.log(1 - p)

    out = {}
    for k, d in dots.items():
        if k == "##":
            continue
        points = k.count(".")
        letters = len(k) - points
        score = -2 * (ll(d, n[k], periods / total) - ll(d, n[k], 0.99)) * math.exp(-letters) * (points + 1) * letters ** -(n[k] - d)
        if score >= 0.3:
            out["abbreviation", k, None] = score
    held = lambda k: ("abbreviation", k, None) in out or len(k) == 1 and k.isalpha() or k == "##"
    both = Counter((k, x) for k, d, x in pairs if d and x is not None)

    def met(k, a, b):
        return -2 * (ll(k, a, b / total) + ll(b - k, total - a, b / total) - ll(k, a, k / a) - ll(b - k, total - a, (b - k) / max(total - a, 1)))

    for (k, x), c in both.items():
        if held(k) and c > 1 and c * total > n[k] * n[x] and met(c, n[k], n[x]) >= 7.88:
            out["collocation", k, x] = met(c, n[k], n[x])
    breaks = max(1, sum(c for (k, _), c in both.items() if not held(k)))
    starts = Counter()
    for (k, x), c in both.items():
        if not held(k) and x != "##":
            starts[x] += c
    for x, c in starts.items():
        if c * total > breaks * n[x] and met(c, breaks, n[x]) >= 30:
            out["starter", x, None] = met(c, breaks, n[x])
    return out


@pytest.fixture(scope="module")
def known(spark):
    docs = spark.createDataFrame([(t,) for t in TEXTS], "text string").repartition(3)
    return B.lexicon(docs)


def test_lexicon_by_a_plain_loop(known):
    got = {(r["kind"], r["type"], r["next"]): r["score"] for r in known.collect()}
    want = plain(TEXTS)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in got)
    assert ("abbreviation", "dr", None) in got and ("abbreviation", "z", None) in got and ("starter", "the", None) in got


def test_learned_boundaries(spark, known):
    split = B.learned_splitter(B.boundaries(known))
    cases = {
        "He met Dr. No today. The man left.": ["He met Dr. No today. ", "The man left."],
        "Das war z. B. so gemeint. Wir gehen.": ["Das war z. B. so gemeint. ", "Wir gehen."],
        "It was Dr. Smith! The end. Yes?": ["It was Dr. Smith! ", "The end. ", "Yes?"],
        "No. 3. and more": ["No. ", "3. and more"],
        "": [],
        " \n ": [],
        "no end": ["no end"],
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["s"] for r in df.select("t", split(F.col("t")).alias("s")).collect()} == cases


def test_pieces_stay_whole(spark, known):
    """Without leading white space of blocks, the sentences put the text together again."""
    split = B.learned_splitter(B.boundaries(known))
    df = spark.createDataFrame([(t,) for t in TEXTS if t], "t string")
    for r in df.select("t", split(F.col("t")).alias("s")).collect():
        assert "".join(r["s"]) == r["t"]


def test_lists_are_bounded(known):
    few = B.boundaries(known, most=1)
    assert len(few.abbreviations) == len(few.collocations) == len(few.starters) == 1
    assert few.abbreviations <= B.boundaries(known).abbreviations


def test_nothing_to_learn_from(spark):
    none = B.boundaries(B.lexicon(spark.createDataFrame([(None,)], "text string")))
    assert none == B.Boundaries()
    got = spark.createDataFrame([("A b. C d.",)], "t string").select(B.learned_splitter(none)(F.col("t")).alias("s")).first()["s"]
    assert got == ["A b. ", "C d."]


def test_conversion_takes_learned_boundaries(spark, known):
    lists = B.boundaries(known)
    split = splitters.for_conversion("de", learned=lambda marks: B.learned_splitter(lists, marks))
    got = spark.createDataFrame([("Wie z. B. so hier. Die Leute.",)], "t string").select(split(F.col("t")).alias("s")).first()["s"]
    assert got == ["Wie z. B. so hier.", "Die Leute."]


def test_no_entry_is_left_out(spark):
    """Every list was cut at its 2000 best entries."""
    n = 5000
    name = F.concat(F.lit("q"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"))
    ids = spark.range(n)
    row = lambda kind, type_, next_: ids.select(F.lit(kind).alias("kind"), type_.alias("type"), next_.cast("string").alias("next"), (1.0 + F.col("id")).alias("score"), F.lit(9).alias("n"))
    entries = row("abbreviation", name, F.lit(None)).unionByName(row("starter", F.concat(F.lit("s"), name), F.lit(None))).unionByName(row("collocation", F.lit("k"), F.concat(F.lit("z"), name)))
    docs = ids.select(F.concat(F.lit("Ab "), name, F.lit(". Then "), name, F.lit(". S"), name, F.lit(" k. Z"), name, F.lit(" end. 3. small? - x. Y.")).alias("text"))
    got = [r.sentences for r in B.split_learned(docs, entries).collect()]
    assert len(got) == n and {len(s) for s in got} == {5}
    known = B.boundaries(entries)
    assert len(known.abbreviations) == len(known.collocations) == len(known.starters) == n
    assert sorted(got) == sorted(r.s for r in docs.select(B.learned_splitter(known)(F.col("text")).alias("s")).collect())


def test_joined_lists_split_as_the_expression(spark, known):
    """With repeated rows, rows without a text, bullets, overlong pieces and no list at all."""
    extra = ["- Mr. no\n- z. B. so\n1. Dr.\n2. Smith", "Mr. " * 500 + "z. B. " * 300, " Dr.  Smith. \n\n Mr. No", "x. " * 4, "No 3. men. 3. Men."]
    docs = spark.createDataFrame([(i % 7, t) for i, t in enumerate([*TEXTS, *extra, *extra])], "k int, text string").repartition(3)
    none = known.where("false")
    for entries in (known, none):
        split = B.learned_splitter(B.boundaries(entries))
        want = docs.select("k", split(F.coalesce("text", F.lit(""))).alias("sentences"))
        got = B.split_learned(docs, entries)
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


JAPANESE = {
    "彼は「はい。そうです！」と言った。次の文。": ["彼は「はい。そうです！」と言った。", "次の文。"],
    "「『深い。』まだ。（（もっと！））」終わり！？次": ["「『深い。』まだ。（（もっと！））」終わり！？", "次"],
    "価格は３．５円です．（笑。）だよ。": ["価格は３．５円です．", "（笑。）だよ。"],
    "開いた「まま\n次の行。また。": ["開いた「まま\n", "次の行。", "また。"],
    "閉じ」だけ。はい。": ["閉じ」だけ。", "はい。"],
    "すごい！！(^o^)！ えっ?": ["すごい！！", "(^o^)！", " えっ?"],
    "「はい。」": ["「はい。」"],
    "a\n\nb": ["a\n", "\n", "b"],
    "！！。": ["！！。"],
    "": [],
}


def test_japanese_golden_values(spark):
    df = spark.createDataFrame([(k,) for k in JAPANESE], "t string")
    assert {r["t"]: r["s"] for r in df.select("t", T.split_japanese(F.col("t")).alias("s")).collect()} == JAPANESE


def test_japanese_by_a_plain_loop(spark):
    """An automaton over characters, on random texts of marks, brackets and letters."""
    import random

    rng = random.Random(5)
    texts = ["".join(rng.choice("あい3。！？．「」（）『\n a…") for _ in range(rng.randint(0, 40))) for _ in range(300)] + ["「あ。" * 3000]

    def automaton(t):
        out, now, depth, i = [], "", 0, 0
        while i < len(t):
            c = t[i]
            if c in T.OPENING:
                depth += 1
            elif c in T.CLOSING:
                depth = max(0, depth - 1)
            point = c == "．" and i and re.match(r"\d", t[i - 1]) and i + 1 < len(t) and re.match(r"\d", t[i + 1])
            now, i = now + c, i + 1
            if c == "\n":
                out.append(now)
                now, depth = "", 0
            elif c in "。！？!?｡．" and not point:
                while i < len(t) and t[i] in T.JAPANESE_MARKS + "…♪☆":
                    now, i = now + t[i], i + 1
                if depth == 0:
                    out.append(now)
                    now = ""
        return out + [now] * (now != "")

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", T.split_japanese(F.col("t")).alias("s")).collect():
        assert r["s"] == automaton(r["t"]), r["t"]
