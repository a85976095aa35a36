"""Patterns and folds that read long texts once: the same results as the plain form, in time that grows with the text."""

import random
import time

import pytest
from pyspark.sql import functions as F

from loomspan.functions import text as T

SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
BREAK = r"\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}"
#: The same patterns in their plain form, as the SQL twins have them.
PLAIN = {
    T.SIMPLE: r"(?s).+?(?:。|！|？|!|\?|\n|\z)",
    T.GENERIC: r"(?s).+?(?:[.!?]|\n|\z)",
    T.LINES: rf"[^{BREAK}]*(?:\r\n|[{BREAK}])|[^{BREAK}]+",
    T.ENGLISH: rf"(?s).+?(?:[.!?]+[\"')\]]*(?:{SPACE}+|\z)|\z)",
    T.sentence_pattern(";·"): rf"(?s).+?(?:[.!?;·]+[\"')\]]*(?:{SPACE}+|\z)|\z)",
}


def odd_texts(n=3000):
    rng = random.Random(5)
    some = "ab.!?;·\"')] \t\n\r\x0b\x1c\x1f\x85\xa0    　。！𝒳é"
    return ["".join(rng.choice(some) for _ in range(rng.randrange(14))) for _ in range(n)]


def timed(df, limit):
    df.first()  # whatever has to be compiled
    began = time.time()
    got = df.first()
    assert time.time() - began < limit
    return got


@pytest.mark.parametrize("pattern", PLAIN, ids=["simple", "generic", "lines", "english", "greek"])
def test_patterns_cut_as_the_plain_ones(spark, pattern):
    texts = spark.createDataFrame([(x,) for x in odd_texts()], "t string")
    got = texts.select("t", T.extract(F.col("t"), pattern).alias("a"), T.extract(F.col("t"), PLAIN[pattern]).alias("b"))
    assert [r for r in got.collect() if r.a != r.b] == []


def test_trims_as_the_plain_ones(spark):
    texts = odd_texts()
    got = spark.createDataFrame([(x,) for x in texts], "t string").select("t", T.strip(F.col("t")).alias("s"), T.filled(F.col("t")).alias("f"), T.chomp(F.col("t")).alias("c"))
    for r in got.collect():
        assert (r.s, r.f, r.c) == (r.t.strip(), r.t.strip() != "", r.t.rstrip("\r\n"))


def test_strip_reads_a_long_run_of_blanks_once(spark):
    """A run inside of a text was read again from each of its blanks."""
    d = spark.createDataFrame([("a" + " " * 300_000 + "b\n",)], "t string")
    assert timed(d.select(F.length(T.strip(F.col("t"))).alias("n"), F.size(T.split_multiline(F.col("t"), True)).alias("k")), 10) == (300_002, 1)


def test_lines_of_a_long_text_are_read_few_times(spark):
    """Four million characters in lines with runs of blanks: looking for a line's white space read each run again from each blank."""
    line = "Anat with by of, höörd" + " " * 400 + "thnt eringing onheed\n"
    n = 4_000_000 // len(line)
    d = spark.createDataFrame([(line * n + "- and so on. ",)], "t string")
    for strip in (False, True):
        got = timed(d.select(T.split_multiline(F.col("t"), strip).alias("p")).select(F.size("p").alias("n"), F.array_join(F.slice("p", n, 2), "|").alias("last")), 3)
        assert tuple(got) == (n + 1, f"{line.strip()}|- and so on." if strip else f"{line}|- and so on. ")


def test_pieces_have_the_librarys_tokens(monkeypatch):
    """Ids and places of pieces put together are those of whole texts, and the library sees a word once, not each time."""
    import public_tokenizers

    from loomspan.operators import tokenizers as K

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert K._by_pieces(path)
    texts = [*odd_texts(60), "", "a|endoftext|> b <|endoftext|>c", "x " * 400, "don't  stop\n\n now, 12  345　 ok " * 20, "𝒳é日本語 。" * 9]
    asked = []
    encoded = K._encoded
    monkeypatch.setattr(K, "_encoded", lambda p, t: asked.append(sum(map(len, t))) or encoded(p, t))
    got, want = K._Pieces(path).encode(texts), encoded(path, texts)
    assert all((a == b).all() for a, b in zip(got, want))
    assert sum(asked) < sum(map(len, texts)) / 2
    few = K._Pieces(path)
    monkeypatch.setattr(K, "KEPT_PIECES", 3)
    for t in texts[-6:]:  # forgotten ones are asked for again
        assert all((a == b).all() for a, b in zip(few.encode([t]), encoded(path, [t])))


def test_spans_of_many_sentences(spark):
    """60,000 sentences of one text: an expression went through them at some ten microseconds each."""
    text = "".join(f"Sentence {i} of it. " for i in range(60_000))
    d = spark.createDataFrame([(text,)], "t string")
    got = timed(d.select(T.text_to_spans(F.col("t"), T.extract(F.col("t"), T.ENGLISH)).alias("s")), 8).s
    assert len(got) == 60_000 and got[0] == [0, 17] and got[-1][1] == len(text) - 1


def test_spans_of_odd_sentences(spark):
    rows = [("a b a b", [" b", "a ", "b", "a", "zz", "", None, "b"]), ("𝒳é 𝒳é", ["é", "𝒳"]), ("abc", None), (None, ["a"]), ("", [])]
    got = spark.createDataFrame(rows, "t string, s array<string>").coalesce(1).select(T.text_to_spans(F.col("t"), F.col("s")).alias("x"))
    assert [r.x for r in got.collect()] == [[[2, 3], [4, 5], [6, 7], [0, 1], [2, 3]], [[1, 2], [3, 4]], None, [], []]


def test_labels_take_ranges_as_they_are(spark):
    """Tokens with further fields need no copy without them; a bound that is null bounds nothing."""
    from loomspan.operators import tokens as K

    d = spark.range(1).select(K.pieces(F.lit(10), 4).alias("t"))
    relevant = F.array(F.struct(F.lit(5).alias("a"), F.lit(6).alias("b")))
    document = F.struct(F.lit(4).alias("a"), F.lit(None).cast("int").alias("b"))
    got = d.select("t", K.overlap_labels(F.col("t"), relevant).alias("x"), K.overlap_labels(F.col("t"), relevant, document).alias("y")).first()
    assert [tuple(r) for r in got.t] == [(0, 0, 4), (1, 4, 8), (2, 8, 10)]
    assert (got.x, got.y) == ([0, 1, 0], [-100, 1, 0])


def test_folds_of_many_sentences(spark):
    """60,000 fragments of a text: packing and reading predictions back went through them by expressions."""
    from loomspan.operators import evaluate as E
    from loomspan.operators import prune as P

    n = 60_000
    d = spark.createDataFrame([([3] * n, ["ab "] * n, "ab " * (n - 1))], "n array<int>, s array<string>, p string")
    packed, pred = P.pack(F.col("n"), F.lit(4), 37), E.infer_predictions(F.col("p"), F.col("s"))
    got = timed(d.select(F.element_at(packed, -1).alias("last"), F.aggregate(pred, F.lit(0), lambda a, x: a + x).alias("found")), 4)
    assert (got["last"]["block"], got["last"]["taken"], got["found"]) == (5999, 3, n - 1)


def test_folds_of_odd_rows(spark):
    from loomspan.operators import evaluate as E

    rows = [("ab", ["a", "", None, "x", "b"]), (None, ["a"]), ("a", None), ("a", [])]
    got = spark.createDataFrame(rows, "p string, s array<string>").coalesce(1).select(E.infer_predictions(F.col("p"), F.col("s")).alias("x"))
    assert [r.x for r in got.collect()] == [[1, 0, 0, 0, 1], [0], None, []]


def test_long_texts_without_marks_are_cut_in_reach(spark):
    """Two counted repeats in a row were tried in all pairs of lengths where no line end or mark was in reach."""
    d = spark.createDataFrame([("word " * 1_000_000,)], "t string")
    assert timed(d.select(F.size(T.split_overlong(F.col("t"))).alias("n")), 4).n == -(-5_000_000 // 1200)


def test_overlong_texts_by_a_plain_loop(spark):
    rng = random.Random(7)
    texts = odd_texts(200) + ["".join(rng.choice("ab .;\n") if rng.random() < 0.004 else "x" for _ in range(rng.randrange(5000))) for _ in range(60)]

    def plain(t, limit):
        out, at = [t] if 0 < len(t) <= limit else [], len(t) if len(t) <= limit else 0
        while at < len(t):
            here = t[at : at + limit]
            end = max((i for i in range(1, len(here)) if here[i] == "\n"), default=None)
            end = max((i for i, c in enumerate(here) if c in ".?!;:\n"), default=len(here) - 1) if end is None else end
            out.append(here[: end + 1])
            at += end + 1
        return out

    for limit in (2, 7, 900, 901, 1200):
        got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.split_overlong(F.col("t"), limit).alias("p")).collect()
        assert [r.t for r in got if r.p != plain(r.t, limit)] == []


def test_labels_of_many_spans(spark):
    """Spans given as an expression were made anew for each of them, and each label one by one."""
    from loomspan.operators import tokens as K

    d = spark.createDataFrame([(60_000,)], "n int")
    spans = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct((20 * i).alias("a"), (20 * i + 19).alias("b"), (i % 2).alias("label")))
    got = timed(d.select(K.span_labels(F.col("n") * 20, spans).alias("l")), 5).l
    assert len(got) == 1_200_000 and got[:41] == [0] * 19 + [-100] + [1] * 19 + [-100, 0]


def test_pieces_are_cut_where_the_pattern_cuts():
    import re

    import pyarrow as pa

    from loomspan.operators import tokenizers as K

    pattern = re.compile(rf"[{K.BLANK}]*[^{K.BLANK}]+|[{K.BLANK}]+")
    blanks = [chr(i) for i in range(0x3100) if re.match(rf"[{K.BLANK}]", chr(i))]
    texts = odd_texts(400) + [f"{b}a{b}{b}é{b}" for b in blanks] + ["".join(map(chr, range(1, 0x3100))), "", None, "𝒳 𝒳"]
    for some in (pa.array(texts), pa.array(["xx y", *texts])[1:], pa.array([], pa.string()), pa.array(["", ""])):
        n, pieces = K._cut(some.fill_null(""))
        want = [pattern.findall(t or "") for t in some.to_pylist()]
        assert n.tolist() == list(map(len, want)) and pieces.to_pylist() == [p for w in want for p in w]


def test_span_labels_of_a_files_tokens(spark):
    """Against ranges found token by token, with shared tokens, spans over the ends and texts without any."""
    import public_tokenizers

    from loomspan.operators.tokenizers import FileTokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(3)
    rows = []
    for i, t in enumerate([*odd_texts(80), "naïve 😀😀 日本語 words here", "", "a b", None]):
        at = sorted(rng.sample(range(len(t or "") + 8), 6)) if len(t or "") + 8 >= 6 else []
        rows.append((i, t, [(at[k], at[k + 1], k) for k in range(0, 6, 2)] if i % 9 else []))
    df = spark.createDataFrame(rows, "i int, t string, s array<struct<a:int,b:int,label:int>>").repartition(3)
    tok = FileTokenizer(path)
    for r in df.select("t", "s", tok.span_labels(F.col("t"), F.col("s")).alias("l"), F.get(tok.tokens(F.array("t")), F.lit(0)).alias("k")).collect():
        want = [next((s.label for s in r.s if k.a < s.b and k.b > s.a), -100) for k in r.k]
        assert r.l == want, (r.t, r.s)


def test_sentence_labels_of_a_files_tokens(spark):
    """The same by spans, with blank, absent and null sentences between, texts and lists that are null."""
    import public_tokenizers

    from loomspan.operators.tokenizers import FileTokenizer

    tok = FileTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [("One two. Three 4!  five", ["One two. ", " ", None, "absent", "Three 4!  ", "five"], [1, 7, 8, 9, 2, 3]), (None, ["a"], [1]), ("a b", None, None), ("x y", ["x ", "y"], [5, 6]), ("", [], [])]
    df = spark.createDataFrame(rows, "t string, s array<string>, l array<int>").coalesce(1)
    got = [r.x for r in df.select(tok.sentence_labels(F.col("t"), F.col("s"), F.col("l")).alias("x")).collect()]
    spans = [[(0, 8, 1), (9, 17, 2), (19, 23, 3)], [], [], [(0, 1, 5), (2, 3, 6)], []]
    df = spark.createDataFrame([(r[0], s) for r, s in zip(rows, spans)], "t string, s array<struct<a:int,b:int,label:int>>").coalesce(1)
    assert got == [r.x for r in df.select(tok.span_labels(F.col("t"), F.col("s")).alias("x")).collect()]
    assert set(got[0]) == {1, 2, 3, -100} and got[1:] == [[], [-100, -100], [5, 6], []]
