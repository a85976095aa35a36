"""Text boundaries against hand-written values and plain Python loops."""

import random

import pytest
from pyspark.sql import functions as F

from loomspan.functions import splitters
from loomspan.functions import text as T


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first()["y"]


def many(spark, values, fn):
    rows = spark.createDataFrame(list(enumerate(values)), "k long, x string").select("k", fn(F.col("x")).alias("y")).collect()
    return [r["y"] for r in sorted(rows, key=lambda r: r["k"])]


def plain_overlong(text, limit):
    """Window by window: the last line end behind its first character, else the last mark, else all of it."""
    if len(text) <= limit:
        return [text] if text else []
    out = []
    while text:
        window = text[:limit]
        at = window.rfind("\n", 1) + 1
        if not at:
            at = max(window.rfind(c) for c in ".?!;:\n") + 1
        out.append(text[: at or len(window)])
        text = text[len(out[-1]) :]
    return out


def plain_multiline(text, strip):
    whole = [text.strip() if strip else text]
    if "\n" not in text:
        return whole
    lines = [x for x in text.splitlines(keepends=True) if x.strip()]
    if len(lines) < 2 or sum(text.count(c) for c in ".?!") >= len(lines) or max(len(x.strip()) for x in lines) > 1200:
        return whole
    return [x.strip() for x in lines] if strip else lines


def test_overlong_by_hand(spark):
    assert one(spark, "aaaa bbbb cccc; dddd eeee; ff", lambda c: T.split_overlong(c, 20)) == ["aaaa bbbb cccc;", " dddd eeee;", " ff"]
    assert one(spark, "a" * 10 + "\n" + "b" * 30, lambda c: T.split_overlong(c, 20)) == ["a" * 10 + "\n", "b" * 20, "b" * 10]
    assert one(spark, "\n" + "a" * 25, lambda c: T.split_overlong(c, 20)) == ["\n", "a" * 20, "a" * 5]
    assert one(spark, "", lambda c: T.split_overlong(c, 20)) == []


def test_overlong_as_a_loop(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("aaab .;\n?") for _ in range(rng.randint(0, 120))) for _ in range(300)] + ["x" * 2500 + ". " + "y" * 1300]
    assert many(spark, texts, lambda c: T.split_overlong(c, 17)) == [plain_overlong(t, 17) for t in texts]
    assert many(spark, texts, T.split_overlong) == [plain_overlong(t, 1200) for t in texts]


@pytest.mark.parametrize("strip", [False, True])
def test_multiline_as_a_loop(spark, strip):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab .\n\r\x0b\x85\u2028") for _ in range(rng.randint(0, 25))) for _ in range(400)]
    texts += ["a\rb", "a\x0bb", "a\x85b", "a\n\n\nb", "a\n" + " " * 1300 + "b", "a\n" + "b" * 1300, "a. b?\nc", "a\nb."]
    assert many(spark, texts, lambda c: T.split_multiline(c, strip)) == [plain_multiline(t, strip) for t in texts]


@pytest.mark.parametrize("strip", [False, True])
def test_multiline_counts_characters(spark, strip):
    """The bound is on a line's characters without the white space around it, however many bytes they take."""
    lines = ["é" * 1200, "é" * 1201, "寿" * 1200, "寿" * 601, " " * 700 + "é" * 1200 + "\u3000" * 700, " " + "é" * 1201, "b" * 1200, "b" * 1201]
    texts = [f"a\n{x}" for x in lines] + [f"{x}\r\na\r" for x in lines] + [f"a.\x0b{x}\u2028\n\n \r" for x in lines]
    assert many(spark, texts, lambda c: T.split_multiline(c, strip)) == [plain_multiline(t, strip) for t in texts]


def test_normalise(spark):
    norm = lambda value, whole, strip: one(spark, value, lambda c: T.normalize(c, F.lit(whole), strip), "array<string>")
    assert norm(["  hello  ", "", "\n"], "x", True) == ["hello"]
    assert norm([], " context ", True) == ["context"] and norm([], " context ", False) == [" context "]
    assert norm([" ", "a", None], "x", False) == [" ", "a"]
    assert norm([" ", ""], "  ", True) == ["  "]


def test_lists_of_items(spark):
    got = one(spark, "1: First item\n2: Second item. Third bullet? Fourth!", T.split_english)
    assert [s.rstrip() for s in got] == ["1: First item", "2: Second item.", "Third bullet?", "Fourth!"]
    got = one(spark, "1001: Item A\n1002: Item B\n", T.split_english)
    assert [s.strip() for s in got[:2]] == ["1001: Item A", "1002: Item B"]


@pytest.mark.parametrize(("text", "pieces"), [("- item one\n- item two\n- item three\n", 3), ("1. First entry\n2. Second entry\n3. Third entry\n", 6), ("A) Alpha\nB) Bravo\nC) Charlie\n", 3)])
def test_bullets_open_blocks(spark, text, pieces):
    assert len(one(spark, text, T.split_english)) == pieces


def test_long_sentences_break(spark):
    clause = "This clause goes on and on so that the sentence gets very long without other marks than the ones between clauses;"
    got = one(spark, "Intro sentence. " + clause * 30 + " and a last part that still reads well.", T.split_english)
    assert got[0].rstrip() == "Intro sentence." and len(got) > 2 and max(map(len, got)) <= 1200
    got = one(spark, "This clause " * 30, splitters.T.english_splitter(80))
    assert len(got) >= 4 and max(map(len, got)) <= 80
    with pytest.raises(ValueError):
        T.english_splitter(0)


def test_line_ends_stay(spark):
    lines = ["Deadlines piled up, and I kept talking about budgets.\n", "Next spring I plan a trip to Japan.\n", "Sushi is honestly my favourite.\n", "Later I watered the plants.\n"]
    assert one(spark, "".join(lines), T.split_english) == lines


def test_blank_texts(spark):
    for split in (T.split_english, T.split_auto, T.split_generic, T.split_regex, T.split_simple):
        assert one(spark, "", split) == []
    assert one(spark, " \n ", T.split_english) == [] and one(spark, " \n ", T.split_generic) == []


def test_japanese(spark):
    text = "寿司が好きです。ラーメンも好きです。"
    assert one(spark, text, T.split_auto) == ["寿司が好きです。", "ラーメンも好きです。"]
    assert one(spark, "Sushi tastes great. I enjoy ramen too.", T.split_auto) == ["Sushi tastes great. ", "I enjoy ramen too."]


def test_which_splitter(spark):
    assert splitters.resolve() is T.split_auto and splitters.resolve(None, "EN") is T.split_english and splitters.resolve(None, "ja") is T.split_japanese
    own = lambda c: F.array(c)
    assert splitters.resolve(own, "es") is own and splitters.resolve({"xx": own}, "xx") is own
    for args in ((None, "es"), ({"xx": own}, None), ({"xx": own}, "yy")):
        with pytest.raises(ValueError):
            splitters.resolve(*args)
    assert one(spark, "a-b", splitters.python_splitter(lambda t: t.split("-"))) == ["a", "b"]


def test_conversion_languages(spark):
    assert splitters.language_name("NO") == "norwegian" and splitters.language_name("French") == "french" and splitters.language_name("xx") is None
    assert len(splitters.LANGUAGES) == 16
    assert one(spark, "Un. Deux!  Trois", splitters.for_conversion("fr")) == ["Un.", "Deux!", "Trois"]
    assert one(spark, "Τι; Ναι.", splitters.for_conversion("el")) == ["Τι;", "Ναι."]
    with pytest.warns(UserWarning):
        splitters.for_conversion("xx")


def test_titles(spark):
    got = one(spark, "Title line\nBody line one\nBody line two", T.first_line_title)
    assert tuple(got) == ("Title line", "Body line one\nBody line two")
    assert tuple(one(spark, ["", "List Title", "Item A", "Item B"], T.first_item_title, "array<string>")) == ("List Title", ["Item A", "Item B"])
    assert tuple(one(spark, [" ", ""], T.first_item_title, "array<string>")) == ("", [" ", ""])
    assert one(spark, "- a\x0b", T.is_bullet) and one(spark, "-\x0b", T.is_bullet) and not one(spark, "-\n", T.is_bullet) and one(spark, "٣. a", T.is_bullet)


def test_cuts_of_long_texts(spark):
    rng = random.Random(1)
    text = "".join(rng.choice("aé寿😀 .") for _ in range(3000))
    spans = [sorted((rng.randint(-5, 3010), rng.randint(-5, 3010))) for _ in range(80)] + [[10, 5], [0, 0], [511, 513], [512, 1024]]
    got = spark.createDataFrame([(text, spans)], "t string, s array<array<int>>").select(T.extract_spans(F.col("t"), F.col("s")).alias("y")).first()["y"]
    assert got == [text[max(a, 0) : max(b, 0)] if b > a else "" for a, b in spans]


def test_sentences_far_apart(spark):
    text = "One. " + "x " * 400 + "Two. One. " + "y " * 400 + "Two."
    sentences = ["One.", "Two.", "One.", "absent", "Two.", "One."]
    got = spark.createDataFrame([(text, sentences)], "t string, s array<string>").select(T.text_to_spans(F.col("t"), F.col("s")).alias("y")).first()["y"]
    want, cursor = [], 0
    for s in sentences:
        at = text.find(s, cursor)
        at = text.find(s) if at < 0 else at
        if at >= 0:
            want.append([at, at + len(s)])
            cursor = at + len(s)
    assert got == want
