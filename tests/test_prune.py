"""The pruning chain on hand-made inputs."""

import pytest
from pyspark.sql import functions as F

from loomspan.functions import text as T
from loomspan.operators import prune as P
from loomspan.operators.process import process, shape_inputs, shape_titles
from loomspan.operators.scorers import FunctionScorer


def fixed(rank, keep):
    """A scorer that gives every block and every fragment the same number."""
    return FunctionScorer(lambda q, t: [rank] * len(t), lambda q, t: [keep] * len(t))


def table(spark, *texts, query="question"):
    return spark.createDataFrame([(0, k, query, t) for k, t in enumerate(texts)], "query_idx int, context_idx int, query string, context_text string")


def test_nothing_passes(spark):
    r = P.prune(table(spark, "Sentence 1"), threshold=0.5, scorer=fixed(0.87, 0.0)).first()
    assert (r["pruned_context"], r["reranking_score"], r["compression_rate"], r["removed_sentences"]) == ("", 0.0, 100.0, ["Sentence 1"])
    r = P.prune(table(spark, "Sentence 1"), threshold=0.5, scorer=fixed(0.73, 0.0), zero_score_when_empty=False).first()
    assert r["reranking_score"] == 0.73


def test_all_passes(spark):
    r = P.prune(table(spark, "Sentence 1"), threshold=0.5, scorer=fixed(0.42, 1.0)).first()
    assert (r["pruned_context"], r["reranking_score"], r["compression_rate"], r["removed_sentences"]) == ("Sentence 1", 0.42, 0.0, [])


def test_the_threshold_is_strict(spark):
    assert P.prune(table(spark, "a"), threshold=0.5, scorer=fixed(1.0, 0.5)).first()["kept"] == [False]
    assert P.prune(table(spark, "a"), threshold=0.5, scorer=fixed(1.0, 7.0)).first()["sentence_probabilities"] == [1.0]


def test_fragments_by_hand(spark):
    got = lambda texts, step, strip=False: [[tuple(f) for f in s] for s in spark.createDataFrame([(texts,)], "x array<string>").select(P.fragments(F.col("x"), step, strip).alias("y")).first()["y"]]
    assert got(["12345"], 2) == [[("12", 0, 0, 2), ("34", 0, 1, 2), ("5", 0, 2, 1)]]
    assert got(["ABCDEFG", "", "x"], 3) == [[("ABC", 0, 0, 3), ("DEF", 0, 1, 3), ("G", 0, 2, 1)], [], [("x", 2, 0, 1)]]
    assert got(["ab    cd"], 3, True) == [[("ab", 0, 0, 3), ("cd", 0, 2, 2)]]
    assert got(["x" * 2000], 1500)[0][0][3] == 1500
    assert P.fragment_limit(512) == 256 and P.fragment_limit(512, True) == 510 and P.fragment_limit(8) == 16


def test_sentences_stay_whole_on_demand(spark):
    long = "a" * 300 + ". " + "b" * 20 + "."
    seen = []

    def keep(queries, texts):
        return [float(len(t)) / 1000 for t in texts]

    for whole, want in ((False, [(256 + 46) / 2 / 1000, 0.021]), (True, [0.302, 0.021])):
        r = P.prune(table(spark, long, query="q"), sentence_splitter=lambda c: T.extract(c, T.ENGLISH), respect_sentence_boundaries=whole, scorer=FunctionScorer(lambda q, t: [1.0] * len(t), keep)).first()
        seen.append(r["sentence_probabilities"])
        assert [round(x, 6) for x in r["sentence_probabilities"]] == want


def test_packing_by_hand(spark):
    pack = lambda lengths, q, w: [(p["block"], p["taken"]) for p in spark.createDataFrame([(lengths,)], "x array<int>").select(P.pack(F.col("x"), F.lit(q), w).alias("y")).first()["y"]]
    assert pack([3, 3, 3], 1, 12) == [(0, 3), (0, 3), (1, 3)]
    assert pack([100], 1, 12) == [(0, 8)]
    assert pack([2, 100, 2], 1, 12) == [(0, 2), (1, 8), (2, 2)]
    assert pack([5, 5], 50, 12) == [(0, 1), (1, 1)]
    assert pack([], 1, 12) == []
    assert [b for b, _ in pack([1] * 1000, 0, 103)] == [i // 100 for i in range(1000)]


def test_titles_in_front(spark):
    t = table(spark, "One fox. Two.", "Nothing here.", query="fox")
    split = lambda c: T.extract(c, T.ENGLISH)
    rows = {r["context_idx"]: r for r in P.prune(t, "  My title ", threshold=0.5, always_select_title=True, sentence_splitter=split).collect()}
    assert rows[0]["sentences"] == ["My title\n", "One fox. ", "Two."] and rows[0]["kept"] == [True, True, False]
    assert rows[0]["pruned_context"] == "One fox. " and rows[0]["title"] == ["My title\n"] and rows[1]["kept"] == [False, False]
    forced = lambda title: [r["kept"] for r in P.prune(table(spark, "Two. One fox.", query="fox"), title, threshold=0.5, always_select_title=True, sentence_splitter=split).collect()][0]
    assert forced("first_sentence") == [True, True] and forced(None) == [False, True]
    assert P.prune(table(spark, "Two. One fox.", query="fox"), threshold=0.5, sentence_splitter=split).first()["kept"] == [False, True]
    many = t.withColumn("t", F.array(F.lit(" A "), F.lit(""), F.lit("B")))
    assert P.prune(many, F.col("t"), sentence_splitter=split).first()["title"] == ["A", "B\n"]


def test_first_line_as_title(spark):
    t = table(spark, "\nHead\nOne fox.\nTwo.", query="fox")
    r = P.prune(t, first_line_as_title=True, threshold=0.5).first()
    assert r["title"] == ["Head\n"] and r["context_text"] == "One fox.\nTwo." and r["pruned_context"] == "One fox.\n"
    with pytest.raises(ValueError):
        P.prune(t, "other", True)


def test_manual_sentences(spark):
    t = table(spark, "ignored").withColumn("manual_sentences", F.array(F.lit("one question"), F.lit(" "), F.lit(None).cast("string"), F.lit("two")))
    r = P.prune(t, threshold=0.5).first()
    assert r["context_text"] == "one questiontwo" and r["sentences"] == ["one question", "two"] and r["pruned_context"] == "one question"


def test_stripped_sentences(spark):
    r = P.prune(table(spark, " foo . bar.  . baz."), sentence_splitter=lambda c: T.extract(c, T.ENGLISH), strip_sentences=True, title="  prefix  ").first()
    assert r["sentences"] == ["prefix", "foo .", "bar.", ". baz."]


def test_blank_contexts(spark):
    rows = P.prune(table(spark, "", None, "   ")).orderBy("context_idx").collect()
    assert [(r["sentences"], r["pruned_context"], r["reranking_score"]) for r in rows] == [([""], "", 0.0), ([""], "", 0.0), (["   "], "", 0.0)]
    assert P.prune(table(spark, "x").where("false")).count() == 0


def test_blocks(spark):
    scores = {}

    def rank(queries, texts):
        return [float(t.count("x")) for t in texts]

    text = "a" * 400 + "x" * 300
    for best in (True, False):
        r = P.prune(table(spark, text, query="q"), title=None, window=256, sentence_splitter=lambda c: F.array(c), use_best_reranker_score=best, scorer=FunctionScorer(rank, lambda q, t: [1.0] * len(t))).first()
        scores[best] = r["reranking_score"]
        assert len(r["block_scores"]) == 5
    assert scores == {True: 188.0, False: 0.0}


def test_reordering(spark):
    t = spark.createDataFrame([(0, 0, 0.1), (0, 1, None), (0, 2, 0.9), (0, 3, 0.1), (1, 0, float("nan"))], "query_idx int, context_idx int, reranking_score double")
    order = lambda k: [r["context_idx"] for r in P.rerank(t, k).where("query_idx = 0").orderBy("rank").collect()]
    assert order(None) == [2, 0, 3, 1] and order(2) == [2, 0] and order(0) == [] and order(-3) == []


def test_top_k_needs_reordering(spark):
    with pytest.warns(UserWarning, match="reorder"):
        assert P.prune(table(spark, "a", "b"), top_k=1).count() == 2


def test_input_shapes():
    assert shape_inputs("question", [["s1", "s2"], ["s3"]]) == (["question"], [[["s1", "s2"], ["s3"]]], "list")
    assert shape_inputs(["a", "b"], [[["s1"], ["s2"]], [["s3"], ["s4"]]])[2] == "nested"
    assert shape_inputs("q", "text") == (["q"], [["text"]], "str")
    assert shape_inputs(["a", "b"], ["x", "y"]) == (["a", "b"], [["x"], ["y"]], "aligned")
    assert shape_inputs(["a"], ["x", "y"])[2] == "list"
    for q, c in ((["a", "b"], ["x"]), (["a", "b"], "x"), (["a", "b"], [["x"], "y"]), (["a", "b"], [["x"]]), ("a", 3)):
        with pytest.raises(ValueError):
            shape_inputs(q, c)


def test_title_shapes():
    assert shape_titles(None, [["x"]]) is None and shape_titles("T", [["x", "y"]]) == [[["T"], ["T"]]]
    assert shape_titles(["A", "B"], [["x", "y"]]) == [[["A"], ["B"]]]
    assert shape_titles(["A", "B"], [["x", "y"], ["z"]]) == [[["A"], ["A"]], [["B"]]]
    assert shape_titles([["A", "B"], ["C"]], [["x", "y"], ["z"]]) == [[["A"], ["B"]], [["C"]]]
    with pytest.raises(ValueError):
        shape_titles(["A"], [["x"], ["y"]])


def test_process(spark):
    got = process(spark, "red fox", "A red fox ran. The sky is blue.", threshold=0.4)
    assert got["pruned_context"] == "A red fox ran. " and got["reranking_score"] == 1.0 and got["title"] is None
    assert "kept_sentences" not in got and "sentence_probabilities" not in got and got["timing"]["total_seconds"] > 0
    told = []
    got = process(spark, ["red fox", "blue sky"], ["A red fox ran.", "The red car."], return_sentence_texts=True, return_sentence_metrics=True, debug_messages=told.append)
    assert got["pruned_context"] == ["A red fox ran.", ""] and got["kept_sentences"] == [["A red fox ran."], []] and got["sentence_probabilities"] == [[1.0], [0.0]] and len(told) == 1
    got = process(spark, "fox", ["No.", "A fox.", ["fox ", "dog"]], title=["T", "", "U"], reorder=True, top_k=2)
    assert len(got["pruned_context"]) == 2 and set(got["title"]) <= {"U\n", None}
    got = process(spark, ["a", "b"], [["a x.", "b"], ["b"]])
    assert got["pruned_context"] == [["a x.", ""], ["b"]]
    assert process(spark, ["a", "b"], [[], ["b"]])["pruned_context"] == [[], ["b"]] and process(spark, "a", [])["pruned_context"] == []
    with pytest.raises(ValueError):
        process(spark, ["a", "b"], ["only one"])
    with pytest.raises(TypeError):
        process(spark, "a", "b", debug_messages=3)


def test_the_plan_stays_in_the_jvm(spark):
    plan = P.prune(table(spark, "x"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_blocks_make_room_for_whole_fragments(spark):
    """Beside a question longer than the window, "widen" scores every character in fragments of half a window; "keep" cuts."""
    text = "the red fox " * 40 + "."
    rows = [(1, 1, "fox " * 100, text), (1, 2, "fox", text), (1, 3, "fox " * 30, "A red fox ran. The sky is blue.")]
    asked = spark.createDataFrame(rows, "query_idx int, context_idx int, query string, context_text string")
    share = lambda how: [r["scored_share"] for r in P.prune(asked, None, window=256, language="en", cut_fragments=how).orderBy("context_idx").collect()]
    assert share("widen") == [1.0, 1.0, 1.0] and share("keep")[0] < 0.1
    got = P.prune(asked, None, window=256, language="en", cut_fragments="widen").where("context_idx = 1").first()
    assert len(got["block_scores"]) == -(-len(text) // 128)  # one fragment a block, as the question alone is over the window


def test_fine_queries_keep_their_fragments(spark):
    """Fragments of 128 characters, not of 1024."""
    from loomspan.plans import q_eval, q_prune

    longest = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("max(length(text))").first()[0]
    assert longest > 1024 and (q_prune.SMALL_WINDOW, q_prune.SMALL_STEP) == (256, 128)
    assert q_eval.fine_pruned(spark, "/root/testdata/sf0.001").where("scored_share < 1").count() == 0
