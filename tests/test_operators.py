"""Operators on small hand-made inputs."""

import os
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from loomspan.functions import arrays as A
from loomspan.functions import text as T
from loomspan.operators import datasets as D
from loomspan.operators import evaluate as E


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("text", ["", "a", "a\nb", "a\r\nb\rc\n", "x\x0by\x0cz", "\x1c\x1d\x1e", "a\x85b c d", "\n\n"])
def test_splitlines_as_python(spark, text):
    assert one(spark, text, T.split_lines) == text.splitlines(keepends=True)


@pytest.mark.parametrize("text", ["", "  a ", "\x1fa\x85", " a　", "a b", "\ta\n"])
def test_strip_as_python(spark, text):
    assert one(spark, text, T.strip) == text.strip()


def test_title_and_prefix(spark):
    got = one(spark, "\n  \nTitle \nBody\n", T.first_line_title)
    assert (got["title"], got["rest"]) == ("Title ", "Body\n")
    assert tuple(one(spark, " \n ", T.first_line_title)) == ("", " \n ")
    assert one(spark, [" T ", ""], T.prefix_sentences, "array<string>") == ["T\n"]


def test_spans_round_trip(spark):
    text = "One two. One two. Three"
    df = spark.createDataFrame([(text, ["One two.", "One two.", "absent", "Three"])], "t string, s array<string>")
    spans = df.select(T.text_to_spans(F.col("t"), F.col("s")).alias("p")).first()["p"]
    assert [text[a:b] for a, b in spans] == ["One two.", "One two.", "Three"] and spans[0] != spans[1]


def test_arrays(spark):
    assert one(spark, [0, 2, 0], lambda c: A.norm_relevance(c, F.lit(3)), "array<int>") == [0, 1, 0]
    assert one(spark, [1], lambda c: A.norm_relevance(c, F.lit(3)), "array<int>") == [0, 1, 0]
    assert one(spark, None, lambda c: A.norm_relevance(c, F.lit(2)), "array<int>") == [0, 0]
    assert one(spark, "1, 2 and 99999999999999999999", lambda c: A.parse_indices(c, F.lit(2))) == [0, 1]
    assert one(spark, [1, 2, 3, 2, 3], lambda c: A.find(c, F.array(F.lit(2), F.lit(3))), "array<int>") == 1


def test_sampling(spark):
    df = spark.range(100).withColumnRenamed("id", "doc")
    a = [r["doc"] for r in D.sample_rows(df, 3, 10, "doc").collect()]
    assert len(a) == 10 and sorted(a) == sorted(r["doc"] for r in D.sample_rows(df.repartition(7), 3, 10, "doc").collect())
    assert D.sample_rows(df, 3, 1000, "doc").count() == 100
    with pytest.raises(ValueError):
        D.sample_rows(df, 3, 0, "doc")
    with pytest.raises(ValueError):
        D.upsample(df, 0.5, 1, "doc")
    assert D.upsample(df, 2.5, 1, "doc").count() == 250
    assert D.split_sizes(2) == (0, 0) and D.split_sizes(1000) == (10, 10)


def test_scores_null_on_zero(spark):
    df = spark.createDataFrame([(0, [0, 0], [0, 0]), (1, [1], [1, 1])], "k int, gold array<int>, pred array<int>")
    rows = {r["k"]: r for r in E.scores(E.confusion(df, "k")).collect()}
    assert rows[0]["precision"] is None and rows[0]["accuracy"] == 1.0
    assert rows[1]["span_skipped"] == 1 and rows[1]["accuracy"] is None


def test_without_the_llm_folders(tmp_path):
    """A copy without loomspan/llm, tests/llm and corpus_pipeline.py imports, and lists and runs the other queries."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "repo"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".*"))
    code = """
import sys, __spark_entry__ as e
names = set(e.queries())
assert "prune" in names and "pipeline" not in names and not any(n.startswith("op") and n[2].isdigit() for n in names), names
assert set(e.oracle_sql()) <= names
assert not any(m.startswith("loomspan.llm") for m in sys.modules)
"""
    subprocess.run([sys.executable, "-c", code], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, check=True, timeout=120)
    for p in copy.rglob("*.py"):
        assert "loomspan.llm" not in p.read_text() or p.name in ("__spark_entry__.py", "test_operators.py")
