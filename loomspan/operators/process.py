"""The pruning call for Python values: questions and contexts in lists, results in lists of the same shape.

The inputs, which a caller holds in memory, become a DataFrame; prune() works on it; the rows come back to the
caller. For tables use prune() itself, which returns a DataFrame.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loomspan.operators.prune import FIRST_SENTENCE, prune
from loomspan.operators.trace import Trace

LOGGER = logging.getLogger("loomspan")
#: Results by name and column.
RESULTS = {"pruned_context": "pruned_context", "reranking_score": "reranking_score", "compression_rate": "compression_rate", "title": "title"}


def _many(x: Any) -> bool:
    return isinstance(x, Sequence) and not isinstance(x, (str, bytes, bytearray))


def shape_inputs(question: str | Sequence[str], context: Any) -> tuple[list[str], list[list[Any]], str]:
    """(questions, for each its contexts, how the input was shaped). A context is a text or a list of sentences.

    One question takes one text ("str") or a list of contexts ("list"); several take as many texts ("aligned") or as many
    lists of contexts ("nested"). Anything else is an error.
    """
    queries = [question] if isinstance(question, str) else [str(q) for q in question]
    one = lambda x: [str(y) for y in x] if _many(x) else str(x)
    if isinstance(context, str):
        if len(queries) != 1:
            raise ValueError("one context needs one question")
        return queries, [[context]], "str"
    if not _many(context):
        raise ValueError("contexts are a text or a list")
    if len(queries) == 1:
        return queries, [[one(x) for x in context]], "list"
    if len(context) != len(queries):
        raise ValueError("there must be as many contexts as questions")
    if not any(_many(x) for x in context):
        return queries, [[str(x)] for x in context], "aligned"
    if not all(_many(x) for x in context):
        raise ValueError("either all questions have lists of contexts or none")
    return queries, [[one(y) for y in x] for x in context], "nested"


def shape_titles(title: Any, contexts: list[list[Any]]) -> list[list[list[str]]] | str | None:
    """The titles of each context of each question; the default and None as they are."""
    if title is None or title == FIRST_SENTENCE:
        return title
    if isinstance(title, str):
        return [[[title] for _ in own] for own in contexts]
    if not _many(title):
        raise ValueError("titles are a text or a list")
    words = lambda x: [str(y) for y in x] if _many(x) else [str(x)]
    at = lambda own, k: words(own[k]) if k < len(own) else []
    if len(contexts) == 1 and not any(_many(x) for x in title):
        return [[at(title, k) for k in range(len(contexts[0]))]]
    if len(title) == len(contexts) and all(_many(x) for x in title):
        return [[at(own, k) for k in range(len(mine))] for own, mine in zip(title, contexts)]
    if len(title) == len(contexts) and not any(_many(x) for x in title):
        return [[[str(x)] for _ in mine] for x, mine in zip(title, contexts)]
    raise ValueError("titles fit neither the questions nor the contexts")


def process(
    spark: SparkSession,
    question: str | Sequence[str],
    context: Any,
    title: Any = FIRST_SENTENCE,
    first_line_as_title: bool = False,
    *,
    return_sentence_metrics: bool = False,
    return_sentence_texts: bool = False,
    debug_messages: bool | Callable[[str], None] = False,
    **options: Any,
) -> dict[str, Any]:
    """pruned_context, reranking_score, compression_rate, title, timing (the driver's wall clock) and performance_trace (task
    seconds by stage, and counts, measured in the job), and on demand sentence_probabilities,
    kept_sentences and removed_sentences, each shaped like the contexts. options: those of prune()."""
    if not isinstance(debug_messages, bool) and not callable(debug_messages):
        raise TypeError("debug_messages is a bool or a function of a text")
    tell = debug_messages if callable(debug_messages) else LOGGER.info if debug_messages else (lambda _: None)
    began = time.perf_counter()
    queries, contexts, shape = shape_inputs(question, context)
    if first_line_as_title and title not in (None, FIRST_SENTENCE):
        raise ValueError("first_line_as_title cannot be combined with a title")
    titles = shape_titles(title, contexts)
    rows = []
    for i, (q, own) in enumerate(zip(queries, contexts)):
        for k, c in enumerate(own):
            rows.append((i, k, q, None if _many(c) else c, list(c) if _many(c) else None, titles[i][k] if isinstance(titles, list) else None))
    table = spark.createDataFrame(rows, "query_idx int, context_idx int, query string, context_text string, manual_sentences array<string>, given_titles array<string>")
    trace = Trace()
    done = prune(table, F.col("given_titles") if isinstance(titles, list) else title, first_line_as_title, trace=trace, **options)
    results = dict(RESULTS)
    if return_sentence_metrics:
        results["sentence_probabilities"] = "sentence_probabilities"
    if return_sentence_texts:
        results |= {"kept_sentences": "kept_sentences", "removed_sentences": "removed_sentences"}
    order = ["query_idx", "rank" if "rank" in done.columns else "context_idx"]
    prepared = time.perf_counter()
    got: list[list[Any]] = [[] for _ in queries]
    # sorted here, as a range sort would run the stages twice
    for r in sorted(done.select(*order, *results.values()).collect(), key=lambda r: tuple(r[c] for c in order)):
        got[r["query_idx"]].append(r)
    out: dict[str, Any] = {}
    for name, column in results.items():
        value = lambda r, column=column: _title(r[column]) if column == "title" else r[column]
        by_query = [[value(r) for r in own] for own in got]
        empty = {"pruned_context": "", "compression_rate": 0.0, "kept_sentences": [], "removed_sentences": [], "sentence_probabilities": []}.get(name)
        first = [own[0] if own else empty for own in by_query]
        out[name] = {"str": first[0] if first else empty, "list": by_query[0] if by_query else [], "aligned": first, "nested": by_query}[shape]
    total = time.perf_counter() - began
    out["timing"] = {"preprocess_seconds": prepared - began, "inference_seconds": total - (prepared - began), "total_seconds": total}
    out["performance_trace"] = {**trace.seconds(), **trace.counts()}
    tell(f"pruned {len(rows)} contexts of {len(queries)} questions in {total:.2f} s")
    return out


def _title(prefix: list[str] | None) -> Any:
    return None if not prefix else prefix[0] if len(prefix) == 1 else list(prefix)


#: One input of each shape: a text, a list, texts side by side, lists of texts, and texts split already.
SHAPES: dict[str, tuple[Any, Any]] = {
    "str": ("red fox", "A red fox ran. The sky is blue."),
    "list": ("red fox", ["A red fox ran.", "The sky is blue."]),
    "aligned": (["red fox", "sky"], ["A red fox ran.", "The sky is blue."]),
    "nested": (["red fox", "sky"], [["A red fox ran.", "Blue."], ["The sky is blue."]]),
    "split": ("red fox", [["A red fox ran.", "The sky is blue."]]),
}


def shape_check(spark: SparkSession, run: Callable[..., dict[str, Any]] = process, **options: Any) -> list[dict[str, Any]]:
    """What a pruning call returns for each shape of input: case, ok, and the shapes of its results (list lengths, or the kind of a
    single value), or the error. A smoke check for a scorer or a splitter before it meets a table."""
    def shape(x: Any) -> Any:
        return [shape(y) for y in x] if isinstance(x, list) else type(x).__name__

    def like(given: Any, got: Any, level: int) -> bool:
        return not isinstance(got, list) if level == 0 else isinstance(got, list) and len(got) == len(given) and all(like(g, x, level - 1) for g, x in zip(given, got))

    out = []
    for case, (question, context) in SHAPES.items():
        try:
            got = run(spark, question, context, **options)
            level = {"str": 0, "nested": 2}.get(case, 1)
            texts, scores = got["pruned_context"], got["reranking_score"]
            out.append({"case": case, "ok": like(context, texts, level) and like(context, scores, level), "pruned_context": shape(texts), "reranking_score": shape(scores), "error": None})
        except Exception as e:  # noqa: BLE001 - the check tells of any error
            out.append({"case": case, "ok": False, "pruned_context": None, "reranking_score": None, "error": f"{type(e).__name__}: {e}"})
    return out
