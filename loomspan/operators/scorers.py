"""Scorers: what gives blocks their ranking scores and fragments their keep probabilities.

A scorer has two functions of columns. rank(query, blocks) returns one score for each block's text, keep(query,
fragments) the mean keep probability of each fragment's tokens; both take and return arrays, so a row's texts
are scored together. The default one is lexical and deterministic. FunctionScorer wraps any model: Python
functions from questions and texts to numbers, called in Arrow batches; a model is loaded once in a worker by
the function itself.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspan.functions import text as T

Numbers = Sequence[float | None]


class Scorer(Protocol):
    def rank(self, query: Column, blocks: Column) -> Column: ...

    def keep(self, query: Column, fragments: Column) -> Column: ...


def overlap(question_terms: Column, text: Column) -> Column:
    """Share of the question's terms in a text, rounded to six places; 0 without terms."""
    n = F.size(question_terms)
    # the intersection is a set: the text's words needn't be made one first
    words = T.extract(F.lower(text), T.TERM)
    return F.when(n > 0, F.round(F.size(F.array_intersect(question_terms, words)) / n, 6)).otherwise(F.lit(0.0))


class LexicalScorer:
    """The share of the question's distinct lower-case words that a text has, for blocks and fragments alike."""

    def rank(self, query: Column, blocks: Column) -> Column:
        return T.let(T.terms(query), lambda terms: F.transform(blocks, lambda b: overlap(terms, b)))

    keep = rank


class FunctionScorer:
    """rank_fn and keep_fn: (questions, texts), two lists of equal length, to a list of as many numbers."""

    def __init__(self, rank_fn: Callable[[list[str], list[str]], Numbers], keep_fn: Callable[[list[str], list[str]], Numbers]):
        self.rank_fn, self.keep_fn = rank_fn, keep_fn

    def rank(self, query: Column, blocks: Column) -> Column:
        return _in_batches(self.rank_fn)(query, blocks)

    def keep(self, query: Column, fragments: Column) -> Column:
        return _in_batches(self.keep_fn)(query, fragments)


def _in_batches(fn: Callable[[list[str], list[str]], Numbers]):
    @F.pandas_udf("array<double>")
    def run(query: pd.Series, texts: pd.Series) -> pd.Series:
        size = [len(t) for t in texts]
        got = list(fn([q for q, n in zip(query, size) for _ in range(n)], [x for t in texts for x in t]))
        if len(got) != sum(size):
            raise ValueError(f"a scorer gave {len(got)} numbers for {sum(size)} texts")
        at, out = 0, []
        for n in size:
            out.append([None if x is None else float(x) for x in got[at : at + n]])
            at += n
        return pd.Series(out, dtype=object)

    return run
