"""Runs of repeated word sequences inside each document, by a suffix tree's leaf lists.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and at least
max(min_words, 2 * q) words that no neighbouring word extends keeping period q. The method is Stoye and
Gusfield's: at an inner node of depth d of the suffix tree, two leaves d apart head a tandem repeat of 2 * d
words, and it is branching (the word behind it breaks the period) if the two leaves part exactly there. Each pair
is met from its leaf outside the node's largest child, so all leaf lists together hold n * log2(n) leaves at
most. A branching repeat is the last one of its run: rotated to the left, word by word, as long as the
period holds, it covers the run, and repeats of several multiples of a period merge into it.

The tree is kept as arrays: suffixes in order, common prefixes of neighbours, nodes as intervals of that order. A
lossless filter keeps it small: a run repeats some min_words / 2 words in a row inside its document, so only
stretches covered by such repeats enter the tree; hashes choose the stretches, the tree compares words.

A null or empty text has no words and no runs; repeated rows and ids are judged row by row; texts are read whole at
any length (memory grows with one text); nothing crosses documents; empty tables stay empty; further columns are
not read. No shuffle: any lost task is simply run again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import give_back

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BATCH_CHARS = 1 << 20
#: Leaves that are looked at together.
LEAVES = 1 << 20


def suffixes(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank) of all suffixes of s, whose last symbol occurs nowhere else: ranks of 1, 2, 4... symbols in turn."""
    n, k = len(s), 1
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    while rank.max() < n - 1:
        key = rank * (n + 1)
        key[:-k] += rank[k:] + 1
        order = np.argsort(key)
        new = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = np.empty(n, np.int64)
        rank[order] = new
        k *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order, rank


def common_prefixes(s: np.ndarray, order: np.ndarray, rank: np.ndarray) -> list[int]:
    """For each place of the order, the length of the prefix shared with the place before (0 for the first)."""
    x, sa, at, n = s.tolist(), order.tolist(), rank.tolist(), len(s)
    out, h = [0] * n, 0
    for i in range(n):
        if at[i] == 0:
            h = 0
            continue
        j = sa[at[i] - 1]
        while x[i + h] == x[j + h]:  # ends at the last symbol, which is unique
            h += 1
        out[at[i]] = h
        h -= h > 0
    return out


def inner_nodes(prefixes: list[int]) -> np.ndarray:
    """The suffix tree's inner nodes below the root, one row each: depth, interval [l, r) of the suffix order, interval of the
    largest child."""
    depth, left, b0, b1, out = [0], [0], [0], [0], []
    for i in range(1, len(prefixes) + 1):
        h = prefixes[i] if i < len(prefixes) else -1
        a, b = i - 1, i
        while depth and depth[-1] > h:
            if b - a > b1[-1] - b0[-1]:
                b0[-1], b1[-1] = a, b
            d, a, b = depth.pop(), left.pop(), i
            x, y = b0.pop(), b1.pop()
            if d:
                out.append((d, a, i, x, y))
        if h < 0:
            break
        if depth[-1] < h:
            depth.append(h), left.append(a), b0.append(a), b1.append(b)
        elif b - a > b1[-1] - b0[-1]:
            b0[-1], b1[-1] = a, b
    return np.array(out, np.int64).reshape(-1, 5)


def spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[k], first[k] + 1, ... for size[k] numbers, one after another."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + size, size)


def branching_repeats(s: np.ndarray, order: np.ndarray, rank: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of all branching tandem repeats."""
    found = []
    size = (nodes[:, 3] - nodes[:, 1]) + (nodes[:, 2] - nodes[:, 4])
    cuts = np.flatnonzero(np.diff(np.concatenate([[-1], np.cumsum(size) // LEAVES])))
    for lo, hi in zip(cuts, [*cuts[1:], len(nodes)]):
        part = nodes[lo:hi]
        d, l, r, b0, b1 = part.T
        of = np.concatenate([np.repeat(np.arange(len(part)), b0 - l), np.repeat(np.arange(len(part)), r - b1)])
        leaf = order[np.concatenate([spans(l, b0 - l), spans(b1, r - b1)])]
        gap = d[of]
        for other, first in ((leaf + gap, leaf), (leaf - gap, leaf - gap)):
            ok = (other >= 0) & (other < len(s))
            ok[ok] = (rank[other[ok]] >= l[of[ok]]) & (rank[other[ok]] < r[of[ok]])
            i, g = first[ok], gap[ok]
            parts = s[i + g] != s[i + 2 * g]
            found.append(np.stack([i[parts], g[parts]]))
    i, g = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), np.int64)
    return i, g


def rotate_left(s: np.ndarray, i: int, gap: int) -> int:
    """Where the stretch with that period which holds s[i : i + 2 * gap] begins."""
    step = 64
    while i > 0:
        a = max(0, i - step)
        differ = np.flatnonzero(s[a:i] != s[a + gap : i + gap])
        if len(differ):
            return a + int(differ[-1]) + 1
        i, step = a, step * 2
    return 0


def runs_of(s: np.ndarray, min_words: int) -> np.ndarray:
    """(start, end, period) of all runs of s, whose last symbol occurs nowhere else."""
    order, rank = suffixes(s)
    i, gap = branching_repeats(s, order, rank, inner_nodes(common_prefixes(s, order, rank)))
    end, start, live = i + 2 * gap, i.copy(), np.arange(len(i))
    for _ in range(max(16, min_words)):  # most repeats end at once
        live = live[start[live] > 0]
        live = live[s[start[live] - 1] == s[start[live] - 1 + gap[live]]]
        start[live] -= 1
    known: dict[int, list[tuple[int, int]]] = {}
    for k in live[np.lexsort((gap[live], end[live]))].tolist():
        e, g = int(end[k]), int(gap[k])
        same = next((a for a, q in known.get(e, ()) if g % q == 0 and e - 2 * g >= a), None)
        if same is None:
            same = rotate_left(s, int(start[k]), g)
            known.setdefault(e, []).append((same, g))
        start[k] = same
    whole = end - start >= np.maximum(min_words, 2 * gap)
    start, end, gap = start[whole], end[whole], gap[whole]
    by = np.lexsort((gap, end, start))
    start, end, gap = start[by], end[by], gap[by]
    first = np.ones(len(start), bool)  # of one stretch, the smallest period
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return np.stack([start, end, gap], 1)[first]


def repeated_stretches(hashes: np.ndarray, doc: np.ndarray, gram: int) -> np.ndarray:
    """True for words covered by `gram` words in a row that occur twice in their document (or seem to, by their hashes)."""
    covered = np.zeros(len(hashes), bool)
    n = len(hashes) - gram + 1
    if n < 2:
        return covered
    h = doc[:n].astype(np.uint64)
    for k in range(gram):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + hashes[k : n + k].astype(np.uint64)
    at = np.flatnonzero(doc[:n] == doc[gram - 1 :])
    by = at[np.argsort(h[at])]
    equal = h[by[1:]] == h[by[:-1]]
    twice = np.zeros(n, bool)
    twice[by[1:][equal]] = twice[by[:-1][equal]] = True
    edge = np.zeros(len(hashes) + 1, np.int64)
    edge[:n] += twice
    edge[gram : gram + n] -= twice
    return np.cumsum(edge)[:-1] > 0


def find(texts: list[list[str]], min_words: int) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each list of words, by start, then period."""
    size = np.array([len(w) for w in texts], np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    words = list(chain.from_iterable(texts))
    doc = np.repeat(np.arange(len(texts)), size)
    covered = repeated_stretches(np.fromiter(map(hash, words), np.int64, len(words)), doc, -(-min_words // 2))
    if not covered.any():
        return out
    # stretches of one document, one after another, an own symbol behind each
    at = np.flatnonzero(covered)
    inside = [words[k] for k in at.tolist()]
    vocabulary = {w: k for k, w in enumerate(dict.fromkeys(inside))}
    fresh = np.concatenate([[True], (np.diff(at) > 1) | (np.diff(doc[at]) > 0)])
    stretch = np.cumsum(fresh) - 1
    place = np.arange(len(at)) + stretch
    s = np.empty(len(at) + stretch[-1] + 1, np.int64)
    ends = np.append(np.flatnonzero(fresh)[1:], len(at)) + np.arange(stretch[-1] + 1)
    s[place] = [vocabulary[w] for w in inside]
    s[ends] = len(vocabulary) + np.arange(len(ends))
    origin = np.empty(len(s), np.int64)
    origin[place] = at
    begins = np.cumsum(size) - size
    for start, end, gap in runs_of(s, min_words).tolist():
        first = int(origin[start])
        k = int(doc[first])
        out[k].append((first - int(begins[k]), end - start, gap))
    for found in out:
        found.sort(key=lambda r: (r[0], r[2]))
    return out


def collapse(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words, single blanks between them, without those that lie in a run behind its first period."""
    if not runs:
        return " ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    gone = np.cumsum(edge)[:-1] > 0
    return " ".join(w for w, x in zip(words, gone.tolist()) if not x)


def groups(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Consecutive rows of about BATCH_CHARS characters together."""
    first, chars = 0, 0
    for k, t in enumerate(texts):
        chars += len(t or "")
        if chars >= BATCH_CHARS:
            yield first, k + 1
            first, chars = k + 1, 0
    if first < len(texts):
        yield first, len(texts)


def find_runs(docs: DataFrame, min_words: int = 12) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period: by start, then period) and collapsed (the text's words without
    those that any run holds behind its first period), one row for each row of docs."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in groups(texts):
                words = [WORD.findall(t) if t else [] for t in texts[i:j]]
                runs = find(words, min_words)
                yield pa.RecordBatch.from_arrays([
                    b.column(0)[i:j],
                    pa.array([len(w) for w in words], pa.int64()),
                    pa.array([[{"start": a, "length": n, "period": q} for a, n, q in r] for r in runs], kind),
                    pa.array([collapse(w, r) for w, r in zip(words, runs)]),
                ], ["doc_id", "n_words", "runs", "collapsed"])
        give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def longest(runs: Column) -> Column:
    """Of an array of runs, that of greatest length (ties: smallest start, then period) as struct start, length, period; null for
    none."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    return F.when(best.isNotNull(), F.struct((-best["s"]).alias("start"), best["n"].alias("length"), (-best["p"]).alias("period")))
