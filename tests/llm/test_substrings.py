import random

import numpy as np
import pyarrow as pa
import pytest

from loomspan.llm import phrase_dedup, suffix_dedup
from loomspan.llm.suffix_array import permuted_lcp, suffix_array
from loomspan.llm.windows import exact_groups
from tests.llm.helpers import AWKWARD, brute_bytes, brute_words, corpus, documents, grouped


def test_suffix_array_and_prefixes():
    rng = random.Random(0)
    for _ in range(200):
        k, n = rng.choice([1, 2, 3, 26]), rng.randint(0, 300)
        x = [rng.randint(1, k) for _ in range(n)]
        if rng.random() < 0.3:
            x = x[: n // 3] + [1] + x[: n // 3] * 2
        t = np.array([*x, 0])
        sa = suffix_array(t)
        want = sorted(range(len(t)), key=lambda i: t[i:].tolist())
        assert sa.tolist() == want
        phi, plcp = permuted_lcp(t, sa)
        for a, b in zip(want[1:], want):
            m = 0
            while max(a, b) + m < len(t) and t[a + m] == t[b + m]:
                m += 1
            assert phi[a] == b and plcp[a] == m


@pytest.mark.parametrize("hot,array", [(8, 2000), (100_000, 2000), (100_000, 10**6)])
def test_bytes_as_brute_force(spark, hot, array):
    docs = corpus() + AWKWARD
    got = suffix_dedup.removed_digest(documents(spark, docs), 40, gram=12, hot=hot, array=array, bucket_bytes=3000, key_bytes=6000)
    assert grouped(got.collect()) == {k: sorted(v) for k, v in brute_bytes(docs, 40).items()}


def test_bytes_production_window(spark):
    long = "".join(chr(97 + i * i % 23) + str(i) for i in range(100))
    docs = [(1, long + "one"), (2, "two" + long), (3, long[:199]), (4, None), (5, "other")]
    got = suffix_dedup.removed_digest(documents(spark, docs))
    assert grouped(got.collect()) == {k: sorted(v) for k, v in brute_bytes(docs, 200).items()}


def test_texts_left(spark):
    p = "é" * 150
    got = {r["doc_id"]: r["text"] for r in suffix_dedup.without_repeats(documents(spark, [(1, "a" + p + "b"), (2, "c" + p), (3, None)])).collect()}
    assert got == {1: "ab", 2: "c", 3: ""}


@pytest.mark.parametrize("window,gram,size,hot", [(6, 2, 700, 4096), (6, 2, 700, 4), (3, 1, 100_000, 4096), (13, 4, 5000, 2)])
def test_words_as_brute_force(spark, window, gram, size, hot):
    docs = corpus(5) + AWKWARD
    got = phrase_dedup.removed_digest(documents(spark, docs), window, gram=gram, hot=hot, bucket_bytes=size, key_bytes=2000)
    assert grouped(got.collect()) == {k: sorted(v) for k, v in brute_words(docs, window).items()}


def test_equal_hashes_are_compared():
    values = np.array([1, 2, 3, 1, 2, 3, 1, 2, 4, 1, 2, 4, 1, 2])
    start, length = np.array([0, 3, 6, 9, 12]), np.array([3, 3, 3, 3, 2])
    assert exact_groups(np.zeros(5, np.uint64), values, start, length).tolist() == [0, 0, 2, 2, 4]
    assert exact_groups(np.arange(5).astype(np.uint64), values, start, length).tolist() == [0, 1, 2, 3, 4]


def test_words_that_share_a_hash(spark, monkeypatch):
    """With hashes of three bits nearly everything collides; only the words' bytes tell."""
    real = phrase_dedup.Prefix.ranges
    docs = corpus(11)[:80]
    monkeypatch.setattr(phrase_dedup.Prefix, "ranges", lambda self, a, b: real(self, a, b) & np.uint64(7))
    table = pa.table({"doc_id": pa.array([i for i, _ in docs], pa.int64()), "text": pa.array([t for _, t in docs])})
    b = phrase_dedup.Bucket(table, 5, 2)
    words = [bytes(b.data[s:e]) for s, e in zip(b.start, b.end)]
    assert all(words[i] == words[h] and words.index(words[i]) == h for i, h in enumerate(b.word))


def test_empty_tables(spark):
    empty = documents(spark, [(1, "x")]).where("false")
    assert suffix_dedup.removed_digest(empty).count() == 0
    assert phrase_dedup.removed_digest(empty).count() == 0
    assert phrase_dedup.without_phrases(empty).count() == 0


def held_by_hand(texts, ids, window):
    """(candidate, window) -> the least doc_id that holds it, where a larger one does."""
    least = {}
    for (lo, _), t in zip(ids, texts):
        for p in range(len(t) - window + 1):
            k = tuple(t[p : p + window])
            least[k] = min(least.get(k, 1 << 60), lo)
    out = {}
    for c, ((_, hi), t) in enumerate(zip(ids, texts)):
        for p in range(len(t) - window + 1):
            if least[tuple(t[p : p + window])] < hi:
                out[c, p] = least[tuple(t[p : p + window])]
    return out


def hold_cases():
    rng = random.Random(9)
    for _ in range(60):
        base = [rng.choice("abc") for _ in range(40)]
        texts = []
        for _ in range(rng.randint(2, 12)):
            i = rng.randint(0, 30)
            t = base[i : i + rng.randint(4, 20)] + [rng.choice("abcde") for _ in range(rng.randint(0, 6))]
            texts.append(t if len(t) >= 4 else t + ["a"] * 4)
        ids = [tuple(sorted((rng.randint(0, 9), rng.randint(0, 9)))) for _ in texts]
        yield texts, ids, rng.choice([2, 3, 4])


def held(texts, ids, window):
    size = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(w.encode() + b" " for t in texts for w in t), np.uint8)
    which, p, first, last, holder = phrase_dedup.hold(size, np.array(ids, np.int64), data, window)
    by_piece = {}
    for q, a, b, h in zip(p.tolist(), first.tolist(), last.tolist(), holder.tolist()):
        for w in range(a, b + 1):
            by_piece[q, w] = h
    # a distinct candidate's windows are those of each candidate that it stands for, unless none of its ids is larger
    return {(c, w): h for c, q in enumerate(which.tolist()) for (q2, w), h in by_piece.items() if q2 == q and h < ids[c][1]}


@pytest.mark.parametrize("bits", [None, 3, 0])
def test_the_automaton_finds_the_holders(monkeypatch, bits):
    """Also where hashes of a few bits propose passages that are none."""
    if bits is not None:
        real = phrase_dedup.Prefix.ranges
        monkeypatch.setattr(phrase_dedup.Prefix, "ranges", lambda self, a, b: real(self, a, b) & np.uint64((1 << bits) - 1))
    for texts, ids, window in hold_cases():
        assert held(texts, ids, window) == held_by_hand(texts, ids, window)


def test_without_the_automaton_nothing_is_found(monkeypatch):
    none = np.zeros(0, np.int64)
    calls = []

    def blind(code, begin, size, at, words):
        calls.append(len(at))
        if len(calls) > 1:
            raise RuntimeError("windows are left that no pattern met")
        return none, none, words

    monkeypatch.setattr(phrase_dedup, "occurrences", blind)
    texts, ids, window = next(hold_cases())
    with pytest.raises(RuntimeError):
        held(texts, ids, window)


def test_passages_hold_each_window_once():
    rng = random.Random(2)
    for _ in range(50):
        t = [rng.randrange(4) for _ in range(rng.randint(3, 60))]
        at = np.arange(len(t) - 2)
        h = np.array([t[i] * 16 + t[i + 1] * 4 + t[i + 2] for i in at], np.uint64)
        first, n = phrase_dedup.passages(at, np.zeros(len(at), np.int64), h)
        inside = [h[a + k] for a, m in zip(first.tolist(), n.tolist()) for k in range(m)]
        assert sorted(inside) == sorted(set(h.tolist()))
        for a, m in zip(first.tolist(), n.tolist()):  # wherever one of its windows stands, all of them do
            for k in range(m):
                assert all((h[i - k : i - k + m] == h[a : a + m]).all() and i - k >= 0 for i in np.flatnonzero(h == h[a + k]))
