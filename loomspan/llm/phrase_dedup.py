"""Removal of repeated phrases: words covered by a window of `window` words that an earlier document holds too.

1. Confirm. Each window has a minimizer among its `gram`-word phrases, a function of its words alone. Buckets
   of documents send their distinct minimizers to key buckets; those that occur in one document only can't lie
   in a recurring window. The runs of windows around the other ones are the candidate passages.
2. Compile. Buckets send each distinct candidate, its words and the least and largest doc_id that hold it, to
   the minimizer's shard. A shard codes the words, compared byte by byte, as characters. The windows that several
   documents seem to hold make up passages, windows none of which occurs without the others, and these are
   compiled into the shard's Aho-Corasick automaton.
3. Stream. Every candidate of every document that reached the shard runs through the automaton. Its
   occurrences alone say where a passage stands, hence the least doc_id that holds its windows; each bucket gets
   back the windows of its candidates with that holder, and removes the words of those whose holder has a smaller id.
   Other words of a document hold no minimizer that recurs, so no passage can begin among them.

A document meets exactly the shards of its minimizers, so streaming costs no more than the text that recurs.
A minimizer with more than `hot` candidates would gather one shard's load: its windows go one by one to shards
by their own hash; they are coded, compiled and streamed like any candidate.

Hashes only deal and pre-sort; whether words are equal is decided by the words. Words are
`[^\\x20\\x09-\\x0D]+`, unchanged; null texts have none, an empty table stays empty. Rows with equal doc_ids
don't remove from each other; a null doc_id counts as larger than all others. Windows are judged on the input.
A bucket is one task, so a single text of hundreds of megabytes needs that many times a hundred bytes a word.
"""

from __future__ import annotations

import hashlib
from array import array
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomspan.llm.common import byte_buckets, give_back, text_bytes
from loomspan.llm.windows import (
    BYTE_BASE,
    PACKED,
    WORD_BASE,
    Prefix,
    bucketed,
    deal,
    exact_groups,
    group_runs,
    in_order,
    member,
    pack_table,
    runs,
    spread,
    unpack,
)

GRAM = 4
BUCKET_BYTES = 4 << 20
KEY_BYTES = 6 << 20
HOT = 4096
NO_ID = np.iinfo(np.int64).max
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
#: Kinds of candidates: a run of windows, or one window of a hot minimizer.
RUN, ONE = 0, 1


class Bucket:
    """The words of one document bucket: their bytes and hashes, owners' ids, and runs of windows with their minimizers."""

    def __init__(self, group: pa.Table, window: int, gram: int):
        group = in_order(group)
        self.window, self.doc_id = window, group["doc_id"]
        self.ids = self.doc_id.fill_null(int(NO_ID)).to_numpy().astype(np.int64)
        data, off = text_bytes(group["text"])
        edge = np.zeros(len(data) + 1, bool)
        edge[off] = True
        black = ~SPACE[data]
        start = np.flatnonzero(black & (edge[:-1] | np.concatenate([[True], ~black[:-1]]))) if len(data) else np.zeros(0, np.int64)
        end = np.flatnonzero(black & (edge[1:] | np.concatenate([~black[1:], [True]]))) + 1 if len(data) else start
        self.data, self.start, self.end = data, start, end
        self.hash = Prefix(data, BYTE_BASE).ranges(start, end)
        self.bound = np.searchsorted(start, off)  # words of document i: bound[i] .. bound[i + 1]
        count = np.diff(self.bound)
        self.doc = np.repeat(self.ids, count)
        self.prefix = Prefix(self.hash, WORD_BASE)
        self.first, self.last, self.key, _ = runs(self.prefix.grams(gram), window - gram + 1, window, np.repeat(self.bound[1:], count))

    @cached_property
    def word(self) -> np.ndarray:
        """For each word the first one with the same bytes."""
        return exact_groups(self.hash, self.data, self.start, self.end - self.start)

    def alike(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """For each stretch of n words from `at` on the first one with the same words."""
        return exact_groups(self.prefix.ranges(at, at + n), self.word, at, n)

    def run_words(self, pick: np.ndarray) -> np.ndarray:
        return self.last[pick] - self.first[pick] + self.window

    def text(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The words of the stretches, one blank behind each."""
        w = spread(at, n)
        size = self.end[w] - self.start[w] + 1
        out = np.full(int(size.sum()), 32, np.uint8)
        to = np.cumsum(size) - size
        out[spread(to, size - 1)] = self.data[spread(self.start[w], size - 1)]
        return out

    def entries(self, kind: int, at: np.ndarray, n: np.ndarray, key: np.ndarray, n_keys: int, db: int) -> list[tuple]:
        """Packed rows that send each distinct stretch, with the least and the largest doc_id that hold it, to its shard."""
        head = self.alike(at, n)
        order = np.lexsort((self.doc[at], head))
        begin, many = group_runs(head[order])
        one = head[order][begin]
        least, most = self.doc[at][order][begin], self.doc[at][order][begin + many - 1]
        by, got, bound = deal(key[one], n_keys)
        one, least, most = one[by], least[by], most[by]
        out = []
        for k, s, e in zip(got, bound, bound[1:]):
            x = one[s:e]
            shape = np.stack([np.full(e - s, kind), at[x], n[x]], 1).astype(np.int32)
            out.append((int(k), db, 2, shape, np.stack([least[s:e], most[s:e]], 1), self.text(at[x], n[x])))
        return out


def passages(at: np.ndarray, piece: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first window, windows) of the passages that the windows at `at` make up, in their pieces, by hashes h.

    A window and the next one belong to one passage if neither occurs without the other: in every place the one is followed
    by the other, and the other follows the one. So each distinct window is in one passage, which occurs wherever the window
    does. First occurrences of a passage's windows lie one behind the other.
    """
    _, first, name = np.unique(h, return_index=True, return_inverse=True)
    beside = (np.diff(at) == 1) & (np.diff(piece) == 0)
    after = np.where(np.append(beside, False), np.append(name[1:], -1), -1)
    front = np.where(np.concatenate([[False], beside]), np.concatenate([[-1], name[:-1]]), -1)
    low, high = (np.full((2, len(first)), x) for x in (len(first), -2))
    for i, other in enumerate((after, front)):
        np.minimum.at(low[i], name, other)
        np.maximum.at(high[i], name, other)
    only = np.where((low == high) & (low >= 0), low, -1)  # the one name behind, the one in front
    first.sort()
    one = name[first]
    joined = np.concatenate([[False], (np.diff(first) == 1) & (only[0][one[:-1]] == one[1:]) & (only[1][one[1:]] == one[:-1])])
    new = np.flatnonzero(~joined)
    return at[first[new]], np.diff(np.append(new, len(first)))


def occurrences(code: np.ndarray, begin: np.ndarray, size: np.ndarray, at: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All occurrences in the pieces of the stretches of `words` words from `at` on, found by an automaton compiled from them:
    (first word of an occurrence, number of its pattern, words of each pattern). Words are one or two characters each; two
    alphabets that differ by place keep matches on words' starts."""
    import ahocorasick

    top = int(code.max()) + 2
    if top < 0x10F000:
        cols = [code + 1]
    else:
        cols = [(code >> 10) + 0x10000, code % 1024 + 1]
    width = len(cols)
    # one character 0 behind each piece keeps matches inside
    place = np.arange(len(code)) * width + np.repeat(np.arange(len(size)), size)
    flat = np.zeros(len(code) * width + len(size), np.uint32)
    for i, c in enumerate(cols):
        flat[place + i] = np.where(c < 0xD800, c, c + 0x800)
    text = flat.astype("<u4").tobytes().decode("utf-32-le")
    patterns = dict.fromkeys(text[i:j] for i, j in zip(place[at].tolist(), (place[at] + words * width).tolist()))
    auto = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for k, p in enumerate(patterns):
        auto.add_word(p, k)
    auto.make_automaton()
    length = np.fromiter(map(len, patterns), np.int64, len(patterns))
    ends, which = array("q"), array("q")
    for end, k in auto.iter(text):
        ends.append(end)
        which.append(k)
    which = np.frombuffer(which, np.int64)
    return np.searchsorted(place, np.frombuffer(ends, np.int64) + 1 - length[which]), which, length // width


def hold(size: np.ndarray, ids: np.ndarray, data: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """For the candidates of a shard (words of each, least and largest doc_id, text): which of the distinct ones each is, and
    the stretches of windows that recur and have one least holder: (distinct candidate, first window, last, holder)."""
    end = np.flatnonzero(data == 32)
    start = np.concatenate([[0], end[:-1] + 1])
    word = exact_groups(Prefix(data, BYTE_BASE).ranges(start, end), data, start, end - start)
    code = (np.cumsum(word == np.arange(len(word))) - 1)[word]
    begin = np.cumsum(size) - size
    one, which_one = np.unique(exact_groups(Prefix(code, WORD_BASE).ranges(begin, begin + size), code, begin, size), return_inverse=True)
    least, most = np.full(len(one), NO_ID), np.full(len(one), np.iinfo(np.int64).min)
    np.minimum.at(least, which_one, ids[:, 0])
    np.maximum.at(most, which_one, ids[:, 1])
    code, size = code[spread(begin[one], size[one])], size[one]
    begin = np.cumsum(size) - size
    # windows that several documents seem to hold: the longest stretches of them are the passages
    at = spread(begin, size - window + 1)
    piece = np.repeat(np.arange(len(size)), size - window + 1)
    h = Prefix(code, WORD_BASE).ranges(at, at + window)
    order = np.argsort(h, kind="stable")
    first, many = group_runs(h[order])
    p = piece[order]
    several = np.empty(len(at), bool)
    several[order] = np.repeat(np.minimum.reduceat(least[p], first) < np.maximum.reduceat(most[p], first), many)
    at, piece, h = at[several], piece[several], h[several]
    if not len(at):
        return which_one, at, at, at, at
    # the automaton alone tells where windows are the same: its patterns are the passages, and the least id of the candidates
    # in which it finds one holds all of its windows. Hashes only proposed the passages; windows that none of them met, as
    # others have their hash, are patterns of their own
    holder = np.full(len(code), NO_ID)
    seen = np.zeros(len(code), bool)
    first, windows = passages(at, piece, h)
    while len(first):
        found, which, words = occurrences(code, begin, size, first, windows + window - 1)
        earliest = np.full(len(words), NO_ID)
        np.minimum.at(earliest, which, least[np.searchsorted(begin, found, side="right") - 1])
        n = words[which] - window + 1
        where = spread(found, n)
        np.minimum.at(holder, where, np.repeat(earliest[which], n))
        seen[where] = True
        first = at[~seen[at]]
        windows = np.ones(len(first), np.int64)
    # stretches of windows with one holder, where a larger id holds them
    piece = np.repeat(np.arange(len(size)), size)
    at = np.flatnonzero(holder < most[piece])
    new = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(piece[at]) != 0) | (np.diff(holder[at]) != 0)])) if len(at) else at
    first, last = at[new], at[np.append(new[1:], len(at)) - 1] if len(at) else at
    p = piece[first]
    return which_one, p, first - begin[p], last - begin[p], holder[first]


def covered(b: Bucket, verdict: pa.Table) -> np.ndarray:
    """True at each word that a window with an earlier holder covers."""
    mark = np.zeros(len(b.doc) + 1, np.int64)
    _, (told, holder) = unpack(verdict, 3, (np.int32, np.int64))
    told = told.reshape(-1, 4).astype(np.int64)  # kind, first word of the candidate, first and last window
    for kind in (RUN, ONE):
        pick = told[:, 0] == kind
        t, held = told[pick], holder[pick]
        if not len(t):
            continue
        if kind == RUN:
            at, n = b.first, b.run_words(np.arange(len(b.first)))
        else:  # windows of the minimizers that the told ones have
            own = np.unique(b.key[np.searchsorted(b.first, t[:, 1], side="right") - 1])
            some = np.flatnonzero(member(b.key, own)[0])
            at = spread(b.first[some], b.last[some] - b.first[some] + 1)
            n = np.full(len(at), b.window)
        head = at[b.alike(at, n)]
        by = np.argsort(t[:, 1], kind="stable")
        t, held = t[by], held[by]
        lo, hi = np.searchsorted(t[:, 1], head, "left"), np.searchsorted(t[:, 1], head, "right")
        mine, which = np.repeat(at, hi - lo), spread(lo, hi - lo)
        ok = held[which] < b.doc[mine]
        mine, which = mine[ok], which[ok]
        mark += np.bincount(mine + t[which, 2], minlength=len(mark))
        mark -= np.bincount(mine + t[which, 3] + b.window, minlength=len(mark))
    return np.cumsum(mark[:-1]) > 0


def remove_phrases(docs: DataFrame, finish, schema: str, window: int = 13, gram: int = GRAM, hot: int = HOT, bucket_bytes: int = BUCKET_BYTES, key_bytes: int = KEY_BYTES) -> DataFrame:
    """finish(bucket, covered) -> pa.Table of `schema`, called for each bucket of documents."""
    n_docs = byte_buckets(docs, "text", bucket_bytes)
    n_keys = max(1, -(-n_docs * bucket_bytes // key_bytes))
    texts = bucketed(docs, n_docs)

    def send_keys(key, group):
        b = Bucket(group, window, gram)
        order = np.lexsort((b.doc[b.first], b.key))
        start, size = group_runs(b.key[order])
        doc = b.doc[b.first][order]
        several = doc[start] != doc[start + size - 1]
        keys = b.key[order][start]
        order, got, bound = deal(keys, n_keys)
        # how many runs, and whether of several documents
        count = (np.minimum(size, 32767) * 2 + several).astype(np.uint16)[order]
        keys = keys[order]
        return pack_table([(int(k), key[0].as_py(), 0, keys[s:e], count[s:e]) for k, s, e in zip(got, bound, bound[1:])])

    def count_keys(key, group):
        db, (keys, count) = unpack(group, 0, (np.uint64, np.uint16))
        order = np.argsort(keys, kind="stable")
        start, size = group_runs(keys[order])
        if not len(start):
            return pack_table([])
        total = np.add.reduceat(count[order].astype(np.int64) >> 1, start)
        again = np.repeat((size > 1) | (count[order][start] & 1 == 1), size)
        much = np.repeat(total > hot, size)[again].astype(np.uint8)
        keys, db = keys[order][again], db[order][again]
        order = np.argsort(db, kind="stable")
        return pack_table([(0, int(db[order[a]]), 1, keys[order[a : a + m]], much[order[a : a + m]]) for a, m in zip(*group_runs(db[order]))])

    recurring = texts.groupBy("db").applyInArrow(send_keys, PACKED).groupBy("kb").applyInArrow(count_keys, PACKED)

    def send_candidates(key, group, verdict):
        if not group.num_rows or not verdict.num_rows:
            return pack_table([])
        b, db = Bucket(group, window, gram), key[0].as_py()
        _, (known, much) = unpack(verdict, 1, (np.uint64, np.uint8))
        order = np.argsort(known)
        found, at = member(b.key, known[order])
        single = found & (much[order][at] == 1)
        pick, hot_runs = np.flatnonzero(found & ~single), np.flatnonzero(single)
        out = b.entries(RUN, b.first[pick], b.run_words(pick), b.key[pick], n_keys, db) if len(pick) else []
        if len(hot_runs):
            at = spread(b.first[hot_runs], b.last[hot_runs] - b.first[hot_runs] + 1)
            out += b.entries(ONE, at, np.full(len(at), window), b.prefix.ranges(at, at + window), n_keys, db)
        return pack_table(out)

    def stream(key, group):
        db, (shape, ids, data) = unpack(group, 2, (np.int32, np.int64, np.uint8))
        if not len(shape):
            return pack_table([])
        shape, ids, db = shape.reshape(-1, 3), ids.reshape(-1, 2), db[::3]
        which, p, first, last, holder = hold(shape[:, 2].astype(np.int64), ids, data, window)
        out = []
        if len(p):
            # to every bucket that sent the candidate and holds a larger id
            by = np.argsort(which, kind="stable")
            start, n = group_runs(which[by])
            src, at = by[spread(start[p], n[p])], np.repeat(np.arange(len(p)), n[p])
            later = holder[at] < ids[src, 1]
            src, at = src[later], at[later]
            told = np.stack([shape[src, 0], shape[src, 1], first[at], last[at]], 1).astype(np.int32)
            order = np.argsort(db[src], kind="stable")
            out = [(0, int(db[src][order[a]]), 3, told[order[a : a + m]], holder[at][order[a : a + m]]) for a, m in zip(*group_runs(db[src][order]))]
        give_back()
        return pack_table(out)

    told = texts.groupBy("db").cogroup(recurring.groupBy("db")).applyInArrow(send_candidates, PACKED).groupBy("kb").applyInArrow(stream, PACKED)

    def run(key, group, verdict):
        b = Bucket(group, window, gram)
        return finish(b, covered(b, verdict))

    return texts.groupBy("db").cogroup(told.groupBy("db")).applyInArrow(run, schema)


def kept_words(b: Bucket, removed: np.ndarray) -> list[bytes]:
    """The words that are left of each document, joined by one blank."""
    data = b.data.tobytes()
    start, end, keep = b.start.tolist(), b.end.tolist(), (~removed).tolist()
    return [b" ".join([data[start[i] : end[i]] for i in range(s, e) if keep[i]]) for s, e in zip(b.bound[:-1].tolist(), b.bound[1:].tolist())]


def digest(b: Bucket, removed: np.ndarray) -> pa.Table:
    count = np.diff(b.bound)
    total = np.concatenate([[0], np.cumsum(removed)])
    return pa.table(
        {
            "doc_id": b.doc_id,
            "n_words": pa.array(count.astype(np.int64)),
            "n_removed": pa.array((total[b.bound[1:]] - total[b.bound[:-1]]).astype(np.int64)),
            "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept_words(b, removed)], pa.string()),
        }
    )


def removed_digest(docs: DataFrame, window: int = 13, **sizes) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row."""
    return remove_phrases(docs, digest, "doc_id long, n_words long, n_removed long, kept_sha256 string", window, **sizes)


def without_phrases(docs: DataFrame, window: int = 13, **sizes) -> DataFrame:
    """doc_id and the words that are left, joined by one blank, for each row."""

    def texts(b, removed):
        return pa.table({"doc_id": b.doc_id, "text": pa.array([x.decode() for x in kept_words(b, removed)], pa.string())})

    return remove_phrases(docs, texts, "doc_id long, text string", window, **sizes)
