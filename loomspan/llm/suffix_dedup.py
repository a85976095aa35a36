"""Substring removal with suffix arrays: bytes covered by a string of `window` bytes that starts twice.

1. Lossless candidate search. Each window has a minimizer, the least hash of its `gram`-byte substrings,
   which depends on its content alone; equal windows have equal minimizers. Buckets of documents send each
   distinct minimizer with its count to key buckets; those that occur once in the corpus can't lie in a
   repeated window and drop out.
2. Buckets send the text of each run of windows that share a repeated minimizer, equal runs once with a
   count, to the minimizer's shard. A shard joins its runs into arrays of bounded size (a minimizer is
   never split), sorts their suffixes by induced sorting and computes permuted common prefixes: a window
   is repeated if it shares `window` bytes with its neighbour in the array or its run, byte by byte, occurs
   twice. Minimizers that occur more than `hot` times, such as a line that a third of all documents share,
   would gather unbounded runs in one task; their windows travel as 128-bit hashes, pre-aggregated in each
   bucket, and are counted. That is the one place where no bytes are compared: at 10^14 windows two
   different ones share such a hash with a probability of about 10^-11.
3. Each bucket gets back which window starts of its runs are repeated, and removes the covered bytes.

Texts are UTF-8 bytes, null is empty, matches never cross documents, overlaps count, strings are judged on
the input. Rows with equal doc_id, or without one, are separate documents; an empty table stays empty. The
text is shuffled once, and that exchange serves all three steps. A bucket is one task, so a single text of
hundreds of megabytes needs that many times fifty bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from loomspan.llm.common import byte_buckets, give_back, text_bytes
from loomspan.llm.suffix_array import permuted_lcp, suffix_array
from loomspan.llm.windows import (
    BYTE_BASE,
    PACKED,
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

GRAM = 50
BUCKET_BYTES = 2 << 20
KEY_BYTES = 10 << 20
#: Symbols of one suffix array.
ARRAY = 1_000_000
HOT = 4096


OTHER_BASE = 0xA24BAED4963EE407


class Bucket:
    """The texts of one document bucket, in an order of their own, and their runs of windows."""

    def __init__(self, group: pa.Table, window: int, gram: int):
        self.rows, self.window = in_order(group), window
        self.data, self.off = text_bytes(self.rows["text"])
        self.prefix = Prefix(self.data, BYTE_BASE)
        size = np.diff(self.off)
        self.first, self.last, self.key, self.place = runs(self.prefix.grams(gram), window - gram + 1, window, np.repeat(self.off[1:], size))

    def alike(self, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For these runs (the first of them with the same bytes, a hash of the bytes)."""
        content = self.prefix.ranges(self.first[pick], self.last[pick] + self.window)
        return exact_groups(content, self.data, self.first[pick], self.last[pick] - self.first[pick] + self.window), content

    def window_hashes(self, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, two hashes) of all windows of these runs."""
        starts = spread(self.first[pick], self.last[pick] - self.first[pick] + 1)
        return starts, self.prefix.ranges(starts, starts + self.window), Prefix(self.data, OTHER_BASE).ranges(starts, starts + self.window)


def twin_groups(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, starts, sizes) of the groups of equal pairs."""
    order = np.lexsort((two, one))
    a, b = one[order], two[order]
    if not len(a):
        return order, order, order
    start = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return order, start, np.diff(np.append(start, len(a)))


def repeated_windows(segments: list[np.ndarray], window: int) -> np.ndarray:
    """For segments joined in order (separated, so that nothing crosses): True at each start of a window that
    also starts at another place of the segments. Starts at which no whole window fits are False."""
    size = np.array([len(s) for s in segments], np.int64)
    total = int(size.sum() + len(size))
    t = np.ones(total + 1, np.int32)
    place = np.cumsum(size + 1) - size - 1
    t[spread(place, size)] = np.concatenate(segments).astype(np.int32) + 2
    t[-1] = 0
    rest = np.zeros(total + 1, np.int64)
    rest[spread(place, size)] = np.repeat(size, size) - spread(np.zeros(len(size), np.int64), size)
    phi, plcp = permuted_lcp(t, suffix_array(t))
    same = plcp >= window
    out = same.copy()
    out[phi[same]] = True
    return (out & (rest >= window))[spread(place, size)]


def shared_part(data: np.ndarray, begin: np.ndarray, size: np.ndarray, place: np.ndarray, key: np.ndarray, total: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """[lo, hi) of each distinct run that can share a window with another run of its minimizer; lo = hi: none.

    A window around the minimizer holds half of what a window has besides, either on its left or on its right.
    A run whose left (right) half no other run of the minimizer shares has no shared window of that kind.
    """
    half = (window - gram) // 2
    need = window - gram - half  # a window with fewer than `half` bytes on the left has `need` on the right
    at = begin + place

    def hashes(start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.empty(len(start), np.uint64)
        order = np.argsort(start)
        for i in range(0, len(start), 4096):  # prefix sums of a stretch of the data at a time
            rows = order[i : i + 4096]
            for rows in np.array_split(rows, max(1, int(start[rows[-1]] - start[rows[0]]) >> 20)):
                base, top = int(start[rows[0]]), int(end[rows].max())
                out[rows] = Prefix(data[base:top], BYTE_BASE).ranges(start[rows] - base, end[rows] - base)
        return out

    def shared(ok: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.zeros(len(begin), bool)
        rows = np.flatnonzero(ok)
        if not len(rows):
            return out
        h = segment_key(key[rows], hashes(start[rows], end[rows]))
        order = np.argsort(h, kind="stable")
        _, n = group_runs(h[order])
        out[rows[order]] = np.repeat(n >= 2, n)
        return out

    left = shared(place >= half, at - half, at + gram)
    right = shared(size - place - gram >= need, at, at + gram + need)
    lo = np.where(left, 0, np.maximum(place - half, 0))
    hi = np.where(right, size, np.minimum(place + gram + need, size))
    none = ~(left | right)
    return np.where(none, 0, lo), np.where(none, 0, hi)


def segment_key(key: np.ndarray, content: np.ndarray) -> np.ndarray:
    return key ^ (content * np.uint64(0x9E3779B97F4A7C15))


def judge(docs: DataFrame, window: int = 200, gram: int = GRAM, hot: int = HOT, array: int = ARRAY, bucket_bytes: int = BUCKET_BYTES, key_bytes: int = KEY_BYTES, carry: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(bucketed documents, verdicts by bucket); covered() turns the pair into the removed bytes of each document."""
    n_docs = byte_buckets(docs, "text", bucket_bytes)
    n_keys = max(1, -(-n_docs * bucket_bytes // key_bytes))
    texts = bucketed(docs, n_docs, carry)

    def send_keys(key, group):
        b = Bucket(group, window, gram)
        keys, count = np.unique(b.key, return_counts=True)
        order, got, bound = deal(keys, n_keys)
        keys, count = keys[order], np.minimum(count[order], 65535).astype(np.uint16)
        return pack_table([(int(k), key[0].as_py(), 0, keys[s:e], count[s:e]) for k, s, e in zip(got, bound, bound[1:])])

    def count_keys(key, group):
        db, (keys, count) = unpack(group, 0, (np.uint64, np.uint16))
        order = np.argsort(keys, kind="stable")
        start, size = group_runs(keys[order])
        total = np.add.reduceat(count[order].astype(np.int64), start) if len(start) else start
        twice = np.repeat(total >= 2, size)
        keys, db, much = keys[order][twice], db[order][twice], np.repeat(total > hot, size)[twice].astype(np.uint8)
        order = np.argsort(db, kind="stable")
        s, n = group_runs(db[order])
        return pack_table([(0, int(db[order[a]]), 1, keys[order[a : a + m]], much[order[a : a + m]]) for a, m in zip(s, n)])

    repeated = texts.groupBy("db").applyInArrow(send_keys, PACKED).groupBy("kb").applyInArrow(count_keys, PACKED)

    def send_runs(key, group, verdict):
        if not group.num_rows or not verdict.num_rows:
            return pack_table([])
        b = Bucket(group, window, gram)
        _, (keys, much) = unpack(verdict, 1, (np.uint64, np.uint8))
        order = np.argsort(keys)
        found, at = member(b.key, keys[order])
        is_hot = found & (much[order][at] == 1) if len(keys) else found
        out, db = [], key[0].as_py()
        pick = np.flatnonzero(found & ~is_hot)
        if len(pick):
            head, content = b.alike(pick)
            by = np.argsort(head, kind="stable")
            start, count = group_runs(head[by])
            rep = by[start]
            order, got, bound = deal(b.key[pick[rep]], n_keys)
            one, content, count = pick[rep][order], content[rep][order], count[order]
            size = b.last[one] - b.first[one] + window
            shape = np.stack([size, np.minimum(count, 2), (b.place - b.first)[one], b.first[one]], 1).astype(np.int32)
            for k, s, e in zip(got, bound, bound[1:]):
                out.append((int(k), db, 2, b.key[one[s:e]], content[s:e], shape[s:e], b.data[spread(b.first[one[s:e]], size[s:e])]))
        pick = np.flatnonzero(is_hot)
        if len(pick):
            _, h, g = b.window_hashes(pick)
            order, start, count = twin_groups(h, g)
            h, g, count = h[order][start], g[order][start], np.minimum(count, 2).astype(np.uint8)
            order, got, bound = deal(h, n_keys)
            h, g, count = h[order], g[order], count[order]
            hot_keys = np.unique(b.key[pick])
            out += [(int(k), db, 3, h[s:e], g[s:e], count[s:e], hot_keys) for k, s, e in zip(got, bound, bound[1:])]
        return pack_table(out)

    def solve(key, group):
        out = []
        db, (h, g, count) = unpack(group, 3, (np.uint64, np.uint64, np.uint8))
        if len(h):
            order, start, size = twin_groups(h, g)
            twice = np.repeat(np.add.reduceat(count[order].astype(np.int64), start) >= 2, size)
            h, g, d = h[order][twice], g[order][twice], db[order][twice]
            order = np.argsort(d, kind="stable")
            out += [(0, int(d[order[a]]), 4, h[order[a : a + m]], g[order[a : a + m]]) for a, m in zip(*group_runs(d[order]))]
            sent = zip(*(group[c].to_pylist() for c in ("db", "kind", "d")))
            out += [(0, n, 6, np.frombuffer(c, np.uint64)) for n, kind, c in sent if kind == 3]
        db, (keys, content, shape, data) = unpack(group, 2, (np.uint64, np.uint64, np.int32, np.uint8))
        if not len(keys):
            return pack_table(out)
        size, count, place, at = shape.reshape(-1, 4).T.astype(np.int64)
        begin = np.cumsum(size) - size
        name = exact_groups(content, data, begin, size)
        by = np.lexsort((name, keys))
        start, times = group_runs(name[by])
        total = np.add.reduceat(count[by], start)
        first = by[start]
        lo, hi = shared_part(data, begin[first], size[first], place[first], keys[first], total, window, gram)
        # arrays of bounded size, cut between minimizers only
        group_at = np.flatnonzero(np.concatenate([[True], keys[first][1:] != keys[first][:-1]]))
        group_size = np.add.reduceat(hi - lo, group_at)
        part = np.repeat((np.cumsum(group_size) - group_size) // array, np.diff(np.append(group_at, len(first))))
        found: list[tuple[np.ndarray, ...]] = []
        for a in np.unique(part[hi > lo]):
            own = np.flatnonzero((part == a) & (hi > lo))
            flags = repeated_windows([data[begin[first[x]] + lo[x] : begin[first[x]] + hi[x]] for x in own], window)
            ends = np.cumsum((hi - lo)[own])
            starts = ends - (hi - lo)[own]
            edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
            s, e = edge[::2], edge[1::2] - 1
            seg = np.searchsorted(ends, s, side="right")
            found.append((own[seg], s - starts[seg] + lo[own[seg]], e - starts[seg] + lo[own[seg]]))
        # a run that occurs twice is repeated at each of its windows
        twice = np.flatnonzero(total >= 2)
        found.append((twice, np.zeros(len(twice), np.int64), size[first[twice]] - window))
        # back to every bucket that sent the run
        for which, s, e in found:
            n = times[which]
            src = by[spread(start[which], n)]
            told = np.stack([at[src], np.repeat(s, n), np.repeat(e, n)], 1).astype(np.int32)
            d = db[src]
            order = np.argsort(d, kind="stable")
            out += [(0, int(d[order[x]]), 5, told[order[x : x + m]]) for x, m in zip(*group_runs(d[order]))]
        give_back()
        return pack_table(out)

    solved = texts.groupBy("db").cogroup(repeated.groupBy("db")).applyInArrow(send_runs, PACKED).groupBy("kb").applyInArrow(solve, PACKED)
    return texts, solved


def removal(bucket: Bucket, verdict: pa.Table) -> np.ndarray:
    """True at each byte of the bucket's texts that a repeated window covers."""
    n, window = len(bucket.data), bucket.window
    _, (told,) = unpack(verdict, 5, (np.int32,))
    _, (hot, hot_too) = unpack(verdict, 4, (np.uint64, np.uint64))
    mark = np.zeros(n + 1, np.int64)

    def cover(first: np.ndarray, last: np.ndarray) -> None:
        np.add(mark, np.bincount(first, minlength=n + 1), out=mark)
        np.subtract(mark, np.bincount(last + window, minlength=n + 1), out=mark)

    if len(told):
        told = told.reshape(-1, 3).astype(np.int64)  # begin of the first equal run, first and last window
        told = told[np.argsort(told[:, 0], kind="stable")]
        head = bucket.first[bucket.alike(np.arange(len(bucket.first)))[0]]
        lo, hi = np.searchsorted(told[:, 0], head, "left"), np.searchsorted(told[:, 0], head, "right")
        at, base = spread(lo, hi - lo), np.repeat(bucket.first, hi - lo)
        cover(base + told[at, 1], base + told[at, 2])
    if len(hot):
        _, (hot_keys,) = unpack(verdict, 6, (np.uint64,))
        starts, h, g = bucket.window_hashes(np.flatnonzero(member(bucket.key, np.unique(hot_keys))[0]))
        # a window is told if its pair of hashes is among the pairs: one more entry of its group
        order, start, size = twin_groups(np.concatenate([hot, h]), np.concatenate([hot_too, g]))
        known = np.repeat(np.logical_or.reduceat(order < len(hot), start), size)
        s = starts[order[known & (order >= len(hot))] - len(hot)]
        cover(s, s)
    return np.cumsum(mark[:n]) > 0


def remove_repeats(docs: DataFrame, finish, schema: str | StructType, window: int = 200, **sizes) -> DataFrame:
    """finish(columns, bucket, removed) -> pa.Table of `schema`, called for each bucket of documents.

    columns: name -> values of doc_id and of the column named by `carry`.
    """
    texts, verdicts = judge(docs, window, **sizes)
    gram, names = sizes.get("gram", GRAM), [c for c in texts.columns if c not in ("db", "text")]

    def run(key, group, verdict):
        b = Bucket(group, window, gram)
        out = finish({c: b.rows[c] for c in names}, b, removal(b, verdict))
        give_back()
        return out

    return texts.groupBy("db").cogroup(verdicts.groupBy("db")).applyInArrow(run, schema)


def digest(columns: dict, b: Bucket, removed: np.ndarray) -> pa.Table:
    rows = []
    for s, e in zip(b.off[:-1].tolist(), b.off[1:].tolist()):
        r = removed[s:e]
        n = int(r.sum())
        spans = int(r[0]) + int((r[1:] > r[:-1]).sum()) if e > s else 0
        kept = b.data[s:e][~r] if n else b.data[s:e]
        rows.append((e - s, n, spans, hashlib.sha256(kept.tobytes()).hexdigest()))
    a = list(zip(*rows)) if rows else [[]] * 4
    return pa.table({"doc_id": columns["doc_id"], "n_bytes": pa.array(a[0], pa.int64()), "n_removed": pa.array(a[1], pa.int64()), "n_spans": pa.array(a[2], pa.int64()), "kept_sha256": pa.array(a[3], pa.string())})


def texts_left(columns: dict, b: Bucket, removed: np.ndarray) -> pa.Table:
    """The columns and the text that is left; a character cut in part goes whole."""
    out = [b.data[s:e][~removed[s:e]].tobytes().decode("utf-8", "ignore") for s, e in zip(b.off[:-1].tolist(), b.off[1:].tolist())]
    return pa.table({**columns, "text": pa.array(out, pa.string())})


def removed_digest(docs: DataFrame, window: int = 200, **sizes) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row."""
    return remove_repeats(docs, digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", window, **sizes)


def without_repeats(docs: DataFrame, window: int = 200, **sizes) -> DataFrame:
    """doc_id and the text that is left for each row; a document may end up empty."""
    return remove_repeats(docs, texts_left, "doc_id long, text string", window, **sizes)
