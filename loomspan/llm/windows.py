"""Rolling hashes, minimizers and packed exchanges that the two substring operators share.

Hashes are polynomials modulo 2**64 with odd multipliers, mixed afterwards, so that any range's hash comes
from two prefix sums. They only say where equal strings can be: exact_groups() compares the strings.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD6E8FEB86659FD93
U64 = (1 << 64) - 1
POSITION_BITS = 24


LOW = 12


@lru_cache(maxsize=24)
def _powers(base: int, step: int, n: int) -> np.ndarray:
    """base**(step * i) modulo 2**64 for i < n."""
    out = np.full(n, pow(base, step, 1 << 64), np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _tables(base: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i for i < 2**LOW, and base**(i * 2**LOW) as far as exponents up to `most` need it: nothing as long as a text."""
    return _powers(base, 1, 1 << LOW), _powers(base, 1 << LOW, 1 << max(LOW, (most >> LOW).bit_length()))


def power(base: int, at: np.ndarray) -> np.ndarray:
    """base**at modulo 2**64."""
    low, high = _tables(base, int(at.max()) if len(at) else 0)
    return low[at & ((1 << LOW) - 1)] * high[at >> LOW]


def first_powers(base: int, n: int) -> np.ndarray:
    """base**i modulo 2**64 for i < n, made anew."""
    low, high = _tables(base, n)
    return (high[: -(-n // len(low)), None] * low[None, :]).ravel()[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class Prefix:
    """Hashes of ranges of a sequence of unsigned numbers."""

    def __init__(self, values: np.ndarray, base: int):
        self.inverse = pow(base, -1, 1 << 64)
        self.sum = np.zeros(len(values) + 1, np.uint64)
        terms = first_powers(base, len(values))
        terms *= values.astype(np.uint64) + np.uint64(1)
        np.cumsum(terms, out=self.sum[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sum[end] - self.sum[start]) * power(self.inverse, start) + (end - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k values from each place on."""
        n = len(self.sum) - k
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = self.sum[k:] - self.sum[:n]
        out *= first_powers(self.inverse, n)
        out += np.uint64(k * 0xA0761D6478BD642F & U64)
        return mix(out)


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by prefix and suffix minima of blocks of w."""
    n = len(v)
    if n < w:
        return v[:0]
    pad = -n % w
    b = np.concatenate([v, np.full(pad, U64, np.uint64)]).reshape(-1, w)
    left = np.minimum.accumulate(b, 1).ravel()
    right = np.minimum.accumulate(b[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


#: Windows that runs() looks at in one go.
STEP = 1 << 17


def runs(gram_hash: np.ndarray, w: int, size: int, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows that share a minimizer: (first window, last window, minimizer's hash, its place).

    A window of `size` symbols from place p holds the w grams from p on and must end at ends[p] at the latest.
    The minimizer is the least hash, the leftmost of equals: a function of the window's content alone.
    """
    z = np.zeros(0, np.int64)
    first, last, place = [z], [z], [z]
    n, low = len(gram_hash) - w + 1, np.uint64((1 << POSITION_BITS) - 1)
    for s in range(0, max(0, n), STEP):
        e = min(n, s + STEP)
        g = gram_hash[s : e + w - 1]
        least = sliding_min((g & ~low) | np.arange(len(g), dtype=np.uint64), w)
        at = (least & low).astype(np.int64) + s
        ok = np.flatnonzero(np.arange(s, e) + size <= ends[s:e])
        if len(ok):
            a = at[ok]
            new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (np.diff(ok) != 1)]))
            first.append(ok[new] + s)
            last.append(ok[np.append(new[1:], len(ok)) - 1] + s)
            place.append(a[new])
    first, last, place = (np.concatenate(x) for x in (first, last, place))
    # a run that goes on in the next step is one
    same = np.flatnonzero((place[1:] == place[:-1]) & (first[1:] == last[:-1] + 1))
    last[same] = last[same + 1]
    keep = np.ones(len(first), bool)
    keep[same + 1] = False
    for i in same[::-1]:  # runs over more than two steps
        last[i] = max(last[i], last[i + 1])
    first, last, place = first[keep], last[keep], place[keep]
    return first, last, gram_hash[place] if len(place) else np.zeros(0, np.uint64), place


def member(keys: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key is in the sorted table: (found, place)."""
    if not len(table):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return table[at] == keys, at


def group_runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of a sorted array."""
    if not len(key):
        z = np.zeros(0, np.int64)
        return z, z
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return start, np.diff(np.append(start, len(key)))


def spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[i], ..., start[i] + length[i] - 1 for every i, one after another."""
    total = int(length.sum())
    before = np.repeat(np.cumsum(length) - length, length)
    return np.repeat(start, length) + np.arange(total) - before


def equal_ranges(values: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether values[a:a + length] and values[b:b + length] are the same, for each pair of starts; bytes go eight at a time."""
    out = np.ones(len(a), bool)
    step, wide = 1, values
    if values.dtype == np.uint8:
        step, padded = 8, np.concatenate([values, np.zeros(8, np.uint8)])
        wide = np.ndarray((len(values) + 1,), "<u8", padded, strides=(1,))
    live = np.flatnonzero(length > 0)
    a, b, left = a[live], b[live], length[live]
    while len(live):
        x, y = wide[a], wide[b]
        if step > 1:
            short = np.uint64(8) * np.maximum(0, step - left).astype(np.uint64)  # bits behind the range
            x, y = x << short, y << short
        same = x == y
        out[live[~same]] = False
        on = same & (left > step)
        live, a, b, left = live[on], a[on] + step, b[on] + step, left[on] - step
    return out


def exact_groups(hashes: np.ndarray, values: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For each range of `values` the first range with the same content. Equal hashes are compared value by value; ranges
    that share a hash with a different one are grouped anew among themselves."""
    out = np.arange(len(hashes))
    todo = out
    while len(todo) > 1:
        order = todo[np.argsort(hashes[todo], kind="stable")]
        first, n = group_runs(hashes[order])
        head = np.repeat(order[first], n)
        again = head != order
        a, b = order[again], head[again]
        same = length[a] == length[b]
        same[same] = equal_ranges(values, start[a[same]], start[b[same]], length[a[same]])
        out[a[same]] = b[same]
        todo = np.sort(a[~same])
    return out


def bucketed(docs: DataFrame, n: int, carry: str | None = None) -> DataFrame:
    """db, doc_id, text, and the column that is carried along. A bucket is a hash of the row and of the partition it is read
    from, so that rows without an id, repeated ids and equal rows never gather in one."""
    more = [carry] if carry else []
    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "text", *more)
    return rows.select(F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(n)).cast("int").alias("db"), "doc_id", "text", *more)


def in_order(group: pa.Table) -> pa.Table:
    """A bucket's rows in an order of their own, the same in every task that reads the bucket."""
    return group.sort_by([("doc_id", "ascending"), ("text", "ascending")])


PACKED = "kb int, db int, kind int, a binary, b binary, c binary, d binary"


def pack_table(rows: list[tuple]) -> pa.Table:
    """Rows (kb, db, kind, arrays...) of packed arrays; absent ones are empty."""
    cols: list[list] = [[] for _ in range(7)]
    for kb, db, kind, *arrays in rows:
        for c, x in zip(cols, (kb, db, kind, *[y.tobytes() for y in arrays], *[b""] * (4 - len(arrays)))):
            c.append(x)
    kinds = [pa.int32()] * 3 + [pa.binary()] * 4
    return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=["kb", "db", "kind", "a", "b", "c", "d"])


def unpack(table: pa.Table, kind: int, dtypes: tuple) -> tuple[np.ndarray, list[np.ndarray]]:
    """(db of each entry, arrays) of all rows of a kind, entries in the order of the rows."""
    rows = [r for r in zip(*(table[c].to_pylist() for c in ("db", "kind", "a", "b", "c", "d"))) if r[1] == kind]
    arrays = [[np.frombuffer(r[2 + i], t) for r in rows] for i, t in enumerate(dtypes)]
    db = np.repeat(np.array([r[0] for r in rows], np.int64), [len(x) for x in arrays[0]]) if rows else np.zeros(0, np.int64)
    return db, [np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(arrays, dtypes)]


def deal(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by bucket (the key modulo n), bucket numbers and their bounds in that order."""
    bucket = (keys % np.uint64(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    got, start = np.unique(bucket[order], return_index=True)
    return order, got, np.append(start, len(keys))
