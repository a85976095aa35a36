"""Suffix arrays by induced sorting, and permuted longest common prefixes, on numpy arrays.

The classical linear construction: suffixes are classified as smaller or larger than their right neighbour;
leftmost-smaller (LMS) substrings are sorted by inducing and named; if names repeat, the string of names is
sorted recursively; the order of LMS suffixes then induces all others in two scans. A scan is cut into
waves: the longest stretch whose entries are all final, because nothing that it induces falls inside it. A
wave's predecessors are placed at their buckets' ends together, in order, which is what a scan entry by
entry does.
"""

from __future__ import annotations

import numpy as np


def suffix_array(t: np.ndarray) -> np.ndarray:
    """t: non-negative integers whose last element is 0 and occurs only there."""
    return _sais(np.ascontiguousarray(t, np.int32), int(t.max()) + 1)


def _smaller(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its right neighbour (S-type)."""
    n = len(t)
    s = np.ones(n, bool)
    if n > 1:
        less, differ = t[:-1] < t[1:], t[:-1] != t[1:]
        at = np.where(differ, np.arange(n - 1), n - 1)
        nxt = np.minimum.accumulate(at[::-1])[::-1]
        s[:-1] = less[nxt]  # the last pair always differs: the end is unique
    return s


def _sais(t: np.ndarray, k: int) -> np.ndarray:
    n = len(t)
    if n < 48:
        x = t.tolist()
        return np.array(sorted(range(n), key=lambda i: x[i:]), np.int32)
    s = _smaller(t)
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    tails = np.cumsum(np.bincount(t, minlength=k))
    sa = _induce(t, s, lms, tails)
    # LMS substrings in order; equal neighbours share a name
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = sa[is_lms[sa]].astype(np.int64)
    size = np.ones(n, np.int64)
    size[lms[:-1]] = np.diff(lms) + 1
    a, b = order[:-1], order[1:]
    same = size[a] == size[b]
    live = np.flatnonzero(same)
    off = 0
    while len(live):
        differ = t[a[live] + off] != t[b[live] + off]
        same[live[differ]] = False
        off += 1
        live = live[~differ & (off < size[a[live]])]
    name = np.concatenate([[0], np.cumsum(~same)])
    if name[-1] + 1 == len(lms):
        lms_order = order
    else:
        of = np.zeros(n, np.int32)
        of[order] = name
        lms_order = lms[_sais(of[lms], int(name[-1]) + 1)]
    return _induce(t, s, lms_order, tails)


def _induce(t: np.ndarray, s: np.ndarray, lms: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """All suffixes from the LMS ones, given in an order that holds within each bucket."""
    n = len(t)
    sa = np.full(n, -1, np.int32)
    ch = t[lms]
    order = np.argsort(ch, kind="stable")
    c = ch[order]
    first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
    count = np.diff(np.append(first, len(c)))
    sa[np.repeat(tails[c[first]] - count - first, count) + np.arange(len(c))] = lms[order]
    # what a suffix induces: the symbol in front of it if that makes a larger (smaller) suffix; entry -1 is "none"
    front = np.full(n + 1, -1, np.int32)
    front[1:n] = np.where(s[:-1], -1, t[:-1])
    small = np.full(n + 1, -1, np.int32)
    small[1:n] = np.where(s[:-1], t[:-1], -1)
    few = len(tails) <= 65536
    count_up = np.arange(n)
    # larger suffixes, from the left
    heads = np.concatenate([[0], tails[:-1]])
    i, width = 0, 4096
    while i < n:
        seg = sa[i : i + width]
        c = front[seg]
        idx = (c >= 0).nonzero()[0]
        end = min(n, i + width)
        if len(idx):
            c = c[idx]
            least = np.minimum.accumulate(heads[c])
            good = least > idx + i
            m = len(idx)
            whole = bool(good[-1])
            if not whole:  # the targets only come nearer and the places only go on
                m = int(good.argmin())
                c = c[:m]
            end = min(end, int(least[m - 1]))
            p = seg[idx[:m]] - 1
            if m > 1:
                order = (c.astype(np.uint16) if few and m > 64 else c).argsort(kind="stable")  # 16 bits go by radix
                c, p = c[order], p[order]
                cut = (c[1:] != c[:-1]).nonzero()[0]
                if len(cut):
                    first = np.zeros(m, np.int64)
                    first[cut + 1] = cut + 1
                    pos = heads[c] + count_up[:m] - np.maximum.accumulate(first)
                    sa[pos] = p
                    heads[c[cut]] = pos[cut] + 1
                    heads[c[-1]] = pos[-1] + 1
                else:
                    h = heads[c[0]]
                    sa[h : h + m] = p
                    heads[c[0]] = h + m
            else:
                h = heads[c[0]]
                sa[h] = p[0]
                heads[c[0]] = h + 1
            width = width * 2 if whole and end == i + width else max(512, 2 * (end - i))
        i = end
    # smaller suffixes, from the right; the LMS entries are induced anew
    filled = sa >= 0
    filled[filled] = s[sa[filled]]
    sa[filled] = -1
    ends = tails.copy()
    i, width = n - 1, 4096
    while i >= 0:
        lo = max(0, i - width + 1)
        seg = sa[lo : i + 1][::-1]
        c = small[seg]
        idx = (c >= 0).nonzero()[0]
        stop = lo
        if len(idx):
            c = c[idx]
            most = np.maximum.accumulate(ends[c])
            good = most <= i - idx
            m = len(idx)
            whole = bool(good[-1])
            if not whole:
                m = int(good.argmin())
                c = c[:m]
            stop = max(stop, int(most[m - 1]))
            p = seg[idx[:m]] - 1
            if m > 1:
                order = (c.astype(np.uint16) if few and m > 64 else c).argsort(kind="stable")
                c, p = c[order], p[order]
                cut = (c[1:] != c[:-1]).nonzero()[0]
                if len(cut):
                    first = np.zeros(m, np.int64)
                    first[cut + 1] = cut + 1
                    pos = ends[c] - 1 - count_up[:m] + np.maximum.accumulate(first)
                    sa[pos] = p
                    ends[c[cut]] = pos[cut]
                    ends[c[-1]] = pos[-1]
                else:
                    h = ends[c[0]]
                    sa[h - m : h] = p[::-1]
                    ends[c[0]] = h - m
            else:
                h = ends[c[0]] - 1
                sa[h] = p[0]
                ends[c[0]] = h
            width = width * 2 if whole and stop == lo else max(512, 2 * (i + 1 - stop))
        i = stop - 1
    sa[0] = n - 1
    return sa


def permuted_lcp(t: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(phi, plcp): each suffix's predecessor in the array (-1: none), and the length of their common prefix.

    A prefix is reducible where the symbols in front agree too: it is then one less than its left
    neighbour's. Only irreducible ones are compared, four symbols at a time.
    """
    n = len(t)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    i = np.arange(n)
    reducible = (i > 0) & (phi > 0)
    reducible[reducible] = t[i[reducible] - 1] == t[phi[reducible] - 1]
    start = np.flatnonzero(~reducible & (phi >= 0))
    x = np.concatenate([t.astype(np.uint64), np.zeros(4, np.uint64)])
    four = x[:n] | x[1 : n + 1] << np.uint64(16) | x[2 : n + 2] << np.uint64(32) | x[3 : n + 3] << np.uint64(48)
    length = np.zeros(len(start), np.int64)
    live = np.arange(len(start))
    a, b = start.copy(), phi[start]
    while len(live):
        room = (a + 4 <= n) & (b + 4 <= n)
        diff = np.where(room, four[np.minimum(a, n - 1)] ^ four[np.minimum(b, n - 1)], np.uint64(1))
        same = diff == 0
        part = live[~same]
        if len(part):
            d = four[a[~same]] ^ four[b[~same]]
            length[part] += ((d & np.uint64(0xFFFF)) == 0) * (1 + ((d & np.uint64(0xFFFFFFFF)) == 0) * (1 + ((d & np.uint64(0xFFFFFFFFFFFF)) == 0).astype(np.int64)))
        length[live[same]] += 4
        live, a, b = live[same], a[same] + 4, b[same] + 4
    plcp = np.zeros(n, np.int64)
    # a reducible place continues the nearest irreducible one on its left
    src = np.full(n, -1, np.int64)
    src[start] = np.arange(len(start))
    src[~reducible & (phi < 0)] = -2
    owner = np.maximum.accumulate(np.where(src != -1, i, -1))
    ok = (owner >= 0) & (src[np.maximum(owner, 0)] >= 0)
    plcp[ok] = np.maximum(0, length[src[owner[ok]]] - (i[ok] - owner[ok]))
    return phi, plcp
