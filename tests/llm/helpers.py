"""Small tables with every awkward row, and brute-force twins."""

import hashlib
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, rows, parts=3):
    """doc_id, text and columns whose names clash with those that operators use inside."""
    full = [(i, t, "en", "s", 0, 1, 2.0, b"x") for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, db int, score double, key binary").repartition(parts)


AWKWARD = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "ü" * 300), (6, "the same words " * 400), (6, "the same words " * 400), (None, "no id here at all"), (7, "x" * 20000)]


def brute_bytes(docs, window):
    where = {}
    for k, (_, t) in enumerate(docs):
        b = (t or "").encode()
        for p in range(len(b) - window + 1):
            where.setdefault(b[p : p + window], []).append((k, p))
    gone = [bytearray(len((t or "").encode())) for _, t in docs]
    for places in where.values():
        if len(places) > 1:
            for k, p in places:
                gone[k][p : p + window] = b"\1" * window
    out = {}
    for (i, t), r in zip(docs, gone):
        b = (t or "").encode()
        spans = sum(1 for k in range(len(r)) if r[k] and (k == 0 or not r[k - 1]))
        out.setdefault(i, []).append((len(b), sum(r), spans, hashlib.sha256(bytes(x for x, g in zip(b, r) if not g)).hexdigest()))
    return out


def brute_words(docs, n):
    key = lambda i: float("inf") if i is None else i
    first = {}
    for i, t in docs:
        ws = WORD.findall(t or "")
        for p in range(len(ws) - n + 1):
            k = tuple(ws[p : p + n])
            first[k] = min(first.get(k, float("inf")), key(i))
    out = {}
    for i, t in docs:
        ws = WORD.findall(t or "")
        r = [False] * len(ws)
        for p in range(len(ws) - n + 1):
            if first[tuple(ws[p : p + n])] < key(i):
                r[p : p + n] = [True] * n
        out.setdefault(i, []).append((len(ws), sum(r), hashlib.sha256(" ".join(w for w, x in zip(ws, r) if not x).encode()).hexdigest()))
    return out


def least(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def grouped(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(tuple(r)[1:])
    return {k: sorted(v) for k, v in out.items()}


def corpus(seed=3):
    rng = random.Random(seed)
    text = lambda n, al: "".join(rng.choice(al) for _ in range(n))
    base = [text(rng.randint(0, 400), "abcdé ") for _ in range(60)]
    shared = text(120, "xyzü ")
    docs = list(enumerate(base))
    docs += [(100 + i, text(rng.randint(0, 30), "ab ") + shared + text(rng.randint(0, 30), "cd ")) for i in range(40)]
    docs += [(200 + i, base[i]) for i in range(20)] + [(300, None), (301, ""), (302, "a" * 500), (303, "ab " * 200), (303, "ab " * 200), (None, base[3])]
    rng.shuffle(docs)
    return docs
