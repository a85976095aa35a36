import base64
import hashlib
import io
import math
import random
import re
import struct
import zlib
from collections import Counter

import pytest
import zstandard

from loomspan.llm import lexical_search, periodic_runs, queries, warc
from loomspan.llm.common import table
from tests.llm.helpers import AWKWARD, WORD, documents, grouped

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = "/root/testdata/sf0.001"


# --- periodic runs


def brute_runs(w, least):
    out, seen = [], set()
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q) and (i, j + q) not in seen:  # the first period found is the smallest
                seen.add((i, j + q))
                out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_collapse(w, runs):
    return " ".join(x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs))


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_as_brute_force(least):
    rng = random.Random(least)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 6)):
            k = rng.choice([1, 2, 3, 5, 30])
            w = [chr(97 + rng.randrange(k)) for _ in range(rng.randint(0, 80))]
            if rng.random() < 0.5:
                w += w[: rng.randint(1, 12)] * rng.randint(1, 8) + [rng.choice("abz")] + w[:5]
            texts.append(w)
        got = periodic_runs.find(texts, least)
        assert got == [brute_runs(w, least) for w in texts]
        assert [periodic_runs.collapse(w, r) for w, r in zip(texts, got)] == [brute_collapse(w, r) for w, r in zip(texts, got)]


def test_runs_when_hashes_lie(monkeypatch):
    """Hashes only choose what enters the tree: with all of them equal, everything does, and nothing else changes."""
    rng = random.Random(4)
    texts = [[rng.choice("ab") for _ in range(60)] for _ in range(8)]
    monkeypatch.setattr(periodic_runs, "repeated_stretches", lambda h, doc, gram: doc >= 0)
    assert periodic_runs.find(texts, 6) == [brute_runs(w, 6) for w in texts]


def test_long_runs_of_one_word():
    assert periodic_runs.find([["a"] * 50_000 + ["b"] + ["x", "y"] * 20_000], 12) == [[(0, 50_000, 1), (50_001, 40_000, 2)]]


def test_leaves_in_several_turns(monkeypatch):
    monkeypatch.setattr(periodic_runs, "LEAVES", 7)
    w = list("abcabcabcabcabcxabababababababab")
    assert periodic_runs.find([w, w[:20]], 5) == [brute_runs(w, 5), brute_runs(w[:20], 5)]


def test_runs_of_rows(spark):
    docs = AWKWARD + [(20, "a b c " * 6 + "d"), (21, "x " * 12), (22, "x " * 11), (23, "a\vb\ta\x0cb a b a b a b a b")]
    got = periodic_runs.find_runs(documents(spark, docs)).collect()
    assert len(got) == len(docs)
    want = {}
    for i, t in docs:
        w = WORD.findall(t or "")
        r = brute_runs(w, 12)
        want.setdefault(i, []).append((len(w), [tuple(x) for x in r], brute_collapse(w, r)))
    have = {}
    for r in got:
        have.setdefault(r["doc_id"], []).append((r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]))
    assert have == want
    assert periodic_runs.find_runs(documents(spark, [(1, "x")]).where("false")).count() == 0


def digests(i, t):
    w = WORD.findall(t or "")
    n, h = len(w), zlib.crc32(str(i).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
    r = brute_runs(w, 12)
    top = max(r, key=lambda x: (x[1], -x[0], -x[2]), default=(None, None, None))
    milli = 1000 * top[1] // top[2] if r else None
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in r)
    return (len(r), *top, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(brute_collapse(w, r).encode()).hexdigest())


def test_query_of_runs(spark):
    """The whole small table (texts of more than 3000 words aside, for the brute force alone) and awkward rows."""
    docs = [(r["doc_id"], r["text"]) for r in table(spark, SMALL, "documents").select("doc_id", "text").collect()]
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op13_periodic_runs(spark, SMALL).collect()}
    assert len(got) == len(docs)
    told = 0
    for i, t in docs:
        if len(WORD.findall(t or "")) <= 3000:
            assert got[i] == digests(i, t), i
            told += got[i][0] > 0
    assert told > 5


# --- ranked search


def brute_search(docs, items, k):
    cut = lambda t: TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    bags = [(i, Counter(cut(t))) for i, t in docs if cut(t)]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(cut(t))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, b in bags:
            m = 100 - 75 + (75 * sum(b.values()) * n_docs) // n_terms
            s = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * b[t] // (1000 * b[t] + 8 * m)) for t, c in terms.items() if t in b)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def bench(spark, rows):
    return spark.createDataFrame([(i, t, "q", 0) for i, t in rows], "item_id long, text string, term string, score int")


@pytest.mark.parametrize("block,parts", [(100_000, 64), (5, 1), (9, 3)])
def test_search_as_brute_force(spark, block, parts):
    rng = random.Random(block)
    words = ["The", "the", "Éa", "b2", "c_d", "x-y", "zeta", "中文", "q", "İ"]
    docs = AWKWARD + [(100 + i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for i in range(60)]
    docs += [(100, "the zeta"), (100, "the zeta"), (None, "zeta q")]
    items = [(1, "THE zeta zeta b2"), (2, None), (3, ""), (4, "nowhere"), (5, "中文 q the c"), (5, "éa"), (None, "zeta")]
    got = lexical_search.top_documents(documents(spark, docs), bench(spark, items), k=4, block_terms=block, floor_parts=parts).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_search(docs, items, 4)


def test_search_in_empty_tables(spark):
    some, none = documents(spark, [(1, "x")]), documents(spark, [(1, "x")]).where("false")
    assert lexical_search.top_documents(none, bench(spark, [(1, "x")])).count() == 0
    assert lexical_search.top_documents(some, bench(spark, [(1, "x")]).where("false")).count() == 0


def test_a_full_filter_only_lets_more_through(spark, monkeypatch):
    docs, items = [(i, f"a{i} b{i % 3} c") for i in range(20)], [(1, "a3 b1"), (2, "c c b2")]
    monkeypatch.setattr(lexical_search, "term_filter", lambda wanted: b"\xff" * (1 << 20))
    got = lexical_search.top_documents(documents(spark, docs), bench(spark, items), k=5).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_search(docs, items, 5)


# --- archives


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], "page_id long, url string, html string, key string, salt int").repartition(3)


PAGES = [
    (1, "http://a/1", "<p>ünï</p>"), (2, "http://a/2", None), (3, "http://a/3\r\nX: y", "<p>ünï</p>"), (4, None, ""), (5, "http://a/5", "z" * 300_000),
    (6, "u", "WARC/1.1\r\n\r\nnot a header"), (7, "u", "z" * 300_000), (None, "n", "<p>ünï</p>"), (None, None, "alone"), (8, "u", "twin"), (8, "v", "twin"), (9, "w", "twin"),
]


def told(rows, least=0):
    first = {}
    for i, _, h in rows:
        h = h or ""
        if i is not None:
            first[h] = min(first.get(h, i), i)
    out = {}
    for i, _, h in rows:
        b = (h or "").encode()
        f = first.get(h or "")
        again = len(b) >= least and f is not None and f != i
        out.setdefault(i, []).append((len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", f if again else None))
    return {k: sorted(v, key=str) for k, v in out.items()}


@pytest.mark.parametrize("least,size", [(0, 64 << 20), (5, 100)])
def test_archives_round_trip(spark, tmp_path, least, size):
    manifest = warc.write_archives(pages(spark, PAGES), folder=f"file://{tmp_path}/w", least_bytes=least, archive_bytes=size)
    assert manifest.agg({"n_records": "sum"}).first()[0] == len(PAGES)
    back = warc.read_archives(manifest)
    rows = back.collect()
    got = {}
    for r in rows:
        got.setdefault(r["page_id"], []).append((r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]))
    assert {k: sorted(v, key=str) for k, v in got.items()} == told(PAGES, least)
    texts = {(i, u): h or "" for i, u, h in PAGES}
    for r in rows:
        if r["record_type"] == "response" and r["page_id"] != 3:
            assert bytes(r["payload"]).decode() == texts[r["page_id"], r["url"]]
        elif r["record_type"] == "revisit":
            assert r["payload"] is None
    assert warc.read_archives(manifest, payloads=False).columns == back.columns[:-1]
    if size == 100:
        assert manifest.count() == len(PAGES)


def test_each_record_is_a_frame_of_its_own(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<html><body>page {i} {'text ' * (i % 7)}</body></html>") for i in range(200)]
    manifest = warc.write_archives(pages(spark, rows).coalesce(1), folder=f"file://{tmp_path}/w")
    paths = [r["path"] for r in manifest.collect()]
    records = 0
    for path in paths:
        data = open(path.removeprefix("file://"), "rb").read()
        magic, size = struct.unpack("<II", data[:8])
        assert magic == 0x184D2A5D
        words = zstandard.ZstdCompressionDict(data[8 : 8 + size])
        assert words.dict_id() != 0  # trained, not raw bytes
        rest = data[8 + size :]
        while rest:
            one = zstandard.ZstdDecompressor(dict_data=words).decompressobj()
            plain = one.decompress(rest)
            assert zstandard.get_frame_parameters(rest).dict_id == words.dict_id()
            assert plain.startswith(b"WARC/1.1\r\nWARC-Type: ") and plain.endswith(b"\r\n\r\n") and plain.count(b"WARC-Record-ID") == 1
            assert len(list(warc.parse(io.BufferedReader(io.BytesIO(plain))))) == 1
            rest, records = one.unused_data, records + 1
    assert records == len(rows)


def test_archives_of_lost_tasks_are_not_read(spark, tmp_path):
    manifest = warc.write_archives(pages(spark, PAGES), folder=f"file://{tmp_path}/w")
    (tmp_path / "w" / "left.warc.zst").write_bytes(b"half a fra")
    assert warc.read_archives(manifest).count() == len(PAGES)


def test_changed_payloads_are_told():
    good = warc.record(1, "u", b"payload")
    with pytest.raises(ValueError):
        list(warc.parse(io.BufferedReader(io.BytesIO(good.replace(b"\r\n\r\npayload", b"\r\n\r\npaylaod")))))


def test_archives_of_nothing(spark, tmp_path):
    manifest = warc.write_archives(pages(spark, PAGES).where("false"), folder=f"file://{tmp_path}/w")
    assert manifest.count() == 0 and warc.read_archives(manifest).count() == 0


def test_search_query_ranks_are_whole(spark):
    got = grouped(queries.op11_lexical_search(spark, SMALL).select("item_id", "rank").collect())
    assert all([r for r, in v] == list(range(1, len(v) + 1)) for v in got.values())
