"""Benchmark decontamination by pigeonhole edit matching.

A benchmark item occurs in a text if some passage of the normalised text (lower case, white space as single
blanks) is within `budget` edits of the normalised item, a tenth of its length. An item is split into at least
budget + 1 pieces, taken in pairs: a passage with at most that many edits holds a pair with one edit at most,
so one piece of it unchanged beside a partner with one edit at most. The exact hits of all pieces (one
Aho-Corasick pass over the text) with such a partner are the only places to verify, and none is missed.
Hits of one item are merged where their windows meet, and each window is verified by Myers' bit-parallel
edit distance with free ends.

Items with fewer than `min_chars` characters have no budget: they match verbatim, where they don't begin or end
inside a word. Null and empty items and texts match nothing; repeated items are matched under each of their ids; equal distances keep the first place.
Items are taken in blocks of bounded size, one pass over the texts a block, each pass written before the next
one begins: neither the driver nor a worker holds more than one block's items and automaton. Cost grows with
the number of blocks; a block has room for some thousands of items. Whole texts of any length are read;
repeated rows and ids get equal matches, rows of their own; empty tables stay empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import discard, give_back, settle

MIN_CHARS = 24
RATE = 0.1
BLOCK_BYTES = 1_500_000


def normal(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def pieces(item: str, budget: int) -> list[tuple[int, str, str, bool]]:
    """At least budget + 1 pieces of nearly equal length, in pairs: (offset, piece, its partner, partner is on the right).

    A passage within the budget has a pair with at most one edit, as more would make two edits a pair; one
    piece of that pair is unchanged and its partner is within one edit.
    """
    n, pairs = len(item), budget // 2 + 1
    cut = [n * i // (2 * pairs) for i in range(2 * pairs + 1)]
    out = []
    for a, b, c in zip(cut[::2], cut[1::2], cut[2::2]):
        out += [(a, item[a:b], item[b:c], True), (b, item[b:c], item[a:b], False)]
    return out


def one_edit_ahead(text: str, at: int, want: str) -> bool:
    """Whether some stretch of text from `at` on is within one edit of `want`."""
    n = len(want)
    got = text[at : at + n + 1]
    i = 0
    for a, b in zip(got, want):
        if a != b:
            break
        i += 1
    return i >= n - 1 or got[i + 1 : n] == want[i + 1 :] or got[i : n - 1] == want[i + 1 :] or got[i + 1 :] == want[i:]


def one_edit_behind(text: str, end: int, want: str) -> bool:
    """The same for stretches that end at `end`."""
    n = len(want)
    got = text[max(0, end - n - 1) : end][::-1]
    return one_edit_ahead(got, 0, want[::-1])


class Myers:
    """Least edit distance between a pattern and any passage of a text, with one bit per pattern character."""

    def __init__(self, pattern: str):
        self.m = len(pattern)
        self.eq: dict[str, int] = {}
        for i, c in enumerate(pattern):
            self.eq[c] = self.eq.get(c, 0) | 1 << i

    def best(self, text: str) -> tuple[int, int]:
        """(distance, end of the first passage at that distance)."""
        m, mask, top, get = self.m, (1 << self.m) - 1, 1 << (self.m - 1), self.eq.get
        up, down, score = mask, 0, self.m
        best, end = self.m, 0
        for i, c in enumerate(text):
            eq = get(c, 0)
            xv = eq | down
            xh = (((eq & up) + up) ^ up) | eq
            ph = down | ~(xh | up) & mask
            mh = up & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
                if score < best:
                    best, end = score, i + 1
            ph = ph << 1 & mask
            mh = mh << 1 & mask
            up = mh | ~(xv | ph) & mask
            down = ph & xv
        return best, end


def stands_alone(text: str, start: int, end: int) -> bool:
    """Whether text[start:end] neither begins nor ends inside a word."""
    word = lambda i: text[i].isalnum() or text[i] == "_"
    return not (start and word(start - 1) and word(start)) and not (end < len(text) and word(end - 1) and word(end))


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float = RATE, min_chars: int = MIN_CHARS):
        import ahocorasick

        self.items = [(i, t) for i, t in ((i, normal(t)) for i, t in items) if t]
        self.budget = [int(len(t) * rate) if len(t) >= min_chars else 0 for _, t in self.items]
        self.myers: dict[int, Myers] = {}
        self.auto = ahocorasick.Automaton()
        at: dict[str, list[tuple[int, int, str | None, bool]]] = {}
        for k, (_, t) in enumerate(self.items):
            # a short item is one piece without a partner
            for off, p, partner, right in pieces(t, self.budget[k]) if len(t) >= min_chars else [(0, t, None, True)]:
                at.setdefault(p, []).append((k, off, partner, right))
        for p, where in at.items():
            self.auto.add_word(p, (len(p), where))
        if at:
            self.auto.make_automaton()

    def match(self, text: str | None) -> list[tuple[int, int]]:
        """(item id, distance) for each item that occurs in the whole text."""
        if not self.items or not text:
            return []
        t = normal(text)
        hits: dict[int, list[int]] = {}
        short = set()
        for end, (size, where) in self.auto.iter(t):
            for k, off, partner, right in where:
                start = end + 1 - size
                if partner is None:
                    if k not in short and stands_alone(t, start, end + 1):
                        short.add(k)
                elif one_edit_ahead(t, end + 1, partner) if right else one_edit_behind(t, start, partner):
                    hits.setdefault(k, []).append(start - off)
        out = [(self.items[k][0], 0) for k in sorted(short)]
        for k, starts in hits.items():
            item, budget = self.items[k][1], self.budget[k]
            if item in t:
                out.append((self.items[k][0], 0))
                continue
            best = self.verify(k, t, sorted(set(starts)))
            if best <= budget:
                out.append((self.items[k][0], best))
        return out

    def verify(self, k: int, t: str, starts: list[int]) -> int:
        item, budget = self.items[k][1], self.budget[k]
        m = self.myers.get(k) or self.myers.setdefault(k, Myers(item))
        best, lo, hi = len(item), starts[0] - budget, starts[0] + len(item) + budget
        for s in [*starts[1:], None]:
            if s is not None and s - budget <= hi:
                hi = s + len(item) + budget
                continue
            best = min(best, m.best(t[max(0, lo) : hi])[0])
            if s is not None:
                lo, hi = s - budget, s + len(item) + budget
        return best


def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> list[DataFrame]:
    """The items dealt into blocks of about block_bytes of text; usually one."""
    rows = items.selectExpr("cast(item_id as bigint) item_id", "text").where("text is not null")
    total = rows.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    n = -(-int(total) // block_bytes)
    return [rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) if n > 1 else rows for i in range(n)]


def mark(docs: DataFrame, items: DataFrame, rate: float = RATE, into: str = "matches") -> DataFrame:
    """All columns of docs and `into`, array<struct<item_id, distance>> (empty: clean). No shuffle of texts. A column of docs
    named like `into` is an error."""
    if into.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has a column {into}")
    out = docs.withColumn(into, F.array().cast("array<struct<item_id:bigint,distance:int>>"))
    blocks = item_blocks(items)
    before = None
    for k, block in enumerate(blocks):
        out = _mark(out, [(r["item_id"], r["text"]) for r in block.collect()], rate)
        if k + 1 < len(blocks):
            out = settle(out)
            if before is not None:
                discard(before)
            before = out
    return out


def _mark(docs: DataFrame, items: list[tuple[int, str]], rate: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(shared.value, rate)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                found = [[{"item_id": x, "distance": d} for x, d in sorted(m.match(t), key=str)] for t in part.column(at).to_pylist()]
                if any(found):
                    old = part.column(part.num_columns - 1).to_pylist()
                    kind = part.schema.field(part.num_columns - 1).type
                    part = pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([a + f for a, f in zip(old, found)], kind)], schema=part.schema)
                yield part
        give_back()

    return docs.mapInArrow(run, docs.schema)


def contaminated(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, item_id, distance: one row per document and item that occurs in it."""
    marked = mark(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), items, rate)
    return marked.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.item_id", "m.distance")
