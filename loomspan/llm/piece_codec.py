"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding keeps an agenda of adjacent symbol pairs, ordered by piece score, then by position from the left;
the best pair is merged and its neighbours' pairs join the agenda, until no pair makes a piece. Short cuts
keep their agendas as rows of one matrix, so that a batch of them advances together; long ones keep a heap
whose outdated entries are skipped. Characters
outside the vocabulary fall back to byte pieces. Text is cut where no piece of the vocabulary can cross
(in front of blanks, around line ends), which is read from the vocabulary itself; the encoding of each
distinct cut is compared with the sentencepiece library, batch by batch: a difference is an error. Encodings of
short cuts are kept in a cache bounded in entries and bytes.

Null and empty texts encode to the end id alone; repeated rows are encoded row by row; very long texts are cut
like any other, and a cut of any length has its own heap. Empty tables stay empty.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomspan.llm.common import give_back

SPACE = "▁"
LETTER = r"[^\W\d_]"
MIXED = re.compile(rf"{LETTER}(?!{LETTER})[^{SPACE}]|(?!{LETTER})[^{SPACE}]{LETTER}")
CACHE_ENTRIES, CACHE_BYTES = 1_200_000, 64 << 20
#: Longer cuts are not kept.
LONG = 64
WIDE, FAR = 1 << 21, 1 << 40
#: Cuts of at most SHORT characters advance together, ROWS at a time.
SHORT, ROWS = 32, 1024
#: Texts that are encoded together: the more, the fuller the rows of cuts that advance together.
TEXTS = 384


class PieceCodec:
    def __init__(self, path: str, check: bool = True, cache_entries: int = CACHE_ENTRIES):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        lib, n = self.lib, self.lib.get_piece_size()
        self.check, self.cache_entries = check, cache_entries
        usable = [i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.score = {lib.id_to_piece(i): lib.get_score(i) for i in usable}
        self.id = {lib.id_to_piece(i): i for i in usable}
        byte = {lib.id_to_piece(i): i for i in range(n) if lib.is_byte(i)}
        self.byte_id = [byte.get(f"<0x{b:02X}>") for b in range(256)]
        self.eos, self.unk = lib.eos_id(), lib.unk_id()
        if None in self.byte_id:
            raise ValueError("a vocabulary with byte pieces is needed")
        # where pieces can't cross: "x " (blank after another character) and line ends
        crossing = any(SPACE in p.lstrip(SPACE) for p in self.score)
        lines = any("\n" in p and len(p) > 1 for p in self.score)
        mixed = any(MIXED.search(p) for p in self.score)  # a letter beside another character
        self.line_cut = not (crossing or lines)
        words = rf" *{LETTER}+| *[^ \n]+?(?= |\n|{LETTER}|\Z)" if not mixed else r" *[^ \n]+"
        self.cut = re.compile(rf"\n|{words}| +" if self.line_cut else r"(?s).+")
        self.cache: dict[str, str] = {}  # a cut's ids as text
        self.kept = 0
        # pairs of pieces that make a piece: key left * WIDE + right -> (rank of the piece's score, the piece)
        order = {p: r for r, p in enumerate(sorted(self.score, key=lambda p: -self.score[p]))}
        rank = {p: order[p] for p in order}
        by_score: dict[float, int] = {}
        for p in order:  # equal scores share a rank, so that the left one goes first
            rank[p] = by_score.setdefault(self.score[p], order[p])
        pairs = sorted((self.id[p[:k]] * WIDE + self.id[p[k:]], rank[p], self.id[p]) for p in self.score for k in range(1, len(p)) if p[:k] in self.id and p[k:] in self.id)
        self.keys, self.ranks, self.made = (np.array([x[i] for x in pairs] + [(1 << 62, FAR, 0)[i]], np.int64) for i in range(3))

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * WIDE + right
        at = np.searchsorted(self.keys, key)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.ranks[at], FAR), self.made[at]

    def agenda_rows(self, cuts: list[str]) -> list[list[int]]:
        """agenda() for many short cuts at once, as piece ids; a character outside the vocabulary is -2 - code point."""
        width = max(map(len, cuts))
        n, get = len(cuts), self.id.get
        chars = np.frombuffer("".join(c.ljust(width, "\0") for c in cuts).encode("utf-32-le"), np.uint32).reshape(n, width)
        size = np.fromiter(map(len, cuts), np.int64, n)
        found, back = np.unique(chars, return_inverse=True)
        sym = np.array([get(chr(c), -2 - int(c)) for c in found], np.int64)[back.reshape(n, width)]
        sym[np.arange(width) >= size[:, None]] = -1
        rank, made = self.lookup(sym[:, :-1], sym[:, 1:])
        live, done = np.arange(n), [None] * n
        cols = np.arange(width)
        while True:
            best = rank.argmin(1) if rank.shape[1] else np.zeros(len(live), np.int64)
            go = rank[np.arange(len(live)), best] < FAR if rank.shape[1] else np.zeros(len(live), bool)
            for i, row in zip(live[~go].tolist(), sym[~go].tolist()):
                done[i] = [x for x in row if x != -1]
            if not go.any():
                return done
            live, sym, rank, made, best = live[go], sym[go], rank[go], made[go], best[go]
            m, at = len(live), np.arange(len(live))
            sym[at, best] = made[at, best]
            take = np.minimum(cols + (cols > best[:, None]), width - 1)
            sym = np.take_along_axis(sym, take, 1)
            sym[:, -1] = -1
            rank, made = np.take_along_axis(rank, np.minimum(take[:, :-1], width - 2), 1), np.take_along_axis(made, np.minimum(take[:, :-1], width - 2), 1)
            rank[:, -1] = FAR
            for p, ok in ((best, best < width - 1), (best - 1, best > 0)):
                r = at[ok]
                if len(r):
                    q = p[ok]
                    rank[r, q], made[r, q] = self.lookup(sym[r, q], sym[r, q + 1])

    def agenda(self, text: str) -> list[str]:
        """The symbols of one cut after all merges."""
        score = self.score
        sym: list[str | None] = list(text)
        n = len(sym)
        if n == 1:
            return sym
        heap = []
        for i in range(n - 1):
            s = score.get(sym[i] + sym[i + 1])
            if s is not None:
                heap.append((-s, i, i + 1, sym[i] + sym[i + 1]))
        heapq.heapify(heap)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        push, pop = heapq.heappush, heapq.heappop
        while heap:
            _, i, j, joined = pop(heap)
            a, b = sym[i], sym[j]
            if a is None or b is None or nxt[i] != j or len(a) + len(b) != len(joined):
                continue
            sym[i], sym[j] = joined, None
            k = nxt[i] = nxt[j]
            if k < n:
                prv[k] = i
                s = score.get(joined + sym[k])
                if s is not None:
                    push(heap, (-s, i, k, joined + sym[k]))
            p = prv[i]
            if p >= 0:
                s = score.get(sym[p] + joined)
                if s is not None:
                    push(heap, (-s, p, i, sym[p] + joined))
        return [s for s in sym if s is not None]

    def encode_cuts(self, cuts: list[str]) -> list[tuple[int, ...]]:
        out: list = [None] * len(cuts)
        short = sorted((i for i, c in enumerate(cuts) if 1 < len(c) <= SHORT and "\0" not in c), key=lambda i: len(cuts[i]))
        for lo in range(0, len(short), ROWS):
            part = short[lo : lo + ROWS]
            for i, row in zip(part, self.agenda_rows([cuts[i].replace(" ", SPACE) for i in part])):
                if min(row) < 0:
                    row = list(chain.from_iterable([x] if x >= 0 else [self.byte_id[b] for b in chr(-2 - x).encode()] for x in row))
                out[i] = tuple(row)
        return [self.encode_cut(c) if x is None else x for c, x in zip(cuts, out)]

    def encode_cut(self, text: str) -> tuple[int, ...]:
        out: list[int] = []
        get = self.id.get
        for s in self.agenda(text.replace(" ", SPACE)):
            i = get(s)
            if i is None:
                out.extend(self.byte_id[b] for b in s.encode())
            else:
                out.append(i)
        return tuple(out)

    def learn(self, cuts: list[str]) -> dict[str, str]:
        """The cuts' ids as text; those of short cuts are kept."""
        ids = self.encode_cuts(cuts)
        if self.check:
            self.compare(cuts, ids)
        told = dict(zip(cuts, [repr(x)[1:-1].replace(",", "") for x in ids]))
        short = {c: t for c, t in told.items() if len(c) <= LONG}
        self.cache.update(short)
        self.kept += sum(len(c) + len(t) for c, t in short.items())
        return told

    def compare(self, cuts: list[str], ids: list[tuple[int, ...]]) -> None:
        """Against the library: many cuts in one call, with line ends between them where these are isolated; else a cut is a
        whole text."""
        if self.line_cut:
            lines = "\n".join([c for c in cuts if c != "\n"])
            got = self.lib.encode("\n" + lines) if lines else []
            mark = self.byte_id[10]
            want = [*self.encode_cut(" ")] if lines else []
            for c, x in zip(cuts, ids):
                if c != "\n":
                    want.append(mark)
                    want += x
        else:
            want, got = list(map(list, ids)), self.lib.encode([c[1:] for c in cuts])
        if want != got:
            raise RuntimeError("the agenda's encoding differs from the library's")

    def ids(self, texts: list[str]) -> list[tuple[list[int], str]]:
        """For each whole text the ids with the end id, and the same as decimals joined by one blank."""
        cut = [self.cuts(t) for t in texts]
        if len(self.cache) > self.cache_entries or self.kept > CACHE_BYTES:
            self.cache, self.kept = {}, 0
        new = [c for c in set().union(*cut) if c not in self.cache]
        told = self.learn(new) if new else {}
        get, end, out = self.cache.__getitem__, str(self.eos), []
        if any(len(c) > LONG for c in new):
            get = lambda c: told[c] if c in told else self.cache[c]
        for cuts in cut:
            joined = " ".join([*map(get, cuts), end])
            out.append((np.fromstring(joined, np.int32, sep=" ").tolist(), joined))
        return out

    def cuts(self, text: str) -> list[str]:
        return self.cut.findall(" " + text.replace(SPACE, " ")) if text else []

    def encode(self, text: str) -> list[int]:
        return self.ids([text or ""])[0][0]

    def decode(self, ids: list[int]) -> str:
        return self.lib.decode(ids)


@lru_cache(maxsize=1)
def codec_of(model_path: str, check: bool) -> PieceCodec:
    """One codec a Python worker, whose cache the worker's later tasks find filled."""
    return PieceCodec(model_path, check)


def encode_decode(docs: DataFrame, model_path: str, check: bool = True) -> DataFrame:
    """doc_id, ids (with the end id), decoded for each row; null text is empty. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model_path, check)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for i in range(0, len(texts), TEXTS):
                got = [g[0] for g in codec.ids(texts[i : i + TEXTS])]
                yield pa.RecordBatch.from_arrays([b.column(0)[i : i + TEXTS], pa.array(got, pa.list_(pa.int32())), pa.array(codec.lib.decode(got, num_threads=1), pa.string())], ["doc_id", "ids", "decoded"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encode_digest(docs: DataFrame, model_path: str, check: bool = True) -> DataFrame:
    """encode_decode's rows as doc_id, n_tokens, ids_sha256, decoded_sha256, without moving ids to the JVM."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model_path, check)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for i in range(0, len(texts), TEXTS):
                part = texts[i : i + TEXTS]
                got = codec.ids(part)
                decoded = codec.lib.decode([g[0] for g in got], num_threads=1)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[i : i + TEXTS], pa.array([len(g[0]) for g in got], pa.int64()), pa.array([sha(g[1]) for g in got]), pa.array([sha(d) for d in decoded])],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
        give_back()

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
