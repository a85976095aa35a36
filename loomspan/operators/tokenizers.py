"""Tokenizers with places: ids of a text's tokens and the characters each of them stands for.

tokens(texts) takes an array of texts and returns, for each, array<struct<id, a, b>>: the token's id and its range [a, b) of
characters. CharTokenizer, the default everywhere, is an expression; FileTokenizer reads a vocabulary file of the
`tokenizers` library, whose path is a parameter, once in each Python worker, and works on Arrow batches.

Tokens needn't cover a text (some vocabularies leave blanks out) and may share a character (bytes of one letter). All cuts
are made where a token starts, so that the pieces of a text always put it together again; a character that a cut
would divide goes with the later piece.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspan.functions import text as T
from loomspan.operators.tokens import _range_columns, labels_of

TOKENS = "array<struct<id:int,a:int,b:int>>"
#: Characters handed to a library at a time; bytes of the texts whose tokens are put together at a time.
BATCH_CHARS, CUT_BYTES = 1 << 18, 1 << 21
#: Unicode's white space. A piece is a run of it with what follows; the pieces make up the text.
BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: What a worker remembers of pieces, at most.
KEPT_PIECES, KEPT_CHARS = 600_000, 24 << 20


class Tokenizer(Protocol):
    def tokens(self, texts: Column) -> Column: ...


class CharTokenizer:
    """One token a character, its code point the id."""

    def tokens(self, texts: Column) -> Column:
        one = lambda c, i: F.struct(F.ascii(c).alias("id"), i.alias("a"), (i + 1).alias("b"))
        return F.transform(texts, lambda t: F.transform(T.extract(t, "(?s)."), one).cast(TOKENS))


@lru_cache(maxsize=4)
def _library(path: str):
    """One tokenizer a file in each Python worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _parts(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= BATCH_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def _lists(counts: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


def _encoded(path: str, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The library's token counts of the texts, all their ids, all their ranges."""
    out = [_none()]
    for part in _parts(texts):  # the library's own results are many times as large
        got = _library(path).encode_batch(part, add_special_tokens=False)
        n = np.fromiter(map(len, got), np.int64, len(got))
        ids = np.fromiter(chain.from_iterable(e.ids for e in got), np.int32, int(n.sum()))
        at = np.fromiter(chain.from_iterable(chain.from_iterable(e.offsets for e in got)), np.int32, 2 * int(n.sum()))
        out.append((n, ids, at.reshape(-1, 2)))
    return tuple(map(np.concatenate, zip(*out)))


def _none() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, ids and ranges of no text."""
    return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros((0, 2), np.int32)


@lru_cache(maxsize=4)
def _by_pieces(path: str) -> bool:
    """Whether a vocabulary always cuts in front of a run of white space that follows another character, so that a text's
    tokens are those of its pieces: a byte-level one whose file has nothing that looks further."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    first = told.get("pre_tokenizer") or {}
    alone = all(told.get(k) is None for k in ("normalizer", "post_processor", "truncation", "padding"))
    level = first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space")
    model = told.get("model") or {}
    plain = model.get("type", "BPE") == "BPE" and not model.get("dropout")
    marks = all(not re.search(rf"[{BLANK}]", a["content"]) and not any(a.get(k) for k in ("lstrip", "rstrip", "single_word")) for a in told.get("added_tokens") or [])
    return bool(alone and level and plain and marks)


def _cut(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many pieces each text has, and all pieces. They begin at a text's start and at each blank behind another character,
    which the bytes tell."""
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[: at[-1]]
    blank = ((data >= 0x09) & (data <= 0x0D)) | (data == 0x20)
    if len(data) and data.max() >= 0x80:
        one, two = np.append(data[1:], 0), np.append(data[2:], [0, 0])[: len(data)]
        pairs = (data == 0xC2) & ((one == 0x85) | (one == 0xA0))
        wide = (data == 0xE2) & (one == 0x80) & (((two >= 0x80) & (two <= 0x8A)) | (two == 0xA8) | (two == 0xA9) | (two == 0xAF))
        wide |= ((data == 0xE1) & (one == 0x9A) & (two == 0x80)) | ((data == 0xE2) & (one == 0x81) & (two == 0x9F)) | ((data == 0xE3) & (one == 0x80) & (two == 0x80))
        for i, n in ((np.flatnonzero(pairs), 2), (np.flatnonzero(wide), 3)):
            for k in range(n):
                blank[i + k] = True
    first = blank.copy()
    first[1:] &= ~blank[:-1]
    first[at[:-1][at[1:] > at[:-1]]] = True
    first[: at[0]] = False
    start = np.flatnonzero(first)
    ends = pa.py_buffer(np.append(start, at[-1]).astype(np.int32))
    return np.diff(np.searchsorted(start, at)), pa.StringArray.from_buffers(len(start), ends, texts.buffers()[2])


class _Pieces:
    """Texts encoded by their pieces, each of which the library sees once as long as it is remembered."""

    def __init__(self, path: str):
        self.path = path
        self.forget()

    def forget(self) -> None:
        self.known, self.chars = pa.array([], pa.string()), 0
        self.length, (self.count, self.ids, self.at) = np.zeros(0, np.int64), _none()

    def learn(self, new: pa.Array) -> None:
        n, ids, at = _encoded(self.path, new.to_pylist())
        size = pc.utf8_length(new).to_numpy().astype(np.int64)
        self.known = pa.concat_arrays([self.known, new])
        self.chars += int(size.sum())
        self.length, self.count = np.concatenate([self.length, size]), np.concatenate([self.count, n])
        self.ids, self.at = np.concatenate([self.ids, ids]), np.concatenate([self.at, at])
        self.start = np.cumsum(self.count) - self.count

    def encode(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(self.known) > KEPT_PIECES or self.chars > KEPT_CHARS:
            self.forget()
        m, pieces = _cut(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        if not m.sum():
            return np.zeros(len(texts), np.int64), *_none()[1:]
        told = pieces.dictionary_encode()
        k = pc.index_in(told.dictionary, value_set=self.known)
        unknown = k.is_null().to_numpy(zero_copy_only=False)
        k = k.fill_null(0).to_numpy().astype(np.int64)
        if unknown.any():
            k[unknown] = len(self.known) + np.arange(int(unknown.sum()))
            self.learn(told.dictionary.filter(pa.array(unknown)))
        k = k[told.indices.to_numpy()]
        size, n = self.length[k], self.count[k]
        ends = np.cumsum(m)
        # a piece's place in its text: characters in front of it less those in front of the text
        place = np.append(0, np.cumsum(size))
        place = place[:-1] - np.repeat(place[ends - m], m)
        upto = np.append(0, np.cumsum(n))
        i = np.repeat(self.start[k] - upto[:-1], n) + np.arange(upto[-1])
        return upto[ends] - upto[ends - m], self.ids[i], self.at[i] + np.repeat(place, n).astype(np.int32)[:, None]


@lru_cache(maxsize=4)
def _pieces(path: str) -> _Pieces:
    """One memory of pieces a file in each Python worker."""
    return _Pieces(path)


def _encode(path: str, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For one stretch of the texts after the other: token counts, all ids, all ranges, by pieces where the vocabulary allows it."""
    encode = _pieces(path).encode if _by_pieces(path) else (lambda some: _encoded(path, some.to_pylist()))
    texts = texts.fill_null("")
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    ends = np.flatnonzero(np.diff((at[1:] - at[0]) // CUT_BYTES, append=-1)) + 1
    for i, j in zip(np.append(0, ends), ends):
        yield encode(texts[i:j])


class FileTokenizer:
    """Tokens as the library gives them for a vocabulary file (.json), without special tokens around a text. Where the vocabulary
    allows it, the library is asked for a text's distinct pieces alone."""

    def __init__(self, path: str):
        self.path = path

    def tokens(self, texts: Column) -> Column:
        path = self.path

        @F.arrow_udf(f"array<{TOKENS}>")
        def run(arrays: pa.Array) -> pa.Array:
            n, ids, at = map(np.concatenate, zip(_none(), *_encode(path, arrays.flatten())))
            inner = _lists(n, pa.StructArray.from_arrays([pa.array(ids), pa.array(at[:, 0]), pa.array(at[:, 1])], ["id", "a", "b"]))
            return _lists(arrays.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), inner)

        return run(texts)

    def span_labels(self, text: Column, spans: Column) -> Column:
        """array<int>: a label for each of a text's tokens, that of the span (array<struct<a, b, label>>, in order and apart) any of
        whose characters it stands for, of two spans the first one's; -100 outside of the spans. The same as span_labels() of
        token_ranges() of tokens(), but that tokens never leave the worker."""
        path = self.path

        @F.arrow_udf("array<int>")
        def run(texts: pa.Array, spans: pa.Array) -> pa.Array:
            return _labelled(path, texts, *_range_columns(spans), spans.flatten().field("label"))

        return run(text, spans)

    def sentence_labels(self, text: Column, sentences: Column, labels: Column) -> Column:
        """The same for sentences (array<string>) and a label for each (array<int>), at the places that text_to_spans() finds;
        they are sought in the same worker, which spares a second one."""
        path = self.path

        @F.arrow_udf("array<int>")
        def run(texts: pa.Array, sentences: pa.Array, labels: pa.Array) -> pa.Array:
            upto, spans, which = T.places(texts, sentences)
            return _labelled(path, texts, np.diff(upto), spans[::2], spans[1::2], labels.flatten().take(pa.array(which)))

        return run(text, sentences, labels)


def _labelled(path: str, texts: pa.Array, m: np.ndarray, a: np.ndarray, b: np.ndarray, label: pa.Array) -> pa.Array:
    """The labels of the texts' tokens, one stretch of the texts after the other."""
    label = label.fill_null(0).to_numpy(zero_copy_only=False)
    upto, i, counts, labels = np.append(0, np.cumsum(m)), 0, [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    for n, _, at in _encode(path, texts):
        own, some = m[i : i + len(n)], slice(upto[i], upto[i + len(n)])
        labels.append(labels_of(n, own, *_ranges_of(n, at[:, 0], at[:, 1], own, a[some], b[some]), label[some]))
        counts.append(n)
        i += len(n)
    return _lists(np.concatenate(counts), pa.array(np.concatenate(labels)))


def token_ranges(tokens: Column, spans: Column) -> Column:
    """array<struct<a, b>>: for each range [a, b) of characters (spans, array<struct<a, b>>, in order of their starts) the tokens
    that stand for any of its characters, from the first to behind the last; an empty one where there are none.

    Both go by their places, so the starts are found by counting: token ranges lie in the order of the text.
    """

    @F.arrow_udf("array<struct<a:int,b:int>>")
    def run(tokens: pa.Array, spans: pa.Array) -> pa.Array:
        m, sa, sb = _range_columns(spans)
        first, last = _ranges_of(*_range_columns(tokens), m, sa, sb)
        return _lists(m, pa.StructArray.from_arrays([pa.array(first), pa.array(last)], ["a", "b"]))

    return run(tokens, spans)


def _ranges_of(n: np.ndarray, ta: np.ndarray, tb: np.ndarray, m: np.ndarray, sa: np.ndarray, sb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """token_ranges() of rows of n tokens and m spans, one behind the other."""
    first, last, i, j = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], 0, 0
    for x, y in zip(n, m):
        ends, starts = np.maximum.accumulate(tb[i : i + x]), ta[i : i + x]
        a = np.searchsorted(ends, sa[j : j + y], "right")
        b = np.maximum(a, np.searchsorted(starts, sb[j : j + y], "left"))
        first.append(a.astype(np.int32))
        last.append(np.where(sb[j : j + y] > sa[j : j + y], b, a).astype(np.int32))
        i, j = i + x, j + y
    return np.concatenate(first), np.concatenate(last)
