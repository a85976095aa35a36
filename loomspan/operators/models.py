"""Scoring blocks of tokens with a model, in batches over many rows.

A model is a function of padded arrays; it is loaded once in a Python worker. Rows of several Arrow batches are gathered
until they hold enough tokens, their blocks are sorted by length, cut into batches whose padded size is bounded, and the
results go back to the places that the blocks came from: which blocks meet in a batch decides speed and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspan.operators.tokenizers import Tokenizer

SCORED = "array<struct<logit:double,probs:array<float>>>"


class BlockModel(Protocol):
    def __call__(self, ids: np.ndarray, mask: np.ndarray, types: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ranking logits, one a block; drop and keep logits, two a token) of blocks padded to one length."""


def batches_by_length(lengths: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Places of the blocks in batches of nearly equal lengths, each of at most `most` tokens with its padding; a longer block
    is a batch of its own."""
    order = np.argsort(lengths, kind="stable")
    start = 0
    for k in range(1, len(order) + 1):
        if k == len(order) or (k + 1 - start) * max(1, lengths[order[k]]) > most:
            yield order[start:k]
            start = k


def pieces_of(ids: pa.Array, heads: pa.Array, most: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """A batch's rows in stretches of about `most` tokens, a longer row by itself."""
    n = np.zeros(len(ids) + 1, np.int64)
    inner = np.append(0, np.cumsum(ids.flatten().value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
    n[1:] = inner[np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]
    start = 0
    while start < len(ids):
        stop = max(start + 1, int(np.searchsorted(n, n[start] + most, "right")) - 1)
        yield ids.slice(start, stop - start), heads.slice(start, stop - start)
        start = stop


class ModelScorer:
    """load: () -> BlockModel, called once in a worker. Blocks begin with `start`, the question and a separator, and end with a
    separator; rows are gathered up to buffer_tokens, batches hold up to batch_tokens with their padding."""

    def __init__(self, load: Callable[[], BlockModel], tokenizer: Tokenizer, *, start: int = 1, separator: int = 2, padding: int = 0, batch_tokens: int = 16_384, buffer_tokens: int = 1 << 18):
        self.load, self.tokenizer = load, tokenizer
        self.start, self.separator, self.padding = start, separator, padding
        self.batch_tokens, self.buffer_tokens = batch_tokens, buffer_tokens

    def blocks(self, ids: Column, head: Column) -> Column:
        """array<struct<logit, probs>> for array<array<int>>, the blocks' ids, whose first `head` ones are no context: the ranking
        logit, and each token's probability to be kept."""
        load, padding, batch_tokens, buffer_tokens = self.load, self.padding, self.batch_tokens, self.buffer_tokens

        def scored(model: BlockModel, rows: list[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            counts = [r.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) for r, _ in rows]
            blocks = [r.flatten() for r, _ in rows]
            lengths = np.concatenate([b.value_lengths().to_numpy(zero_copy_only=False) for b in blocks]).astype(np.int64)
            flat = np.concatenate([b.flatten().to_numpy(zero_copy_only=False) for b in blocks]).astype(np.int64)
            heads = np.concatenate([np.repeat(h.to_numpy(zero_copy_only=False), n) for (_, h), n in zip(rows, counts)])
            begin = np.cumsum(lengths) - lengths
            logits, probs = np.zeros(len(lengths)), np.zeros(len(flat), np.float32)
            for at in batches_by_length(lengths, batch_tokens):
                wide = np.arange(max(1, int(lengths[at].max())))
                mask = wide < lengths[at, None]
                place = np.where(mask, begin[at, None] + wide, 0)
                types = (mask & (wide >= heads[at, None])).astype(np.int64)
                rank, keep = model(np.where(mask, flat[place] if len(flat) else 0, padding), mask.astype(np.int64), types)
                if np.shape(rank) != (len(at),) or np.shape(keep) != (len(at), len(wide), 2):
                    raise ValueError(f"a model gave shapes {np.shape(rank)} and {np.shape(keep)} for {len(at)} blocks of {len(wide)} tokens")
                logits[at] = rank
                shifted = np.exp(keep - np.max(keep, axis=2, keepdims=True))
                probs[place[mask]] = (shifted[..., 1] / shifted.sum(axis=2))[mask]
            first, done = 0, 0
            for n in counts:
                k = int(n.sum())
                size = lengths[first : first + k]
                own = probs[done : done + int(size.sum())]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(own))
                both = pa.StructArray.from_arrays([pa.array(logits[first : first + k]), lists], ["logit", "probs"])
                yield pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), both)
                first, done = first + k, done + len(own)

        @F.arrow_udf(SCORED)
        def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            model = load()
            rows, tokens = [], 0
            for ids, heads in batches:
                # a batch has as many rows as the session says, however long they are: it goes on in pieces of the buffer's size
                for r, h in pieces_of(ids, heads, buffer_tokens):
                    rows.append((r, h))
                    tokens += len(r.flatten().flatten())
                    if tokens >= buffer_tokens:
                        yield from scored(model, rows)
                        rows, tokens = [], 0
            if rows:
                yield from scored(model, rows)

        return run(ids, head)


def overlap_model() -> BlockModel:
    """A model without weights: tokens that the question has are kept, and the more of them, the better the block."""

    def run(ids: np.ndarray, mask: np.ndarray, types: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        asked = (mask == 1) & (types == 0)
        hit = np.zeros(ids.shape, bool)
        for k in range(len(ids)):
            hit[k] = np.isin(ids[k], ids[k][asked[k]]) & (types[k] == 1)
        share = hit.sum(axis=1) / np.maximum(types.sum(axis=1), 1)
        keep = np.where(hit, 2.0, -2.0)
        return 4 * share - 2, np.stack([-keep, keep], axis=2)

    return run
