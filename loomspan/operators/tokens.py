"""Token-level operators: tokens, ranges, labels, pooling, and pruning by token or by chunk.

Functions of columns work inside a row; their cost grows with a row's length, not with its square. Functions of
DataFrames join or group by a key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions import arrays as A
from loomspan.functions import text as T

IGNORED = -100
RANGES = "array<struct<a:int,b:int>>"
POOLINGS = ("mean", "max", "first", "last")


def tokenize(text: Column) -> Column:
    """The default tokenizer: one token a character, its code point the id; nothing for null and empty texts."""
    return F.transform(T.extract(F.coalesce(text, F.lit("")), "(?s)."), F.ascii)


def pieces(length: Column, width: int, step: int | None = None) -> Column:
    """array<struct<i, a, b>>: ranges of `width` characters every `step`, up to the length."""
    step = step or width
    # put together from arrays, as a struct made for each item is several times as dear
    b = lambda i, n: F.transform(i, lambda k: F.least(k * step + width, n))
    zipped = lambda i, n: F.arrays_zip(i.alias("i"), F.transform(i, lambda k: k * step).alias("a"), b(i, n).alias("b"))
    return T.let(length, lambda n: T.let(A.indices(F.ceil(n / step).cast("int")), lambda i: zipped(i, n)))


def running_ranges(lengths: Column, gap: int = 0, offset: int = 0, limit: int | None = None) -> Column:
    """array<struct<a, b>>: where each of several parts lies that follow one another, `gap` tokens between them, from `offset`
    on; cut at `limit`."""
    cut = (lambda x: F.least(x, F.lit(limit))) if limit is not None else (lambda x: x)
    ends = A.scan(lengths, F.lit(offset - gap), "int", lambda at, n: at + gap + n, lambda at, end: end)
    return T.let(ends, lambda e: F.transform(lengths, lambda n, i: F.struct(cut(F.get(e, i) - n).cast("int").alias("a"), cut(F.get(e, i)).cast("int").alias("b"))))


def cumulative_ranges(lengths: Column, limit: int, gap: int = 1) -> Column:
    """array<struct<a, b>>: the boundaries of parts in a joined text, by the lengths of its ever longer starts, cut at `limit`;
    a part reaches from the boundary before it to its own."""
    ends = A.scan(lengths, F.lit(-gap), "int", lambda at, n: at + gap + n, lambda at, end: end)
    return T.let(F.transform(ends, lambda e: F.least(e, F.lit(limit))), lambda e: F.transform(e, lambda b, i: F.struct(F.coalesce(F.get(e, i - 1), F.lit(0)).alias("a"), b.alias("b"))))


def merge_ranges(ranges: Column) -> Column:
    """array<struct<a, b>>: ranges in the order of their starts, merged where one begins at or before the furthest end so far."""
    # mostly ends go up as starts do, and need no running maximum
    b = F.transform(ranges, lambda r: r["b"])
    rising = T.let(b, lambda v: F.forall(A.indices(F.size(v) - 1), lambda i: F.get(v, i) <= F.get(v, i + 1)))
    ends = F.when(rising, b).otherwise(A.scan(ranges, F.lit(-1), "int", lambda furthest, r: F.greatest(furthest, r["b"]), lambda furthest, got: got))

    def islands(end: Column) -> Column:
        first = F.filter(F.transform(ranges, lambda r, i: F.when((i == 0) | (r["a"] > F.get(end, i - 1)), i)), lambda i: i.isNotNull())
        stop = lambda at, k: F.coalesce(F.get(at, k + 1), F.size(ranges)) - 1
        return T.let(first, lambda at: F.transform(at, lambda i, k: F.struct(F.get(ranges, i)["a"].alias("a"), F.get(end, stop(at, k)).alias("b"))))

    return T.let(ends, islands)


def merged_rows(rows: DataFrame, key: str, a: str = "a", b: str = "b") -> DataFrame:
    """The same for one range a row: key, a, b of each island, by windows over the key."""
    order = Window.partitionBy(key).orderBy(a, b)
    before = F.max(b).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("new_", F.coalesce(F.col(a) > before, F.lit(True)).cast("int"))
    marked = marked.withColumn("island_", F.sum("new_").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "island_").agg(F.min(a).alias(a), F.max(b).alias(b)).drop("island_")


def prune_tokens(text: Column, tokens: Column, probs: Column, threshold: float) -> Column:
    """struct<pruned, islands, kept, compression>: the text of the tokens (array<struct<a, b>>) whose probability is above the
    threshold, touching ones merged, pieces joined by one blank; compression is the share of tokens that goes."""
    kept = F.filter(F.transform(tokens, lambda t, i: F.when(F.get(probs, i) > threshold, F.struct(t["a"].cast("int").alias("a"), t["b"].cast("int").alias("b")))), lambda t: t.isNotNull())

    def told(k: Column) -> Column:
        share = F.when(F.size(tokens) > 0, 1.0 - F.size(k) / F.size(tokens)).otherwise(F.lit(0.0))
        pieces_of = lambda m: T.let(T.cut_up(text), lambda parts: F.array_join(F.transform(m, lambda r: T.cut(parts, r["a"], r["b"])), " "))
        return T.let(merge_ranges(k), lambda m: F.struct(pieces_of(m).alias("pruned"), F.size(m).alias("islands"), F.size(k).alias("kept"), share.alias("compression")))

    return T.let(kept, told)


def overlap_join(tokens: DataFrame, chunks: DataFrame, key: str, width: int = 256) -> DataFrame:
    """All pairs of a token (key, i, a, b) and a chunk (key, chunk, c, d) of one key whose ranges [a, b) and [c, d) overlap.

    Ranges meet in stretches of `width` positions that both touch; a pair counts in the first such stretch. Work grows
    with the ranges and their overlaps, not with all pairs of a key; empty ranges overlap nothing.
    """
    def dealt(df: DataFrame, a: str, b: str) -> DataFrame:
        some = df.where(F.col(b) > F.col(a))
        return some.withColumn("at_", F.explode(F.sequence(F.floor(F.col(a) / width), F.floor((F.col(b) - 1) / width))))

    both = dealt(tokens, "a", "b").join(dealt(chunks, "c", "d"), [key, "at_"])
    first = F.greatest(F.floor(F.col("a") / width), F.floor(F.col("c") / width))
    return both.where((F.col("a") < F.col("d")) & (F.col("b") > F.col("c")) & (F.col("at_") == first)).drop("at_")


def chunk_scores(tokens: DataFrame, chunks: DataFrame, key: str, token_threshold: float, chunk_threshold: float) -> DataFrame:
    """key, chunk, score, keep: the mean probability `p` of a chunk's tokens, and whether the share of those above
    token_threshold reaches chunk_threshold; chunks without tokens have 0 and go."""
    met = overlap_join(tokens, chunks, key).groupBy(key, "chunk").agg(F.avg("p").alias("m_"), F.avg((F.col("p") > token_threshold).cast("double")).alias("s_"))
    out = chunks.select(key, "chunk").join(met, [key, "chunk"], "left")
    return out.select(key, "chunk", F.coalesce("m_", F.lit(0.0)).alias("score"), F.coalesce(F.col("s_") >= chunk_threshold, F.lit(False)).alias("keep"))


def chunk_sums(tokens: Column, probs: Column, chunks: Column, threshold: float) -> Column:
    """array<struct<chunk, tokens, index_sum, p_sum, over>>: for every chunk (array<struct<i, a, b>>) how many tokens
    (array<struct<i, a, b>>) overlap it, the sums of their numbers and probabilities, and how many are above the threshold.

    The pairs of overlap_join() inside a row, without making them: those that start in front of a chunk's end less those that
    end in front of its start, by running sums in both orders. Neither tokens nor chunks need an order; empty ranges overlap
    nothing; chunks with one number (of rows put together) are one."""

    @F.arrow_udf("array<struct<chunk:long,tokens:long,index_sum:long,p_sum:double,over:long>>")
    def run(tokens: pa.Array, probs: pa.Array, chunks: pa.Array) -> pa.Array:
        def columns(x: pa.Array) -> tuple[np.ndarray, ...]:
            flat = x.flatten()
            return x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), *(flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("i", "a", "b"))

        n, ti, ta, tb = columns(tokens)
        m, ci, ca, cb = columns(chunks)
        p = probs.flatten().fill_null(0.0).to_numpy(zero_copy_only=False)
        size, parts, at, to = [], [np.zeros(0)], 0, 0
        names, whole = [np.zeros(0, np.int64)], [np.zeros((3, 0), np.int64)]
        for x, y in zip(n, m):
            some = tb[at : at + x] > ta[at : at + x]
            i, a, b, v = (c[at : at + x][some] for c in (ti, ta, tb, p))
            values = (np.ones(len(i), np.int64), i, (v > threshold).astype(np.int64), v.astype(np.longdouble))
            first, last = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
            c, d = ca[to : to + y], cb[to : to + y]
            upto, before = np.searchsorted(a[first], d, "left"), np.searchsorted(b[last], c, "right")
            # a range that ends in front of the chunk starts in front of its end, too
            sums = [np.where(d > c, np.append(0, np.cumsum(w[first]))[upto] - np.append(0, np.cumsum(w[last]))[before], 0) for w in values]
            name, place = np.unique(ci[to : to + y], return_inverse=True)
            got = [np.zeros(len(name), s.dtype) for s in sums]
            for g, s in zip(got, sums):
                np.add.at(g, place, s)
            size.append(len(name))
            names.append(name)
            whole.append(np.stack([g.astype(np.int64) for g in got[:3]]) if len(name) else np.zeros((3, 0), np.int64))
            parts.append(got[3].astype(np.float64))
            at, to = at + x, to + y
        count, index, over = np.concatenate(whole, axis=1)
        values = [np.concatenate(names), count, index, np.concatenate(parts), over]
        flat = pa.StructArray.from_arrays([pa.array(v) for v in values], ["chunk", "tokens", "index_sum", "p_sum", "over"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), flat)

    return run(tokens, probs, chunks)


def chunk_predict(scored: DataFrame, key: str) -> DataFrame:
    """key, kept, compression: how many chunks stay, and the share that goes."""
    return scored.groupBy(key).agg(F.count_if("keep").alias("kept"), (1.0 - F.count_if("keep") / F.count(F.lit(1))).alias("compression"))


def pool(values: Column, mode: str = "mean") -> Column:
    """One value for a sentence's tokens; 0.5 for none; an unknown mode is the mean."""
    some = {"max": F.array_max(values), "first": F.get(values, F.lit(0)), "last": F.get(values, F.size(values) - 1)}.get(mode, A.mean(values, F.lit(0.5)))
    return F.when(F.size(values) > 0, some).otherwise(F.lit(0.5))


def threshold_decisions(probs: Column, threshold: Column) -> Column:
    """struct<by_mean, by_majority>: whether a context stays by the mean of its tokens, or by at least half of them; an empty one
    stays."""
    over = F.size(F.filter(probs, lambda v: v > threshold))
    return F.struct((A.mean(probs, F.lit(1.0)) > threshold).alias("by_mean"), ((F.size(probs) == 0) | (over >= F.size(probs) / 2.0)).alias("by_majority"))


def span_labels(n: Column, spans: Column) -> Column:
    """array<int> of n token labels: -100 outside of the spans (array<struct<a, b, label>>, in order and apart), a span's label
    inside, cut at the end."""

    @F.arrow_udf("array<int>")
    def run(n: pa.Array, spans: pa.Array) -> pa.Array:
        m, a, b = _range_columns(spans)
        size = n.fill_null(0).to_numpy(zero_copy_only=False)
        labels = labels_of(size, m, a, b, spans.flatten().field("label").fill_null(0).to_numpy(zero_copy_only=False))
        return pa.ListArray.from_arrays(_offsets(size), pa.array(labels), mask=spans.is_null())

    return run(n.cast("int"), spans)


def labels_of(n: np.ndarray, m: np.ndarray, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The labels of rows of n tokens and m ranges [a, b) of them, in order, one behind the other. A token that two ranges share
    has the first one's label."""
    before, own = np.repeat(np.cumsum(n) - n, m), np.repeat(n, m)
    a, b = (before + np.clip(x, 0, own) for x in (a, b))
    out = np.full(int(n.sum()), IGNORED, np.int32)
    if len(a):
        a = np.maximum(a, np.append(0, np.maximum.accumulate(b)[:-1]))
        size = np.maximum(b - a, 0)
        out[np.repeat(a - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))] = np.repeat(label, size)
    return out


def touched(tokens: Column, ranges: Column) -> Column:
    """array<boolean>: for each token (array<struct<a, b>>) whether it overlaps one of the ranges (array<struct<a, b>>, in any order).
    Ranges are merged and then found by their ends, so a long text costs no pairs of tokens and ranges."""

    @F.arrow_udf("array<boolean>")
    def run(tokens: pa.Array, ranges: pa.Array) -> pa.Array:
        n, ta, tb = _range_columns(tokens)
        return pa.ListArray.from_arrays(_offsets(n), pa.array(_touched(n, ta, tb, *_range_columns(ranges))))

    return run(tokens, ranges)


def _range_columns(x: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lengths of lists of ranges, and all starts and ends."""
    flat = x.flatten()
    return x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), flat.field("a").to_numpy(zero_copy_only=False), flat.field("b").to_numpy(zero_copy_only=False)


def _offsets(n: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))


def _touched(n: np.ndarray, ta: np.ndarray, tb: np.ndarray, m: np.ndarray, ra: np.ndarray, rb: np.ndarray) -> np.ndarray:
    out, i, j = [np.zeros(0, bool)], 0, 0
    for x, y in zip(n, m):
        a, b = ra[j : j + y], rb[j : j + y]
        a, b = a[b > a], b[b > a]
        order = np.argsort(a, kind="stable")
        a, b = a[order], np.maximum.accumulate(b[order])  # ends that only rise find the first range that reaches behind a token's start
        k = np.searchsorted(b, ta[i : i + x], "right")
        out.append((k < len(b)) & (np.append(a, np.iinfo(np.int64).max)[k] < tb[i : i + x]) & (tb[i : i + x] > ta[i : i + x]))
        i, j = i + x, j + y
    return np.concatenate(out)


def overlap_labels(tokens: Column, relevant: Column, document: Column | None = None) -> Column:
    """array<int>: 1 for tokens (array<struct<a, b>>) that touch a relevant range, 0 for others, -100 for those outside of the
    document's range (struct<a, b>), if one is given."""

    @F.arrow_udf("array<int>")
    def run(tokens: pa.Array, relevant: pa.Array, first: pa.Array, last: pa.Array) -> pa.Array:
        n, ta, tb = _range_columns(tokens)
        hit = _touched(n, ta, tb, *_range_columns(relevant))
        # a bound that is null bounds nothing
        a, b = (np.repeat(x.cast(pa.int64()).fill_null(none).to_numpy(zero_copy_only=False), n) for x, none in ((first, -(1 << 62)), (last, 1 << 62)))
        labels = np.where((ta < a) | (tb > b), IGNORED, hit).astype(np.int32)
        return pa.ListArray.from_arrays(_offsets(n), pa.array(labels), mask=tokens.is_null())

    none = F.lit(None).cast("long")
    bounds = (none, none) if document is None else (document["a"].cast("long"), document["b"].cast("long"))
    return run(tokens, relevant, *bounds)


def block_inputs(query: Column, context: Column, start: int = 1, separator: int = 2) -> Column:
    """struct<input_ids, token_types, a, b>: start, question, separator, context, separator; 0 up to the context, 1 from it on;
    the context's range."""
    head = F.concat(F.array(F.lit(start)), query, F.array(F.lit(separator)))
    tail = F.when(F.size(context) > 0, F.concat(context, F.array(F.lit(separator)))).otherwise(context)
    types = F.concat(F.transform(head, lambda v: F.lit(0)), F.transform(tail, lambda v: F.lit(1)))
    return F.struct(F.concat(head, tail).alias("input_ids"), types.alias("token_types"), F.size(head).alias("a"), (F.size(head) + F.size(context)).alias("b"))


def pad(ids: Column, size: Column, value: int = 0) -> Column:
    """The ids with the value behind them up to `size`; longer ones as they are."""
    return F.concat(ids, F.transform(A.indices(size - F.size(ids)), lambda i: F.lit(value)))


def document_span(ids: Column, token_types: Column | None = None, separator: int = 2, special: tuple[int, ...] = (0, 1, 2)) -> Column:
    """struct<a, b>: the document's tokens. By the token types (from the first to the last 1) where they tell; else behind the
    first separator up to the last one; else all. Special tokens at both ends are left out."""
    n = F.size(ids)
    first = F.array_position(ids, separator).cast("int")
    last = n - F.array_position(F.reverse(ids), separator).cast("int")
    by_mark = F.when((first > 0) & (last > first - 1), F.struct(first.alias("a"), last.alias("b"))).otherwise(F.struct(F.lit(0).alias("a"), n.alias("b")))
    if token_types is not None:
        one = F.array_position(token_types, 1).cast("int")
        end = F.size(token_types) - F.array_position(F.reverse(token_types), 1).cast("int") + 1
        by_mark = F.when(one > 0, F.struct((one - 1).alias("a"), end.alias("b"))).otherwise(by_mark)

    def trim(span: Column) -> Column:
        inside = F.transform(F.slice(ids, span["a"] + 1, F.greatest(span["b"] - span["a"], F.lit(0))), lambda v: ~v.isin(*special))
        lead = F.array_position(inside, True).cast("int") - 1
        back = F.array_position(F.reverse(inside), True).cast("int") - 1
        return F.when(lead >= 0, F.struct((span["a"] + lead).alias("a"), (span["b"] - back).alias("b"))).otherwise(F.struct(span["a"].alias("a"), span["a"].alias("b")))

    return T.let(by_mark, trim)
