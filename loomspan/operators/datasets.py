"""Dataset construction: triplets, splits, sampling, mixing, duplicates.

Every random choice is an order by md5(seed : id), so it doesn't depend on partitioning and any engine can
repeat it. Ranks over a whole table come from range counts, not from one sorted partition.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions import arrays as A
from loomspan.functions import text as T
from loomspan.sinks.files import discard, settle


def lot(seed: int, *ids: str) -> Column:
    """The drawing order of a row."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(i).cast("string") for i in ids]))


def ranked(df: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """Global row number from 1 by the given order, in two steps: the rows are dealt by a 12-bit prefix of the first order
    column's hex text (or by its value's quantiles), numbered inside each part, and shifted by the counts before it."""
    first = order[0] if isinstance(order[0], Column) else F.col(order[0])
    part = F.substring(first.cast("string"), 1, 3)
    d = df.withColumn("part_", part)
    counts = d.groupBy("part_").agg(F.count(F.lit(1)).alias("n_"))
    before = counts.withColumn("before_", F.coalesce(F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n_")
    inside = F.row_number().over(Window.partitionBy("part_").orderBy(*order))
    return d.withColumn("in_", inside).join(F.broadcast(before), "part_").withColumn(name, F.col("in_") + F.col("before_")).drop("part_", "in_", "before_")


def ranked_by_lot(df: DataFrame, seed: int, *ids: str, name: str = "rank") -> DataFrame:
    """ranked() by the drawing order; at most 4096 parts, whose counts are a bounded table."""
    return ranked(df.withColumn("lot_", lot(seed, *ids)), "lot_", *ids, name=name).drop("lot_")


def first_by_lot(df: DataFrame, seed: int, n: int, *ids: str) -> DataFrame:
    """The first n rows in drawing order, by the least n of each partition, without ranking the others."""
    return df.withColumn("lot_", lot(seed, *ids)).orderBy("lot_", *ids).limit(n).drop("lot_")


#: From so many rows on a sample is taken by rank, as a limit gathers its rows in one task.
MANY = 100_000


def sample_rows(df: DataFrame, seed: int, n: int, *ids: str) -> DataFrame:
    """n rows by lot, all of them if there are fewer."""
    if n <= 0:
        raise ValueError("n must be positive")
    if n <= MANY:
        return first_by_lot(df, seed, n, *ids)
    return ranked_by_lot(df, seed, *ids, name="rank_").where(F.col("rank_") <= n).drop("rank_")


def shuffle_take(df: DataFrame, seed: int, n: int, *ids: str, name: str = "place") -> DataFrame:
    """The first n rows in drawing order, numbered from 1."""
    few = sample_rows(df, seed, n, *ids)
    return ranked_by_lot(few, seed, *ids, name=name)


def wanted(n_samples: float, rows: int) -> int:
    """A fraction (up to 1) or a number of rows."""
    return max(1, math.ceil(rows * n_samples)) if n_samples <= 1 else int(n_samples)


def split_sizes(rows: int) -> tuple[int, int]:
    """(validation, test): about a hundredth each, the test part of what validation leaves."""
    def size(n: int) -> int:
        return max(0, min(min(max(1, round(n * 0.01)), 5000), (n - 1) // 2))

    v = size(rows)
    return v, size(rows - v)


def carve_splits(df: DataFrame, seed: int, *ids: str) -> DataFrame:
    """Adds split: validation, test or train, by lot."""
    v, t = split_sizes(df.count())
    r = ranked_by_lot(df, seed, *ids, name="rank_")
    return r.withColumn("split", F.when(F.col("rank_") <= v, "validation").when(F.col("rank_") <= v + t, "test").otherwise("train")).drop("rank_")


def upsample(df: DataFrame, factor: float, seed: int, *ids: str) -> DataFrame:
    """int(factor) copies of every row and the fraction's share of rows, by lot, once more; copy number in `copy`."""
    if factor < 1:
        raise ValueError("factor must be at least 1")
    whole, frac = int(factor), factor - int(factor)
    out = df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(whole))))
    if frac > 1e-6:
        n = df.count()
        tail = max(1, min(n, round(frac * n)))
        out = out.unionByName(sample_rows(df, seed, tail, *ids).withColumn("copy", F.lit(whole + 1)))
    return out


def sample_items(df: DataFrame, max_items: int, aligned: list[str], seed: int, row_id: str, labels: str | None = "labels", keep_short: bool = False) -> DataFrame:
    """At most max_items elements of aligned arrays: positives in order first, then others by lot, in the original order again.

    A column is cut where its length equals the reference's in that row. Without labels all items are drawn by
    lot. Rows with fewer than max_items items go unless keep_short.
    """
    ref = F.col(labels or aligned[0])
    n = F.size(ref)
    order = lambda i: F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(row_id).cast("string"), i.cast("string")))
    item = F.transform(A.indices(n), lambda i: F.struct((F.when(F.get(ref, i) == 1, 0).otherwise(1) if labels else F.lit(1)).alias("g"), (F.when(F.get(ref, i) == 1, F.lpad(i.cast("string"), 10, "0")).otherwise(order(i)) if labels else order(i)).alias("o"), i.alias("i")))
    d = df.withColumn("n_", n).withColumn("pick_", F.array_sort(F.transform(F.slice(F.array_sort(item), F.lit(1), F.lit(max_items)), lambda x: x["i"])))
    if not keep_short:
        d = d.where(F.col("n_") >= max_items)
    def cut(c: str) -> Column:
        return F.when(F.size(c) == F.col("n_"), F.transform("pick_", lambda i: F.get(F.col(c), i))).otherwise(F.col(c))

    d = d.withColumns({c: cut(c) for c in aligned})
    return d.drop("n_", "pick_")


#: Stands for rows in front of all others.
FRONT = -(1 << 63)


def text_hashes(texts: str) -> Column:
    """The hashes by which texts are told apart."""
    return F.transform(texts, lambda t: F.unhex(F.md5(t)))


#: Entries (a row and one of its texts) that one task decides about at a time.
AT_ONCE = 1_000_000


def decided_in_order(limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Decides rows of one range of row order, entries (idx, h, m, held, first) sorted by idx, as far as that can be done without
    the ranges in front of it: a text surely counts if a kept row in front has it (`held`, or one of this range), and may
    count if an open row in front has it (`first`, or one left open here)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, kept_texts, open_texts = None, set(), set()
        row, told = [], ([], [])

        def decide() -> None:
            at = row[0][0]
            sure = sum(m for _, h, m, held, _ in row if (held is not None and held < at) or h in kept_texts)
            may = sum(m for _, h, m, held, first in row if first < start or h in open_texts if not ((held is not None and held < at) or h in kept_texts))
            kept = True if sure + may <= limit else False if sure > limit else None
            if kept is not False:
                (kept_texts if kept else open_texts).update(h for _, h, _, _, _ in row)
            told[0].append(at)
            told[1].append(kept)

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(told[0], pa.int64()), pa.array(told[1], pa.bool_())], ["idx", "kept"])
            told[0].clear(), told[1].clear()
            return out

        for b in batches:
            for e in zip(*(c.to_pylist() for c in b.columns)):
                start = e[0] if start is None else start
                if row and row[0][0] != e[0]:
                    decide()
                    row = []
                row.append(e)
            yield flush()
        if row:
            decide()
        yield flush()

    return run


def frequency_filter(rows: DataFrame, limit: int, idx: str = "idx", texts: str = "texts", at_once: int = AT_ONCE, after_round: Callable[[int], None] | None = None, seen: DataFrame | None = None) -> DataFrame:
    """idx, dup_count, kept: in row order, a row's dup_count is how many of its texts (with multiplicity) were seen in kept
    rows before; it is dropped if dup_count > limit. idx: whole numbers, no two alike. seen: text_hashes() of kept rows in
    front of all of these.

    Texts that only one row has are left out from the start. The others' entries are dealt into ranges of row order of about
    at_once entries, and each task goes through its range row by row, deciding what doesn't hang on open rows of the
    ranges in front. Those learn of it in the next round, which is dealt anew from what is still open. The first range is
    always decided whole, so there are at most as many rounds as ranges of the first deal, however long the chains of rows are
    that depend on one another; what fits one range takes one round. after_round is called with the entries still open.
    """
    if limit < 0:
        raise ValueError("limit must not be negative")
    hashed = rows.select(F.col(idx).cast("long").alias("idx"), F.explode(text_hashes(texts)).alias("h")).groupBy("h", "idx").agg(F.count(F.lit(1)).alias("m"))
    several = hashed.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    if seen is None:
        several = several.where("n > 1").select("h", F.lit(None).cast("bigint").alias("held"))
    else:
        before = seen.select("h").distinct().withColumn("held", F.lit(FRONT))
        several = several.join(before, "h", "left").where("n > 1 or held is not null").select("h", "held")
    # held: the least kept row that has the text
    shared = settle(hashed.join(several, "h").select("idx", "h", "m", "held"))
    open_ = shared
    told, before = [], None
    while left := open_.count():
        first = open_.groupBy("h").agg(F.min("idx").alias("first"))
        both, ranges = open_.join(first, "h").select("idx", "h", "m", "held", "first"), -(-left // at_once)
        dealt = both.repartitionByRange(ranges, "idx") if ranges > 1 else both.repartition(1)
        done = settle(dealt.sortWithinPartitions("idx").mapInArrow(decided_in_order(limit), "idx long, kept boolean"))
        told.append(done)
        marked = open_.join(done, "idx")
        new = marked.where("kept").groupBy("h").agg(F.min("idx").alias("new"))
        rest = marked.where("kept is null").join(new, "h", "left")
        last, open_ = before, settle(rest.select("idx", "h", "m", F.least("held", "new").alias("held")))
        before = open_
        if last is not None:
            discard(last)
        if after_round:
            after_round(open_.count())
    if before is not None:
        discard(before)
    decided = reduce(DataFrame.union, [t.where("kept is not null") for t in told]) if told else shared.select("idx").withColumn("kept", F.lit(True)).limit(0)
    if len(told) > 1:
        decided = settle(decided)
        discard(*told)
    held = shared.join(decided.where("kept").select("idx"), "idx", "left_semi").groupBy("h").agg(F.min("idx").alias("own"))
    met = shared.join(held, "h", "left").where(F.least("held", "own") < F.col("idx"))
    counts = met.groupBy("idx").agg(F.sum("m").alias("dup_count"))
    out = rows.select(F.col(idx).alias("idx")).join(decided, "idx", "left").join(counts, "idx", "left")
    return out.select("idx", F.coalesce("dup_count", F.lit(0)).cast("long").alias("dup_count"), F.coalesce("kept", F.lit(True)).alias("kept"))


def dup_histogram(decided: DataFrame) -> DataFrame:
    """dup_count, total, kept, removed."""
    return decided.groupBy("dup_count").agg(F.count(F.lit(1)).alias("total"), F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("removed"))


def duplicate_stats(texts: DataFrame, text: str = "text") -> DataFrame:
    """One row: total, n_unique, duplicates and their ratio (0 without texts)."""
    g = texts.where(F.col(text).isNotNull()).groupBy(F.md5(text).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    s = g.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("n_unique"))
    d = s.withColumn("duplicates", F.col("total") - F.col("n_unique"))
    return d.withColumn("ratio", F.coalesce(F.try_divide("duplicates", "total"), F.lit(0.0)))


def extract_fields(df: DataFrame, *keep: str) -> DataFrame:
    """The kept columns, query, positive and negatives of a triplet table. query: first filled of query/question/prompt;
    positive: of answer/positive/pos/target; negatives: all columns that start with neg, in the order of their names, empty
    ones dropped. A column of string arrays counts as its filled texts joined by blanks. Rows without query or positive are
    an error."""
    def text(c: str) -> Column:
        listed = df.schema[c].dataType.typeName() == "array"
        return F.nullif(F.array_join(F.filter(F.col(c), lambda x: x != ""), " ") if listed else F.col(c), F.lit(""))

    def pick(names: tuple[str, ...], what: str) -> Column:
        found = F.coalesce(*[text(c) for c in names if c in df.columns], F.lit(None).cast("string"))
        return F.when(found.isNull(), F.raise_error(F.lit(f"empty {what}")).cast("string")).otherwise(found)

    negs = sorted(c for c in df.columns if c.startswith("neg"))
    negatives = F.array_compact(F.array(*[text(c) for c in negs])) if negs else F.array().cast("array<string>")
    return df.select(*keep, pick(QUERY_NAMES, "query").alias("query"), pick(POSITIVE_NAMES, "positive").alias("positive"), negatives.alias("negatives"))


# The columns that hold a question or a positive text, in the order in which they are looked for.
QUERY_NAMES = ("query", "question", "prompt")
POSITIVE_NAMES = ("answer", "positive", "pos", "target")


def slug(name: str, subset: str | None = None) -> str:
    """A dataset's name as part of ids and folder names."""
    base = name.replace("/", "_")
    return f"{base}_{subset}" if subset else base


def build_records(fields: DataFrame, dataset: str, split: str, number: str, splitter=T.split_generic) -> DataFrame:
    """id (dataset:split:number), query, texts (the positive one first), labels, context_spans ([start, end) of each text's
    sentences) from extract_fields' columns."""
    texts = F.concat(F.array("positive"), "negatives")
    labels = F.concat(F.array(F.lit(1)), F.transform("negatives", lambda x: F.lit(0)))
    spans = F.transform(texts, lambda t: T.text_to_spans_inside(t, splitter(t)))
    return fields.select(F.concat_ws(":", F.lit(slug(dataset)), F.lit(split), F.col(number).cast("string")).alias("id"), "query", texts.alias("texts"), labels.alias("labels"), spans.alias("context_spans"))


def long_groups(rows: DataFrame, key: str, text: Column, most: int) -> DataFrame:
    """key, longest (characters of the longest stripped text), too_long."""
    return rows.groupBy(key).agg(F.max(F.length(T.strip(text))).cast("long").alias("longest")).withColumn("too_long", F.col("longest") > most)


def score_stats(rows: DataFrame, scores: str, order: str | None = None, first: int | None = None) -> DataFrame:
    """One row: mean, std (of the population), least, most and n of all numbers in an array column; with `first` those of the
    first rows by `order`, a smoke check."""
    some = rows.orderBy(order).limit(first) if first is not None else rows
    x = some.select(F.explode(scores).alias("x")).select(F.col("x").cast("double").alias("x"))
    return x.agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("least"), F.max("x").alias("most"), F.count(F.lit(1)).alias("n"))


def item_means(relevance: Column) -> Column:
    """The mean of each item's relevance flags; 0 for an item without any."""
    return F.transform(relevance, lambda v: A.mean(F.transform(v, lambda x: x.cast("double")), F.lit(0.0)))


def filter_items(df: DataFrame, relevance: str, max_items: int, aligned: list[str], reverse: bool = False, keep_first: bool = False) -> DataFrame:
    """Items without any relevant span go; of the others the max_items of the largest mean relevance stay (of the least, if
    reverse; ties: the earlier), in their order; with keep_first the first item always stays. Columns of `aligned` are cut
    alike where they are as long as the relevance. Rows that are left with fewer than max_items items go; rows without
    relevance are as they were, and go."""
    rel = F.col(relevance)
    sign = 1.0 if reverse else -1.0
    item = F.transform(rel, lambda v, i: F.struct((A.mean(F.transform(v, lambda x: x.cast("double")), F.lit(0.0)) * sign).alias("o"), i.alias("i"), F.exists(v, lambda x: x != 0).alias("some")))
    own = F.filter(item, lambda x: x["some"] & (x["i"] > 0 if keep_first else F.lit(True)))
    slots = max_items - 1 if keep_first else max_items
    top = F.transform(F.slice(F.array_sort(F.transform(own, lambda x: F.struct(x["o"].alias("o"), x["i"].alias("i")))), F.lit(1), F.lit(max(0, slots))), lambda x: x["i"])
    pick = F.array_sort(F.concat(F.array(F.lit(0)), top) if keep_first else top)
    d = df.withColumn("pick_", pick).withColumn("n_", F.size(rel)).where(F.coalesce(F.size("pick_") >= max_items, F.lit(False)))
    cut = lambda c: F.when(F.size(c) == F.col("n_"), F.transform("pick_", lambda i: F.get(F.col(c), i))).otherwise(F.col(c))
    return d.withColumns({c: cut(c) for c in dict.fromkeys([*aligned, relevance])}).drop("pick_", "n_")


def flatten_pairs(df: DataFrame, key: str, labels: str, scores: str | None = None) -> DataFrame:
    """One row a pair: key, doc_index, target (the teacher's score where there is one, else the label), docs_per_query. Rows with
    neither are an error."""
    target = F.coalesce(F.col(scores), F.col(labels)) if scores else F.col(labels)
    checked = F.when(target.isNull(), F.raise_error(F.lit("neither scores nor labels")).cast("array<double>")).otherwise(target.cast("array<double>"))
    flat = df.select(key, F.size(checked).cast("long").alias("docs_per_query"), F.posexplode(checked).alias("i", "target"))
    return flat.select(key, F.col("i").cast("long").alias("doc_index"), "target", "docs_per_query")


def mix(parts: list[DataFrame], first: tuple[str, ...] = ("id", "text")) -> DataFrame:
    """Bag union over the common columns of several datasets, `first` in front, the others by name."""
    return reduce(DataFrame.unionByName, [only(p, common_columns(parts, first)) for p in parts])


def only(df: DataFrame, columns: list[str]) -> DataFrame:
    """These columns, whatever characters their names have."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def common_columns(parts: list[DataFrame], first: tuple[str, ...] = ()) -> list[str]:
    shared = set.intersection(*[set(p.columns) for p in parts])
    return [c for c in first if c in shared] + sorted(shared - set(first))


def reference_column(df: DataFrame) -> str | None:
    """The array column whose length counts a row's items where there are no labels: a usual one, else the first of any."""
    lists = [f.name for f in df.schema.fields if f.dataType.typeName() == "array"]
    return next((c for c in ITEM_COLUMNS if c in df.columns), lists[0] if lists else None)


def sample_any_items(df: DataFrame, max_items: int, seed: int, row_id: str) -> DataFrame:
    """sample_items() over all array columns, by labels if there are any, else by the reference column; without one the rows
    stay as they are."""
    lists = [f.name for f in df.schema.fields if f.dataType.typeName() == "array"]
    if "labels" in lists:
        return sample_items(df, max_items, lists, seed, row_id, "labels")
    one = reference_column(df)
    return df if one is None else sample_items(df, max_items, [one, *[c for c in lists if c != one]], seed, row_id, None)


def validation_split(df: DataFrame, size: float, seed: int, *ids: str) -> DataFrame:
    """Adds `validation`: a share of the rows (below 1), or a number of them (from 1 to all but one), by lot."""
    n = df.count()
    if not 0 < size < max(n, 1):
        raise ValueError(f"a validation split is a share between 0 and 1 or a number from 1 to {n - 1}")
    most = int(n * size) if size < 1 else int(size)
    return ranked_by_lot(df, seed, *ids, name="rank_").withColumn("validation", F.col("rank_") <= most).drop("rank_")


# Array columns that count items, and the columns that come first in a training mix.
ITEM_COLUMNS = ("texts", "context_spans", "context", "passages")
MIX_COLUMNS = ("query", "positive", "negative", "teacher_score", "context_spans", "context_spans_relevance")


@dataclass(frozen=True)
class Part:
    """One dataset of a training mix: its rows, its validation rows, and what is done to them."""

    train: DataFrame
    validation: DataFrame | None = None
    ids: tuple[str, ...] = ("id",)
    teacher_column: str | None = None
    upsample: float | None = None
    n_samples: float | None = None
    items: int | None = None  # goes before the mix's own


def prepare(
    parts: list[Part],
    seed: int = 42,
    items: int | None = None,
    relevant_items: int | None = None,
    relevance: str = "context_spans_relevance",
    reverse: bool = False,
    keep_first: bool = False,
    validation: float | None = None,
    max_train: int | None = None,
    max_validation: int | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """(training rows, validation rows) of several datasets, each through the same steps: items without relevance out, items
    sampled, the teacher's column renamed, rows upsampled, rows sampled; then the union over their common columns.
    Validation rows aren't upsampled, are sampled in the same proportion, and a validation set that lacks a common column is
    left out. Without any, `validation` carves one from the training rows. max_train and max_validation keep the first rows
    by lot. A column `copy` tells upsampled copies apart."""
    train, held = [], []
    for part in parts:
        ratio = 1.0
        for rows, is_train in ((part.train, True), (part.validation, False)):
            if rows is None:
                continue
            if relevant_items is not None:
                lists = [f.name for f in rows.schema.fields if f.dataType.typeName() == "array"]
                rows = filter_items(rows, relevance, relevant_items, lists, reverse, keep_first)
            if (most := part.items if part.items is not None else items) is not None:
                rows = sample_any_items(rows, most, seed, part.ids[0])
            if part.teacher_column and part.teacher_column != "teacher_score" and part.teacher_column in rows.columns:
                rows = rows.withColumnRenamed(part.teacher_column, "teacher_score")
            ids = part.ids
            if is_train:
                rows = upsample(rows, part.upsample, seed, *ids) if part.upsample is not None else rows.withColumn("copy", F.lit(1))
                ids = (*ids, "copy")
            if part.n_samples is not None:
                if part.n_samples <= 0:
                    raise ValueError("n_samples must be greater than 0")
                n = rows.count()
                keep = min(n, wanted(part.n_samples, n)) if is_train else min(n, max(1, math.ceil(n * ratio)))
                ratio = keep / n if is_train and n else ratio
                rows = sample_rows(rows, seed, max(1, keep), *ids)
            (train if is_train else held).append(rows if is_train else rows.withColumn("copy", F.lit(1)))
    columns = common_columns(train, MIX_COLUMNS) if len(train) > 1 else train[0].columns
    out = reduce(DataFrame.unionByName, [only(t, columns) for t in train])
    held = [only(h, columns) for h in held if set(columns) <= set(h.columns)]
    val = reduce(DataFrame.unionByName, held) if held else None
    keys = [c for c in (*parts[0].ids, "copy") if c in columns]
    if val is None and validation is not None:
        marked = validation_split(out, validation, seed, *keys)
        out, val = marked.where("not validation").drop("validation"), marked.where("validation").drop("validation")
    if max_train is not None:
        out = sample_rows(out, seed, max_train, *keys)
    if val is not None and max_validation is not None:
        val = sample_rows(val, seed, max_validation, *keys)
    return out, val


def step_schedule(total_steps: int) -> tuple[int, int]:
    """(steps between evaluations, steps between log lines) of a training run."""
    return max(1, total_steps // 20), max(1, total_steps // 100)


def attach_by_id(rows: DataFrame, values: DataFrame, key: str, value: str, spans: str | None = None) -> DataFrame:
    """rows and `value`, an array of values' rows of the same key; where there is none, or an empty one, one empty array for
    each of the row's spans, or an empty array without them. A key of values has one row at most."""
    kind = values.schema[value].dataType.simpleString()
    none = F.array().cast(kind)
    if spans is not None:
        none = F.transform(F.coalesce(F.col(spans), F.array()), lambda s: F.array().cast(kind.removeprefix("array<")[:-1]))
    met = rows.join(values.select(key, value), key, "left")
    return met.withColumn(value, F.when(F.size(value) > 0, F.col(value)).otherwise(none))


def asked(rows: DataFrame, query: str = "query", texts: str | None = None, blank: bool = False) -> DataFrame:
    """Rows with a question (blank=False: a null one is none; True: neither is a blank one) and, if texts names an array, with one
    text at least."""
    q = F.col(query)
    out = rows.where(T.strip(q) != "") if blank else rows.where(q.isNotNull())
    return out if texts is None else out.where(F.size(texts) > 0)


def unnest_passages(rows: DataFrame, positives: str = "positive_passages", negatives: str = "negative_passages", *keep: str) -> DataFrame:
    """keep, label, place and the passage's fields: one row a passage, positives (label 1) in their order, then negatives (0)."""
    def side(column: str, label: int) -> Column:
        return F.transform(F.coalesce(F.col(column), F.array()), lambda p, i: F.struct(F.lit(label).alias("label"), i.alias("place"), p.alias("p")))

    both = F.concat(side(positives, 1), side(negatives, 0))
    return rows.select(*keep, F.inline(both)).select(*keep, "label", "place", "p.*")


def rows_of_query(rows: DataFrame, key: str, order: str, *values: str, into: str = "rows") -> DataFrame:
    """key, n, into: a question's rows as one array of structs (order, values), in their order. All rows of a question meet in
    one value by definition; values ought to be narrow."""
    g = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *values))).alias(into))
    return g.select(key, F.size(into).cast("long").alias("n"), into)


def moving_average(rows: DataFrame, key: str, order: str, value: Column, last: int = 10, into: str = "mean", total: int | None = None) -> DataFrame:
    """rows and `into`, the mean of the last `last` values of a key up to each row; with `total`, the number of steps in all, also
    `eta`: that mean for each step still to come."""
    w = Window.partitionBy(key).orderBy(order)
    out = rows.withColumn(into, F.avg(value).over(w.rowsBetween(1 - last, 0)))
    return out if total is None else out.withColumn("eta", F.col(into) * F.greatest(F.lit(total) - F.row_number().over(w), F.lit(0)))
