"""Array and numeric functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use) -> Column:
    """use(value) with the value evaluated once, however often `use` names it."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def scan(items: Column, zero: Column, kind: str, step, follow, state: str = "int") -> Column:
    """array<kind>: step(state, item) for every item in order, the state, a value of type `state`, starting at zero and going
    on as follow(state, result).

    An aggregate copies its whole accumulator, arrays and all, with every item. So the items come in stretches of about the
    square root of their number: one accumulator holds a stretch's results, another the stretches, and n items cost n^1.5
    copies. A result is put away with the item behind it, as `let` would copy the accumulator once more."""
    results, none = f"array<{kind}>", F.lit(None).cast(kind)

    def stretch(state_: Column, part: Column) -> Column:
        start = F.struct(F.struct(state_.alias("state"), none.alias("got")).alias("at"), F.array().cast(results).alias("open"))

        def one(acc: Column, item: Column) -> Column:
            at = acc["at"]["state"]
            now = let(step(at, item).cast(kind), lambda got: F.struct(follow(at, got).cast(state).alias("state"), got.alias("got")))
            return F.struct(now.alias("at"), F.concat(acc["open"], F.array(acc["at"]["got"])).alias("open"))

        # the first result put away is none
        got = lambda a: F.concat(F.slice(a["open"], F.lit(2), F.size(a["open"])), F.array(a["at"]["got"]))
        return F.aggregate(part, start, one, lambda a: F.struct(a["at"]["state"].alias("state"), got(a).alias("open")))

    def all_of(v: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(v))).cast("int")
        start = F.struct(F.struct(zero.cast(state).alias("state"), F.array().cast(results).alias("open")).alias("at"), F.array().cast(f"array<{results}>").alias("done"))
        one = lambda acc, at: F.struct(stretch(acc["at"]["state"], F.slice(v, at + 1, width)).alias("at"), F.concat(acc["done"], F.array(acc["at"]["open"])).alias("done"))
        got = F.aggregate(F.sequence(F.lit(0), F.size(v) - 1, width), start, one, lambda a: F.flatten(F.concat(a["done"], F.array(a["at"]["open"]))))
        return F.when(F.size(v) > 0, got).when(v.isNotNull(), F.array().cast(results))

    return let(items, all_of)


def indices(n: Column) -> Column:
    """0 .. n - 1; empty for n <= 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def norm_relevance(v: Column, n: Column) -> Column:
    """Null: zeros; as long as n: binarised; otherwise a list of indices."""
    flags = F.transform(v, lambda x: (x != 0).cast("int"))
    return F.when(v.isNull(), F.transform(indices(n), lambda i: F.lit(0))).when(F.size(v) == n, flags).otherwise(F.transform(indices(n), lambda i: F.array_contains(v, i).cast("int")))


def mask_to_indices(v: Column, n: Column) -> Column:
    """A 0/1 mask of n entries as indices; anything else is indices already."""
    mask = (F.size(v) == n) & F.forall(v, lambda x: x.isin(0, 1))
    return F.when(mask, F.filter(F.transform(v, lambda x, i: F.when(x == 1, i)), lambda x: x.isNotNull())).otherwise(v)


def to_flags(at: Column, n: Column) -> Column:
    return F.transform(indices(n), lambda i: F.array_contains(at, i).cast("int"))


def parse_indices(c: Column, n: Column) -> Column:
    """Numbers of a text as sorted distinct 0-based indices below n."""
    got = F.transform(F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0)), lambda s: s.try_cast("bigint") - 1)
    return F.array_sort(F.array_distinct(F.filter(got, lambda i: i.isNotNull() & (i >= 0) & (i < n)))).cast("array<int>")


def clip(p: Column) -> Column:
    return F.greatest(F.least(p, F.lit(1.0)), F.lit(0.0))


def mean(v: Column, empty: Column) -> Column:
    """Mean of an array; `empty` for none."""
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(v) > 0, total / F.size(v)).otherwise(empty)


def millionths(x: Column) -> Column:
    """A number in whole millionths, for sums that don't depend on their order."""
    return F.floor(x * 1_000_000 + 0.5).cast("long")


def find(hay: Column, needle: Column) -> Column:
    """First index at which needle occurs in hay, -1 if none or empty."""
    n, m = F.size(hay), F.size(needle)
    hits = F.filter(indices(n - m + 1), lambda i: F.slice(hay, i + 1, m) == needle)
    return F.when(m > 0, F.coalesce(F.get(hits, F.lit(0)), F.lit(-1))).otherwise(F.lit(-1))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def keep_probability(drop: Column, keep: Column) -> Column:
    """Softmax of two logits, the second one's share, shifted by the larger."""
    top = F.greatest(drop, keep)
    return F.exp(keep - top) / (F.exp(drop - top) + F.exp(keep - top))


def chunks(v: Column, step: int) -> Column:
    """Slices of `step` elements."""
    starts = F.when(F.size(v) > 0, F.sequence(F.lit(0), F.size(v) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(v, i + 1, step))


def zip_shortest(a: Column, b: Column) -> Column:
    n = F.least(F.size(a), F.size(b))
    return F.arrays_zip(F.slice(a, F.lit(1), n).alias("a"), F.slice(b, F.lit(1), n).alias("b"))
