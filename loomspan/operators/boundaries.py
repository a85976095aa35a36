"""Sentence boundaries learned from a corpus without labels, after Kiss and Strunk (Unsupervised Multilingual Sentence
Boundary Detection, Computational Linguistics 32, 2006).

Three lists are estimated from counts over all texts:

* abbreviations: types that nearly always have a period, are short and, inside, full of periods. The log-likelihood
  ratio of "period with probability 0.99" against "period as often as anywhere" is scaled by e to the number of letters
  (downwards), by the number of periods, and by the letters to the power of the occurrences without a period (downwards).
* collocations: an abbreviation, initial or number with period, and the type behind it, which occur together more often
  than by chance: no boundary between them.
* sentence starters: types that stand behind periods of no abbreviation more often than by chance.

The counts are Spark aggregates, pre-aggregated in each task. split_learned() meets all entries of a lexicon, however many, by
joins: periods between two pieces are rows, those behind no listed type, initial or number are left out at once, and only the
places of periods that end no sentence come back to their texts. learned_splitter() makes an expression of the lists, for callers
that need one and a lexicon that fits the driver. A period behind an abbreviation ends a sentence only if a sentence starter with a
capital follows; one behind an initial or a number only if no lower-case letter follows; one inside a collocation never; any other
always does.

Null and empty texts count nothing; repeated rows count each time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.functions import arrays as A
from loomspan.functions import text as T
from loomspan.functions.splitters import Splitter
from loomspan.operators.prune import staged
from loomspan.sinks.files import settle

#: A token: letters and digits with points, apostrophes and hyphens between them, and a period behind.
TOKEN = r"[\p{L}\p{N}]+(?:[.'’-][\p{L}\p{N}]+)*\.?"
NUMBER = r"\A\p{N}+(?:[.,:-]\p{N}+)*\z"
INITIAL = r"\A\p{L}\z"
ANY_NUMBER = "##"

# The published method's limits.
ABBREVIATION, COLLOCATION, STARTER = 0.3, 7.88, 30.0
PERIOD_OF_ABBREVIATION = 0.99


def token_type(token: Column) -> Column:
    """Lower case, without the period; all numbers alike."""
    bare = F.lower(F.regexp_replace(token, r"\.\z", ""))
    return F.when(bare.rlike(NUMBER), F.lit(ANY_NUMBER)).otherwise(bare)


def token_pairs(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row a token: type, dot (has a period), next (the next token's type in its text, null for the last)."""
    words = staged(docs.select(text), w_=T.extract(F.coalesce(F.col(text), F.lit("")), TOKEN)).select("w_")
    words = staged(words, t_=F.transform("w_", token_type))
    rows = F.transform("t_", lambda t, i: F.struct(t.alias("type"), F.endswith(F.get(F.col("w_"), i), F.lit(".")).alias("dot"), F.get(F.col("t_"), i + 1).alias("next")))
    return words.select(F.inline(rows))


def log_likelihood(k: Column, n: Column, p: Column) -> Column:
    """Of k hits in n trials of probability p, without the constant; an impossible probability counts as a tiny one."""
    inside = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    return k * F.log(inside) + (n - k) * F.log(1 - inside)


def abbreviation_score(dotted: Column, plain: Column, periods: Column, total: Column, kind: Column) -> Column:
    n = dotted + plain
    ratio = -2 * (log_likelihood(dotted, n, periods / total) - log_likelihood(dotted, n, F.lit(PERIOD_OF_ABBREVIATION)))
    points = F.length(kind) - F.length(F.replace(kind, F.lit("."), F.lit("")))
    letters = F.length(kind) - points
    return ratio * F.exp(-letters) * (points + 1) * F.pow(letters, -plain)


def together_score(both: Column, first: Column, second: Column, total: Column) -> Column:
    """Log-likelihood ratio of "second as often behind first as anywhere" against "as often as it is"."""
    p, p1, p2 = second / total, both / first, (second - both) / F.greatest(total - first, F.lit(1))
    same = log_likelihood(both, first, p) + log_likelihood(second - both, total - first, p)
    apart = log_likelihood(both, first, p1) + log_likelihood(second - both, total - first, p2)
    return -2 * (same - apart)


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """type, next, dotted, plain: how often each type stands in front of each next type with and without a period; `next` is
    only told behind a period."""
    pairs = token_pairs(docs, text).withColumn("next", F.when(F.col("dot"), F.col("next")))
    return pairs.groupBy("type", "next").agg(F.count_if("dot").alias("dotted"), F.count_if(~F.col("dot")).alias("plain"))


def lexicon(docs: DataFrame, text: str = "text") -> DataFrame:
    """kind (abbreviation, collocation, starter), type, next (of collocations), score, n (occurrences): every entry over its
    limit. Numbers are neither abbreviations nor starters."""
    pairs = settle(counts(docs, text))
    types = pairs.groupBy("type").agg(F.sum("dotted").alias("dotted"), F.sum("plain").alias("plain"))
    types = types.withColumn("n", F.col("dotted") + F.col("plain"))
    sums = types.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum("dotted"), F.lit(0)).alias("periods")).first()
    total, periods = F.lit(max(1, int(sums["total"]))), F.lit(int(sums["periods"]))
    scored = types.where((F.col("dotted") > 0) & (F.col("type") != ANY_NUMBER) & ~F.col("type").rlike(NUMBER))
    score = abbreviation_score(F.col("dotted"), F.col("plain"), periods, total, F.col("type"))
    short = settle(scored.select("type", score.alias("score"), "n").where(F.col("score") >= ABBREVIATION))
    out = short.select(F.lit("abbreviation").alias("kind"), "type", F.lit(None).cast("string").alias("next"), "score", "n")

    behind = pairs.where("dotted > 0 and next is not null").join(short.select("type", F.lit(True).alias("short")), "type", "left")
    held = F.coalesce("short", F.lit(False)) | F.col("type").rlike(INITIAL) | (F.col("type") == ANY_NUMBER)
    first = types.select("type", F.col("n").alias("n_first"))
    second = types.select(F.col("type").alias("next"), F.col("n").alias("n_second"))
    both = behind.where(held).select("type", "next", F.col("dotted").alias("n")).join(first, "type").join(second, "next")
    both = both.where((F.col("n") > 1) & (F.col("n") * total > F.col("n_first") * F.col("n_second")))
    met = together_score(F.col("n"), F.col("n_first"), F.col("n_second"), total)
    out = out.unionByName(both.select(F.lit("collocation").alias("kind"), "type", "next", met.alias("score"), "n").where(F.col("score") >= COLLOCATION))

    ends = behind.where(~held).groupBy("next").agg(F.sum("dotted").alias("n")).join(second, "next").where(F.col("next") != ANY_NUMBER)
    breaks = behind.where(~held).agg(F.coalesce(F.sum("dotted"), F.lit(0)).alias("n")).first()["n"]
    starts = together_score(F.col("n"), F.lit(max(1, int(breaks))), F.col("n_second"), total)
    often = F.col("n") * total > F.lit(int(breaks)) * F.col("n_second")
    return out.unionByName(ends.where(often).select(F.lit("starter").alias("kind"), F.col("next").alias("type"), F.lit(None).cast("string").alias("next"), starts.alias("score"), "n").where(F.col("score") >= STARTER))


@dataclass(frozen=True)
class Boundaries:
    """The lists that a splitter goes by: types, and collocations as "type next"."""

    abbreviations: frozenset[str] = frozenset()
    collocations: frozenset[str] = frozenset()
    starters: frozenset[str] = frozenset()


def boundaries(entries: DataFrame, most: int | None = None) -> Boundaries:
    """All entries of lexicon()'s rows, gathered by the driver; on demand only the `most` of each kind with the highest scores."""
    def best(kind: str, name: Column) -> frozenset[str]:
        rows = entries.where(F.col("kind") == kind).select(name.alias("name"), "score")
        rows = rows if most is None else rows.orderBy(F.desc("score"), "name").limit(most)
        return frozenset(r["name"] for r in rows.collect())

    return Boundaries(best("abbreviation", F.col("type")), best("collocation", F.concat_ws(" ", "type", "next")), best("starter", F.col("type")))


def meetings(pieces: Column) -> Column:
    """array<struct<type, next, capital, small>>: for each piece of a text that end in marks and white space the types around the
    period in front of it, and how it begins; null where no token with a period and none behind it meet."""
    # a token begins where no letter or digit stands in front: without that, every place of every word is tried
    last = F.transform(pieces, lambda s: F.regexp_extract(s, rf"(?<![\p{{L}}\p{{N}}])({TOKEN}){T.SPACE}*\z", 1))
    head = F.transform(pieces, lambda s: F.regexp_extract(s, rf"\A[\"'(\[]*({TOKEN})", 1))

    def meeting(token: Column, following: Column) -> Column:
        told = F.struct(token_type(token).alias("type"), token_type(following).alias("next"), following.rlike(r"\A\p{Lu}").alias("capital"), following.rlike(r"\A\p{Ll}").alias("small"))
        return F.when(F.endswith(token, F.lit(".")) & (following != ""), told)

    # the first piece has nothing in front of it: get() is null there
    return T.let(last, lambda x: T.let(head, lambda y: F.transform(y, lambda h, i: meeting(F.get(x, i - 1), h))))


def open_end(m: Column) -> Column:
    """Behind an initial or a number a sentence may end, but none begins with a small letter."""
    return (m["type"].rlike(INITIAL) | (m["type"] == ANY_NUMBER)) & m["small"]


def places(flags: Column) -> Column:
    """The places, from 0, of those that are true."""
    return F.filter(F.transform(flags, lambda x, i: F.when(x, i)), lambda i: i.isNotNull())


def together(pieces: Column, held: Column) -> Column:
    """The pieces, those at the places `held` put behind the ones in front of them."""
    first = F.array_except(A.indices(F.size(pieces)), held)
    return T.let(first, lambda at: F.transform(at, lambda i, k: F.array_join(F.slice(pieces, i + 1, F.coalesce(F.get(at, k + 1), F.size(pieces)) - i), "")))


def joined(pieces: Column, known: Boundaries) -> Column:
    """Pieces of a text that end in marks and white space, put together where the period between two of them ends no
    sentence."""
    is_in = lambda c, names: c.isin(*sorted(names)) if names else F.lit(False)

    def held(m: Column) -> Column:
        short = is_in(m["type"], known.abbreviations) & ~(m["capital"] & is_in(m["next"], known.starters))
        return m.isNotNull() & (short | open_end(m) | is_in(F.concat(m["type"], F.lit(" "), m["next"]), known.collocations))

    return T.let(meetings(pieces), lambda m: together(pieces, places(F.transform(m, held))))


def split_learned(docs: DataFrame, entries: DataFrame, text: str = "text", name: str = "sentences", marks: str = "", limit: int = T.OVERLONG) -> DataFrame:
    """docs with sentences in the place of their text, those that learned_splitter() makes of all entries of a lexicon; null texts
    count as empty. Nothing is gathered: the lexicon is joined, so it may be of any size, and rows need no key. On disk the text
    lies once, as pieces."""
    entries, pattern, rest = settle(entries), T.sentence_pattern(marks), [c for c in docs.columns if c != text]
    blocks = T.trimmed_blocks(F.coalesce(F.col(text), F.lit("")))
    d = settle(docs.select(*rest, F.transform(blocks, lambda b: T.extract(b, pattern)).alias("b_"), F.monotonically_increasing_id().alias("id_")))

    flat = staged(d.select("id_", "b_"), p_=F.flatten("b_"), new_=F.flatten(F.transform("b_", lambda b: F.transform(b, lambda s, i: i == 0))))
    flat = staged(flat.select("id_", "p_", "new_"), m_=meetings(F.col("p_")))
    rows = F.transform("m_", lambda m, i: F.when(m.isNotNull() & ~F.get(F.col("new_"), i), F.struct(i.alias("at"), m["type"].alias("type"), m["next"].alias("next"), m["capital"].alias("capital"), open_end(m).alias("open"))))
    met = flat.select("id_", F.inline(F.filter(rows, lambda r: r.isNotNull())))

    of = lambda kind: entries.where(F.col("kind") == kind)
    # what can be held at all: that stands behind a type of an abbreviation or a collocation, or an open end
    firsts = entries.where(F.col("kind") != "starter").groupBy("type").agg(F.max(F.col("kind") == "abbreviation").alias("short"))
    met = met.join(firsts, "type", "left").where(F.col("open") | F.col("short").isNotNull())
    met = met.join(of("starter").select(F.col("type").alias("next"), F.lit(True).alias("starter")), "next", "left")
    met = met.join(of("collocation").select("type", "next", F.lit(True).alias("both")), ["type", "next"], "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    held = met.where(F.col("open") | (flag("short") & ~(F.col("capital") & flag("starter"))) | flag("both"))
    held = held.groupBy("id_").agg(F.collect_set("at").alias("held_"))

    d = d.join(held, "id_", "left").withColumn("held_", F.coalesce("held_", F.array().cast("array<int>")))
    d = staged(d, p_=F.flatten("b_"))
    d = staged(d, s_=together(F.col("p_"), F.col("held_")))
    return d.select(*rest, T.finished(F.col("s_"), F.array_join("p_", ""), limit).alias(name))


def learned_splitter(known: Boundaries, marks: str = "", limit: int = T.OVERLONG) -> Splitter:
    """The English splitter's rules (bullet blocks, white space kept, overlong sentences cut) with learned boundaries; for other
    languages with further sentence marks."""
    pattern = T.sentence_pattern(marks)
    return lambda c: T.split_english(c, limit, lambda b: T.let(T.extract(b, pattern), lambda p: joined(p, known)))
