"""Query-dependent pruning of contexts, one row per question and context.

The text is split into sentences, these into fragments of bounded length, fragments are packed into blocks
that fit the scorer's window, the scorer gives each block a ranking score and each fragment the mean keep
probability of its tokens; a sentence's probability is the mean of its fragments', and sentences above the
threshold are put together again. All of it happens inside the row with array expressions: no shuffle until
contexts of one question are ranked against each other.

The default tokenizer has one token a character, so lengths and windows are in characters; with another one (tokenizers.py)
they are in its tokens, and fragments are cut where tokens start. A ModelScorer (models.py) gets whole blocks of token
ids and gives each token a probability; a fragment's is the mean over those of its tokens that its block took.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions import arrays as A
from loomspan.functions import splitters
from loomspan.functions import text as T
from loomspan.operators import tokens as K
from loomspan.operators.models import ModelScorer
from loomspan.operators.scorers import LexicalScorer, Scorer
from loomspan.operators.tokenizers import Tokenizer
from loomspan.operators.trace import Trace

THRESHOLD = 0.1
FIRST_SENTENCE = "first_sentence"
FRAGMENT = "struct<text:string,sentence_index:int,fragment_index:int,length:int>"


def staged(d: DataFrame, **columns: Column) -> DataFrame:
    """Columns evaluated once: a one-row generator keeps the optimizer from copying their expressions into every use."""
    return d.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def fragment_limit(window: int, whole_sentences: bool = False) -> int:
    """The longest fragment: half a window, or nearly all of it where sentences are to stay whole."""
    return max(16, window - 2 if whole_sentences else window // 2)


def fragments(sentences: Column, step: int, strip_sentences: bool = False) -> Column:
    """For each sentence its pieces of `step` characters, array<array<struct<text, sentence_index, fragment_index, length>>>;
    with strip_sentences pieces are stripped and blank ones dropped, their length staying that of their tokens."""
    step = max(1, int(step))
    pieces = "(?s)" + "".join(f".{{{1 if k == 0 else 0},{min(900, step - k)}}}" for k in range(0, step, 900))

    def cut(s: Column, i: Column) -> Column:
        got = F.transform(T.extract(s, pieces), lambda x, j: F.struct((T.strip(x) if strip_sentences else x).alias("text"), i.alias("sentence_index"), j.alias("fragment_index"), F.length(x).alias("length")))
        return F.filter(got, lambda f: f["text"] != "") if strip_sentences else got

    return F.transform(sentences, cut)


def token_fragments(sentences: Column, tokens: Column, step: int, strip_sentences: bool = False) -> Column:
    """The same in stretches of `step` tokens (tokens: array<array<struct<id, a, b>>>, one array a sentence), with their ids and
    where each token starts in the fragment. A fragment reaches up to the next one's first token, the last to the sentence's end.
    A sentence without tokens has no fragment."""
    step = max(1, int(step))

    def cut(s: Column, i: Column) -> Column:
        def one(part: Column, j: Column, parts: Column) -> Column:
            a = F.when(j == 0, F.lit(0)).otherwise(F.get(part, F.lit(0))["a"])
            b = F.coalesce(F.get(F.get(parts, j + 1), F.lit(0))["a"], F.length(s))
            x = F.substr(s, a + 1, b - a)
            return F.struct(
                (T.strip(x) if strip_sentences else x).alias("text"), i.alias("sentence_index"), j.alias("fragment_index"), F.size(part).alias("length"),
                F.transform(part, lambda t: t["id"]).alias("ids"), F.transform(part, lambda t: t["a"] - a).alias("starts"),
            )

        got = T.let(A.chunks(F.get(tokens, i), step), lambda parts: F.transform(parts, lambda part, j: one(part, j, parts)))
        return F.filter(got, lambda f: f["text"] != "") if strip_sentences else got

    return F.transform(sentences, cut)


def or_one(flat: Column, whole: Column, tokenized: bool = False) -> Column:
    """The fragments; where there is none, the whole text as one."""
    one = F.struct(whole.alias("text"), F.lit(0).alias("sentence_index"), F.lit(0).alias("fragment_index"), F.length(whole).alias("length"))
    if tokenized:  # it has no tokens, or it would have a fragment
        one = one.withField("length", F.lit(0)).withField("ids", F.array().cast("array<int>")).withField("starts", F.array().cast("array<int>"))
    return T.let(flat, lambda f: F.when(F.size(f) > 0, f).otherwise(F.array(one)))


def pack(lengths: Column, query_length: Column, window: int, least: int = 0) -> Column:
    """array<struct<block, taken, used>>: for each fragment its block and how many of its tokens the block takes. A block
    starts with the question and a separator; a fragment that would pass window - 2 closes it, opens the next one and is cut
    to what fits there (its tail isn't scored). A block has room for `least` tokens behind any question: with the longest
    fragment's, none is cut."""

    @F.arrow_udf("array<struct<block:int,taken:int,used:int>>")
    def run(lengths: pa.Array, question: pa.Array) -> pa.Array:
        blocks, takes, uses, upto = [], [], [], [0]
        for own, q in zip(lengths.to_pylist(), question.to_pylist()):
            base = (q or 0) + 1
            most = max(window - 2, base + least)
            room, block, used = max(1, most - base), 0, base
            for k, n in enumerate(own or ()):
                taken = n
                if used + n <= most:
                    used += n
                else:
                    taken = min(n, room)
                    block, used = block + (k > 0), base + taken
                blocks.append(block)
                takes.append(taken)
                uses.append(used)
            upto.append(len(blocks))
        flat = pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in (blocks, takes, uses)], ["block", "taken", "used"])
        return pa.ListArray.from_arrays(pa.array(upto, pa.int32()), flat, mask=lengths.is_null())

    return run(lengths, query_length)


def sentence_means(fragment_probs: Column, fragment_counts: Column) -> Column:
    """The mean of each sentence's fragment probabilities, which lie one sentence behind the other; 0 without any; within
    0 and 1."""
    ends = A.scan(fragment_counts, F.lit(0), "int", lambda at, n: at + n, lambda at, end: end)
    means = T.let(ends, lambda e: F.transform(fragment_counts, lambda n, i: A.clip(A.mean(F.slice(fragment_probs, F.get(e, i) - n + 1, n), F.lit(0.0)))))
    # mostly no sentence is cut, and a fragment's probability is its sentence's
    return F.when(F.forall(fragment_counts, lambda n: n == 1), F.transform(fragment_probs, A.clip)).otherwise(means)


def titles_of(contexts: DataFrame, title: str | Column | None, first_line_as_title: bool) -> tuple[DataFrame, bool]:
    """(contexts with `prefix_`, the title sentences in front, and with the title taken out of the context where it is its
    first line; whether the first sentence is the title)."""
    none = F.array().cast("array<string>")
    if first_line_as_title:
        if title is not None and not (isinstance(title, str) and title == FIRST_SENTENCE):
            raise ValueError("first_line_as_title cannot be combined with a title")
        cut = staged(contexts, of_text_=T.first_line_title(F.col("context_text")), of_list_=T.first_item_title(F.coalesce("manual_", none)))
        listed = F.col("manual_").isNotNull()
        own = F.when(listed, F.col("of_list_.title")).otherwise(F.col("of_text_.title"))
        rest = F.when(listed, F.col("of_list_.rest"))
        d = staged(cut, prefix_=T.prefix_sentences(F.array(own)), rest_=rest)
        text = F.when(listed, F.array_join("rest_", "")).otherwise(F.col("of_text_.rest"))
        return d.withColumns({"context_text": text, "manual_": F.col("rest_")}).drop("of_text_", "of_list_", "rest_"), False
    if title is None or (isinstance(title, str) and title == FIRST_SENTENCE):
        return contexts.withColumn("prefix_", none), title is not None
    given = F.lit(title) if isinstance(title, str) else title
    kind = contexts.select(given.alias("t")).schema["t"].dataType.typeName()
    return staged(contexts, prefix_=T.prefix_sentences(F.coalesce(given, none) if kind == "array" else F.array(given))), False


def prune(
    contexts: DataFrame,
    title: str | Column | None = FIRST_SENTENCE,
    first_line_as_title: bool = False,
    *,
    threshold: float = THRESHOLD,
    always_select_title: bool = False,
    reorder: bool = False,
    top_k: int | None = None,
    sentence_splitter: splitters.Splitter | Mapping[str, splitters.Splitter] | None = None,
    language: str | None = None,
    use_best_reranker_score: bool = True,
    zero_score_when_empty: bool = True,
    strip_sentences: bool = False,
    respect_sentence_boundaries: bool = False,
    window: int = 512,
    scorer: Scorer | ModelScorer | None = None,
    tokenizer: Tokenizer | None = None,
    cut_fragments: str = "keep",
    trace: Trace | None = None,
) -> DataFrame:
    """contexts: query_idx, context_idx, query, context_text; further columns stay. A column manual_sentences (array<string>),
    where it isn't null, is the context instead, split already. Adds sentences, sentence_probabilities, kept (flags),
    pruned_context, reranking_score, compression_rate, title (the sentences in front), kept_sentences, removed_sentences,
    block_scores, scored_share.

    title: sentences in front of the context, scored and packed with it but never part of the pruned text: a column of
    strings or string arrays, or one string for all. "first_sentence" (default) has none, but makes the first sentence the
    title; None has no title at all. first_line_as_title takes the first non-blank line out of the context.
    always_select_title: if any sentence passes, the title passes too.
    reorder: contexts of a question get a `rank` by score, and with top_k only the first ones stay; top_k alone does
    nothing, with a warning.
    tokenizer: counts windows and fragments in its tokens; a ModelScorer brings its own.
    cut_fragments: a question may leave less room in a window than a fragment needs, whose tail then isn't scored. "keep" does
    so and tells the share of tokens that were scored in `scored_share`; "error" fails instead; "widen" lets a block go beyond the
    window as far as the question leaves less than a whole fragment.
    trace: measures the stages in the job of the next action (trace.py).
    Null texts and null questions count as empty; questions without contexts aren't rows.
    """
    splitter, scorer = splitters.resolve(sentence_splitter, language), scorer or LexicalScorer()
    if cut_fragments not in ("keep", "error", "widen"):
        raise ValueError("cut_fragments is keep, error or widen")
    tokenizer = scorer.tokenizer if isinstance(scorer, ModelScorer) else tokenizer
    if top_k is not None and not reorder:
        warnings.warn("top_k has no effect without reorder", stacklevel=2)
    manual = F.col("manual_sentences") if "manual_sentences" in contexts.columns else F.lit(None).cast("array<string>")
    tick = trace.tick if trace else (lambda d, _: d)
    contexts = trace.begin(contexts) if trace else contexts
    d = staged(contexts.withColumn("query", F.coalesce("query", F.lit(""))), manual_=F.filter(manual, T.filled))
    d = d.withColumn("context_text", F.when(F.col("manual_").isNotNull(), F.array_join("manual_", "")).otherwise(F.coalesce("context_text", F.lit(""))))
    d, first_is_title = titles_of(d, title, first_line_as_title)
    own = F.coalesce("manual_", splitter(F.col("context_text")))
    found = F.concat("prefix_", own)
    if trace:
        d = tick(staged(d, found_=found), "sentence_collect")
        d = tick(staged(d, sentences=T.normalize(F.col("found_"), F.col("context_text"), strip_sentences)).drop("found_"), "sentence_normalize")
    else:
        d = staged(d, sentences=T.normalize(found, F.col("context_text"), strip_sentences))
    limit = fragment_limit(window, respect_sentence_boundaries)
    if tokenizer is None:
        d = staged(d, cut_=fragments(F.col("sentences"), limit, strip_sentences))
        asked = F.length("query")
    else:
        # the question's tokens are those of a last text behind the sentences: one call for both
        d = tick(staged(d, tokens_=tokenizer.tokens(F.concat("sentences", F.array("query")))), "tokenize")
        d = staged(d, query_ids_=F.transform(F.element_at("tokens_", -1), lambda t: t["id"]), cut_=token_fragments(F.col("sentences"), F.col("tokens_"), limit, strip_sentences)).drop("tokens_")
        asked = F.size("query_ids_")
    d = tick(d, "fragment_split")
    d = tick(staged(d, fragments_=or_one(F.flatten("cut_"), F.col("context_text"), tokenizer is not None)), "fragment_decode")
    d = staged(d, packed_=pack(F.transform("fragments_", lambda f: f["length"]), asked, window, limit if cut_fragments == "widen" else 0))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    whole, taken = total(F.transform("fragments_", lambda f: f["length"])), total(F.transform("packed_", lambda p: p["taken"]))
    share = F.when(whole > 0, taken / whole).otherwise(F.lit(1.0))
    if cut_fragments == "error":
        share = F.when(taken < whole, F.raise_error(F.concat(F.lit(f"a question leaves less than a fragment of the window of {window}: "), F.substring("query", 1, 80))).cast("double")).otherwise(share)
    d = staged(d, scored_share=share, texts_=F.transform("fragments_", lambda f, i: taken_text(f, F.get(F.col("packed_"), i)["taken"], tokenizer is not None)))
    # a block is a stretch of fragments: its text is a slice
    at = F.transform("packed_", lambda p, i: F.when((i == 0) | (p["block"] != F.get(F.col("packed_"), i - 1)["block"]), i))
    d = staged(d, first_=F.filter(at, lambda i: i.isNotNull()))
    stop = lambda j: F.coalesce(F.get(F.col("first_"), j + 1), F.size("texts_"))
    d = tick(d, "assembly")
    if isinstance(scorer, ModelScorer):
        d = by_model(d, scorer, stop)
    else:
        d = staged(d, blocks_=F.transform("first_", lambda i, j: F.array_join(F.slice("texts_", i + 1, stop(j) - i), "")))
        d = staged(d, block_scores=scorer.rank(F.col("query"), F.col("blocks_")), keep_=scorer.keep(F.col("query"), F.col("texts_")))
    d = tick(d, "inference")
    if trace:
        d = d.withColumns({"n fragments": F.size("fragments_"), "n blocks": F.size("block_scores")})
    d = staged(d, sentence_probabilities=sentence_means(F.col("keep_"), F.transform("cut_", F.size)))
    d = d.withColumn("title", F.col("prefix_")).drop("manual_", "cut_", "fragments_", "packed_", "texts_", "first_", "blocks_", "keep_", "query_ids_")
    out = finish(d, threshold, always_select_title, first_is_title, use_best_reranker_score, zero_score_when_empty).drop("prefix_")
    if trace:
        out = trace.end(tick(out, "postprocess"), sentences=F.size("sentences"), fragments=F.col("n fragments"), blocks=F.col("n blocks")).drop("n fragments", "n blocks")
    return rerank(out, top_k) if reorder else out


def taken_text(fragment: Column, taken: Column, tokenized: bool) -> Column:
    """The text of a fragment's first tokens, up to where the next one starts."""
    if not tokenized:
        return F.substr(fragment["text"], F.lit(1), taken)
    return F.when(taken >= fragment["length"], fragment["text"]).otherwise(F.substr(fragment["text"], F.lit(1), F.get(fragment["starts"], taken)))


def by_model(d: DataFrame, scorer: ModelScorer, stop: Callable[[Column], Column]) -> DataFrame:
    """block_scores and keep_ of token blocks: each block's ids, the model's probabilities, means over the fragments' tokens."""
    d = staged(d, ids_=F.transform("fragments_", lambda f, i: F.slice(f["ids"], F.lit(1), F.get(F.col("packed_"), i)["taken"])))
    own = F.transform("first_", lambda i, j: F.flatten(F.slice("ids_", i + 1, stop(j) - i)))
    d = staged(d, inputs_=F.transform(own, lambda b: K.block_inputs(F.col("query_ids_"), b, scorer.start, scorer.separator)))
    head = F.size("query_ids_") + 2
    d = staged(d, scored_=scorer.blocks(F.transform("inputs_", lambda x: x["input_ids"]), head))
    d = staged(d, ends_=A.scan(F.transform("ids_", F.size), F.lit(0), "int", lambda at, n: at + n, lambda at, end: end))

    def mean(ids: Column, i: Column) -> Column:
        block = F.get(F.col("packed_"), i)["block"]
        first = F.get(F.col("first_"), block)
        at = head + F.get(F.col("ends_"), i) - F.size(ids) - F.when(first > 0, F.get(F.col("ends_"), first - 1)).otherwise(F.lit(0))
        return A.mean(F.slice(F.get(F.col("scored_"), block)["probs"], at + 1, F.size(ids)), F.lit(1.0))

    d = staged(d, block_scores=F.transform("scored_", lambda s: A.sigmoid(s["logit"])), keep_=F.transform("ids_", mean))
    return d.drop("ids_", "inputs_", "scored_", "ends_")


def finish(d: DataFrame, threshold: float | Column, always_select_title: bool = False, first_is_title: bool = False, use_best_reranker_score: bool = True, zero_score_when_empty: bool = True) -> DataFrame:
    """From sentences, sentence_probabilities, block_scores and prefix_ to the pruned text; independent of the scorer, so a
    sweep over thresholds scores once."""
    over = F.transform("sentence_probabilities", lambda p: A.clip(p) > threshold)
    prefix = F.size("prefix_")
    if always_select_title:
        some = F.exists("sentence_probabilities", lambda p: A.clip(p) > threshold)
        # the first sentence, if it is a title; without titles nothing is forced
        forced = F.lit(True) if first_is_title else prefix > 0
        over = F.transform(over, lambda k, i: k | (some & forced & (i == 0)))
    d = staged(d, kept=over)
    side = lambda want: F.filter(F.col("sentences"), lambda s, i: F.get(F.col("kept"), i) == want)
    d = staged(d, kept_sentences=side(True), removed_sentences=side(False), pruned_context=F.array_join(F.filter(F.col("sentences"), lambda s, i: F.get(F.col("kept"), i) & (i >= prefix)), ""))
    score = F.array_max(F.filter("block_scores", lambda x: x.isNotNull())) if use_best_reranker_score else F.get(F.filter("block_scores", lambda x: x.isNotNull()), F.lit(0))
    if zero_score_when_empty:
        score = F.when(~T.filled(F.col("pruned_context")), F.lit(0.0)).otherwise(score)
    whole = F.length("context_text")
    rate = (whole - F.length("pruned_context")) / F.greatest(whole, F.lit(1)) * 100.0
    return d.withColumns({"reranking_score": score, "compression_rate": rate})


def rerank(pruned: DataFrame, top_k: int | None = None) -> DataFrame:
    """Rank within each question by score, missing scores last, ties in input order; the first top_k if given."""
    order = Window.partitionBy("query_idx").orderBy(F.nanvl(F.col("reranking_score"), F.lit(float("-inf"))).desc_nulls_last(), "context_idx")
    out = pruned.withColumn("rank", F.row_number().over(order))
    return out if top_k is None else out.where(F.col("rank") <= max(0, int(top_k)))
