"""Evaluation of pruned contexts: predictions read back from pruned text, confusion counts, F2, long documents, losses."""

from __future__ import annotations

import inspect
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions import arrays as A
from loomspan.functions import text as T
from loomspan.operators import prune as P


def infer_predictions(pruned: Column, sentences: Column) -> Column:
    """1 for each sentence found at the cursor of the pruned text, which then moves behind it."""

    @F.arrow_udf("array<int>")
    def run(pruned: pa.Array, sentences: pa.Array) -> pa.Array:
        flags, upto = [], [0]
        for text, own in zip(pruned.to_pylist(), sentences.to_pylist()):
            at = 0
            for s in own or ():
                found = bool(s) and text is not None and text.startswith(s, at)
                flags.append(int(found))
                at += len(s) if found else 0
            upto.append(len(flags))
        return pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(flags, pa.int32()), mask=sentences.is_null())

    return run(pruned, sentences)


def confusion(rows: DataFrame, *keys: str) -> DataFrame:
    """tp, fp, tn, fn and skipped contexts by keys, from arrays `gold` and `pred`; unequal lengths are skipped."""
    ok = F.size("gold") == F.size("pred")
    count = lambda g, p: F.coalesce(F.sum(F.when(ok, F.size(F.filter(F.arrays_zip("gold", "pred"), lambda x: (x["gold"] == g) & (x["pred"] == p))))), F.lit(0)).cast("long")
    return rows.groupBy(*keys).agg(count(1, 1).alias("tp"), count(0, 1).alias("fp"), count(0, 0).alias("tn"), count(1, 0).alias("fn"), F.count_if(~ok).alias("span_skipped"))


def scores(c: DataFrame) -> DataFrame:
    """accuracy, precision, recall and F2; null where a denominator is zero."""
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    total = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    d = c.withColumns({"precision": p, "recall": r, "accuracy": F.try_divide(F.col("tp") + F.col("tn"), total)})
    return d.withColumn("f2", F.try_divide(5 * F.col("precision") * F.col("recall"), 4 * F.col("precision") + F.col("recall")))


def thresholds_of(text: str | list[float]) -> list[float]:
    """Thresholds of a comma-separated text or a list: blanks left out, each once, in the order of their first places."""
    parts = [p.strip() for p in text.split(",")] if isinstance(text, str) else text
    return list(dict.fromkeys(float(p) for p in parts if p != ""))


def threshold_label(value: float) -> str:
    """A threshold as a heading: whole numbers without a point, others with six digits at most."""
    return str(int(value)) if float(value).is_integer() else f"{float(value):.6g}"


def pick_targets(known: list[str], wanted: list[str] | None) -> list[str]:
    """The wanted datasets (name or name:subset) among the known ones, all without a wish; unknown ones are an error."""
    if not wanted:
        return known
    missing = [w for w in wanted if w not in known]
    if missing:
        raise ValueError(f"unknown datasets {', '.join(missing)}; there are {', '.join(known)}")
    return [k for k in known if k in set(wanted)]


def sweep(scored: DataFrame, thresholds: list[float], *keys: str) -> DataFrame:
    """keys, threshold, kept: sentences above each threshold, from one scoring (sentence_probabilities)."""
    t = F.explode(F.array(*[F.lit(float(x)) for x in thresholds]))
    x = scored.select(*keys, "sentence_probabilities", t.alias("threshold"))
    return x.groupBy(*keys, "threshold").agg(F.sum(F.size(F.filter("sentence_probabilities", lambda p: p > F.col("threshold")))).alias("kept"))


def label_stats(records: DataFrame, label: str = "label", score: str = "score", compression: str | None = None) -> DataFrame:
    """label, mean_score (NaN and null left out), n, and with the name of its column mean_compression, which is added up in whole
    millionths."""
    known = F.when(~F.isnan(score), F.col(score))
    more = [(F.sum(A.millionths(F.col(compression))) / F.count(compression) / 1_000_000).alias("mean_compression")] if compression else []
    return records.groupBy(label).agg(F.avg(known).alias("mean_score"), F.count(F.lit(1)).alias("n"), *more)


def spans_of(rows: DataFrame, query: str = "query", texts: str = "texts", spans: str = "context_spans", relevance: str = "context_spans_relevance") -> DataFrame:
    """One row a text of a dataset's rows that have a question: query_idx (a number for each row), context_idx, query,
    context_text, manual_sentences (the texts of its spans), gold (their flags)."""
    some = rows.where(F.col(query).isNotNull()).select(F.monotonically_increasing_id().alias("query_idx"), F.col(query).alias("query"), F.col(texts).alias("t_"), F.col(spans).alias("s_"), F.col(relevance).alias("r_"))
    each = some.select("query_idx", "query", F.posexplode("t_").alias("context_idx", "context_text"), "s_", "r_")
    own = F.coalesce(F.get("s_", F.col("context_idx")), F.array())
    each = P.staged(each, manual_sentences=T.extract_spans(F.coalesce("context_text", F.lit("")), own))
    # blank sentences are no sentences to prune, so they have no flag either
    flags = A.norm_relevance(F.get("r_", F.col("context_idx")), F.size("manual_sentences"))
    each = P.staged(each, flags_=flags)
    gold = F.transform(F.filter(F.arrays_zip(F.col("manual_sentences").alias("s"), F.col("flags_").alias("f")), lambda x: T.strip(x["s"]) != ""), lambda x: x["f"])
    return each.withColumn("gold", gold).drop("s_", "r_", "flags_")


def evaluate_spans(rows: DataFrame, thresholds: list[float], columns: dict[str, str] | None = None, **options) -> DataFrame:
    """One row a threshold: threshold, contexts, tp, fp, tn, fn, span_skipped, accuracy, precision, recall, f2, mean_compression of
    pruning a dataset's texts by their spans. Scored once; thresholds only decide what is kept. columns: spans_of()'s names;
    options: prune()'s."""
    done = P.prune(spans_of(rows, **(columns or {})), None, threshold=min(thresholds), **options)
    done = done.select("query_idx", "context_idx", "context_text", "gold", "sentences", "sentence_probabilities", "block_scores", F.col("title").alias("prefix_"))
    done = done.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    kept = P.finish(done, F.col("threshold")).select("threshold", "gold", "compression_rate", infer_predictions(F.col("pruned_context"), F.col("sentences")).alias("pred"))
    count = kept.groupBy("threshold").agg(F.count(F.lit(1)).alias("contexts"), (F.sum(A.millionths(F.col("compression_rate"))) / F.count(F.lit(1)) / 1_000_000).alias("mean_compression"))
    return scores(confusion(kept, "threshold")).join(count, "threshold")


def long_evaluation(passages: DataFrame, process_fn: Callable[..., DataFrame] = P.prune, **options) -> DataFrame:
    """long_records() of passages (query_id, doc_index, query, text, label, given_title), pruned by process_fn, a function from
    contexts to prune()'s columns. Options that its signature doesn't have are left out."""
    known = inspect.signature(process_fn).parameters
    if not any(p.kind is p.VAR_KEYWORD for p in known.values()):
        options = {k: v for k, v in options.items() if k in known}
    contexts = passages.withColumnsRenamed({"query_id": "query_idx", "doc_index": "context_idx", "text": "context_text"})
    return long_records(process_fn(contexts, **options))


def eligible(records: DataFrame, ignored: DataFrame | None = None, key: str = "query_id", include_negatives: bool = False, max_text_chars: int = 60_000) -> DataFrame:
    """Records to judge: ignored queries out, positives alone unless negatives are asked for, texts cut at max_text_chars (0:
    whole)."""
    d = records if ignored is None else records.join(ignored.select(key), key, "left_anti")
    d = d if include_negatives else d.where("label = 1")
    return d.withColumn("text", F.substring("text", 1, max_text_chars)) if max_text_chars else d


def original_records(records: DataFrame) -> DataFrame:
    """The baseline that prunes nothing: text as pruned_text, no score, and the stored compression 100."""
    return records.withColumns({"pruned_text": F.col("text"), "reranking_score": F.lit(None).cast("double"), "compression_rate": F.lit(100.0)})


def long_records(pruned: DataFrame) -> DataFrame:
    """One record a passage of long-document evaluation, from prune()'s columns and label, given_title: query_id, doc_index,
    query, label, title (the given one, else the model's), original_chars, pruned_text, pruned_chars, reranking_score,
    compression_rate, n_kept, n_removed."""
    own = F.nullif(F.array_join(F.filter(F.transform("title", T.strip), lambda s: s != ""), " "), F.lit(""))
    return pruned.select(
        F.col("query_idx").alias("query_id"), F.col("context_idx").alias("doc_index"), "query", "label", F.coalesce(F.nullif(T.strip(F.col("given_title")), F.lit("")), own).alias("title"),
        F.length("context_text").alias("original_chars"), F.col("pruned_context").alias("pruned_text"), F.length("pruned_context").alias("pruned_chars"),
        "reranking_score", "compression_rate", F.size("kept_sentences").alias("n_kept"), F.size("removed_sentences").alias("n_removed"),
    )


def report_rows(records: DataFrame, first: int = 5) -> DataFrame:
    """The records of the first queries by id, numbered in `place`: positives first, then by score."""
    some = records.select("query_id").distinct().orderBy("query_id").limit(first)
    w = Window.partitionBy("query_id").orderBy(F.desc("label"), F.col("reranking_score").desc_nulls_last(), "doc_index")
    return records.join(F.broadcast(some), "query_id").withColumn("place", F.row_number().over(w))


# What padded or unlabelled places hold, and the weights of the two losses.
IGNORED = -100
RANKING_WEIGHT, PRUNING_WEIGHT = 0.05, 1.0


def ranking_mse(rows: DataFrame, logit: Column, target: Column) -> DataFrame:
    """One row: ranking_loss, the mean squared difference over targets that aren't ignored; 0 without any."""
    return rows.agg(F.coalesce(F.avg(F.when(target != IGNORED, F.pow(logit - target, F.lit(2)))), F.lit(0.0)).alias("ranking_loss"))


def pruning_ce(rows: DataFrame, drop: Column, keep: Column, label: Column) -> DataFrame:
    """One row: pruning_loss, the mean cross-entropy of two logits over labels 0 and 1; 0 without any, 0.001 if undefined."""
    top = F.greatest(drop, keep)
    each = top + F.ln(F.exp(drop - top) + F.exp(keep - top)) - F.when(label == 1, keep).otherwise(drop)
    return rows.agg(F.coalesce(F.nanvl(F.avg(F.when(label.isin(0, 1), each)), F.lit(0.001)), F.lit(0.0)).alias("pruning_loss"))


def total_loss(ranking: Column, pruning: Column) -> Column:
    return RANKING_WEIGHT * ranking + PRUNING_WEIGHT * pruning


Loss = Callable[[DataFrame], DataFrame]


def losses(ranking_rows: DataFrame, token_rows: DataFrame, ranking_loss_fn: Loss | None = None, pruning_loss_fn: Loss | None = None) -> DataFrame:
    """One row: ranking_loss, pruning_loss and their weighted sum. ranking_rows: logit, target; token_rows: drop, keep, label. A
    loss of one's own is a function from those rows to one row with a column of that name."""
    rank = (ranking_loss_fn or (lambda d: ranking_mse(d, F.col("logit"), F.col("target"))))(ranking_rows)
    prune = (pruning_loss_fn or (lambda d: pruning_ce(d, F.col("drop"), F.col("keep"), F.col("label"))))(token_rows)
    both = rank.select("ranking_loss").unionByName(prune.select("pruning_loss"), allowMissingColumns=True)
    both = both.agg(F.max("ranking_loss").alias("ranking_loss"), F.max("pruning_loss").alias("pruning_loss"))
    return both.withColumn("loss", total_loss(F.col("ranking_loss"), F.col("pruning_loss")))


def loss_means(rows: DataFrame, step: str, window: int, *losses: str) -> DataFrame:
    """log_step (the last step of each window of steps) and the mean of each loss in it."""
    end = (F.floor((F.col(step) - 1) / window) + 1) * window
    return rows.groupBy(end.cast("long").alias("log_step")).agg(*[F.avg(c).alias(c) for c in losses])
