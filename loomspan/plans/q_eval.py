"""Evaluation, long documents, judging, labels and losses, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.functions import arrays as A
from loomspan.functions import text as T
from loomspan.operators import evaluate as E
from loomspan.operators import labeling as L
from loomspan.operators import prune as P
from loomspan.operators import tokens as K
from loomspan.plans.base import d_strip, load, query, spread
from loomspan.plans.q_data import ITEMS_D, item_flags
from loomspan.plans.q_prune import ASKED, PRUNED, SCORED, SMALL_STEP, SMALL_WINDOW, TERMS_D, WINDOW, finish_d, marked, pruned, scored_d
from loomspan.plans.q_text import PARTS_D, d_ladder

THRESHOLDS = (0.05, 0.1, 0.3, 0.5)

#: Gold flags: whether a sentence has the question's longest term; predictions: read back from the pruned text.
EVALUATED = PRUNED.replace("@@", "") + """, gold AS (SELECT o.*, list_transform(o.sentences, lambda x: CASE WHEN contains(lower(x), lower(string_split(o.query, ' ')[2])) THEN 1 ELSE 0 END) AS gold,
  list_reduce(list_transform(o.sentences, lambda x: {'s': x, 'at': 0, 'out': []::INT[]}), lambda a, x: CASE WHEN substring(pruned, CAST(a.at + 1 AS INT), length(x.s)) = x.s AND length(x.s) > 0
    THEN {'s': '', 'at': CAST(a.at + length(x.s) AS INT), 'out': list_concat(a.out, [1])} ELSE {'s': '', 'at': a.at, 'out': list_concat(a.out, [0])} END, {'s': '', 'at': 0, 'out': []::INT[]}).out AS pred FROM o),
flat AS (SELECT query_idx, context_idx, unnest(gold) AS g, unnest(pred) AS p FROM gold),
conf AS (SELECT query_idx, count(*) FILTER (WHERE g = 1 AND p = 1) AS tp, count(*) FILTER (WHERE g = 0 AND p = 1) AS fp, count(*) FILTER (WHERE g = 0 AND p = 0) AS tn, count(*) FILTER (WHERE g = 1 AND p = 0) AS fn FROM flat GROUP BY query_idx)"""


def evaluated(spark, d):
    p = P.staged(pruned(spark, d), key_=F.lower(F.get(F.split("query", " "), F.lit(1))))
    key = F.col("key_")
    return p.select("query_idx", "context_idx", "compression_rate", F.inline(F.array(F.struct(F.transform("sentences", lambda s: F.coalesce(F.contains(F.lower(s), key), F.lit(False)).cast("int")).alias("gold"), E.infer_predictions(F.col("pruned_context"), F.col("sentences")).alias("pred")))))


@query("infer_predictions", f"WITH {EVALUATED[5:]} SELECT query_idx, context_idx, coalesce(array_to_string(pred, ''), '') AS pred FROM gold")
def infer_predictions(spark, d):
    return evaluated(spark, d).select("query_idx", "context_idx", F.array_join(F.transform("pred", lambda x: x.cast("string")), "").alias("pred"))


@query("eval_confusion", f"WITH {EVALUATED[5:]} SELECT query_idx, tp, fp, tn, fn, 0 AS span_skipped FROM conf")
def eval_confusion(spark, d):
    return E.confusion(evaluated(spark, d), "query_idx")


F2_D = "tp / nullif(tp + fp, 0) AS p, tp / nullif(tp + fn, 0) AS r, (tp + tn) / nullif(tp + fp + tn + fn, 0) AS acc"


@query("eval_f2", f"WITH {EVALUATED[5:]}, z AS (SELECT query_idx, {F2_D} FROM conf) SELECT query_idx, round(acc, 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall, round(5 * p * r / nullif(4 * p + r, 0), 6) AS f2 FROM z")
def eval_f2(spark, d):
    s = E.scores(E.confusion(evaluated(spark, d), "query_idx"))
    return s.select("query_idx", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f2")])


def mean_rate():
    """The mean compression rate to four places, added up in whole millionths."""
    return F.floor(F.sum(A.millionths(F.col("compression_rate"))) / F.count(F.lit(1)) / 100.0 + 0.5) / 10000


@query("eval_dataset", f"WITH {EVALUATED[5:]}, z AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(tn) AS tn, sum(fn) AS fn FROM conf), y AS (SELECT {F2_D} FROM z), m AS (SELECT floor(sum(CAST(floor(rate * 1000000 + 0.5) AS BIGINT)) / count(*) / 100.0 + 0.5) / 10000 AS rate, count(*) AS n FROM o) SELECT n AS contexts, rate AS mean_compression, round(acc, 6) AS accuracy, round(5 * p * r / nullif(4 * p + r, 0), 6) AS f2 FROM y, m")
def eval_dataset(spark, d):
    e = evaluated(spark, d)
    ok = lambda g, p: F.sum(F.size(F.filter(F.arrays_zip("gold", "pred"), lambda x: (x["gold"] == g) & (x["pred"] == p)))).cast("long")
    c = e.agg(ok(1, 1).alias("tp"), ok(0, 1).alias("fp"), ok(0, 0).alias("tn"), ok(1, 0).alias("fn"), F.count(F.lit(1)).alias("contexts"), mean_rate().alias("mean_compression"))
    return E.scores(c).select("contexts", "mean_compression", F.round("accuracy", 6).alias("accuracy"), F.round("f2", 6).alias("f2"))


@query("mean_compression", f"{PRUNED} SELECT floor(sum(CAST(floor(rate * 1000000 + 0.5) AS BIGINT)) / count(*) / 100.0 + 0.5) / 10000 AS mean_compression FROM o")
def mean_compression(spark, d):
    return pruned(spark, d).agg(mean_rate().alias("mean_compression"))


@query("threshold_sweep", f"{PRUNED}, t AS (SELECT unnest([0.05, 0.1, 0.3, 0.5]) AS threshold) SELECT query_idx, CAST(threshold AS DOUBLE) AS threshold, CAST(sum(len(list_filter(probs, lambda x: x > threshold))) AS BIGINT) AS kept FROM o, t GROUP BY ALL")
def threshold_sweep(spark, d):
    """All thresholds from one scoring."""
    return E.sweep(pruned(spark, d), E.thresholds_of("0.05, 0.1,, 0.3, 0.5, 0.1"), "query_idx")


@query("eval_rollup", f"{PRUNED}, t AS (SELECT unnest([0.05, 0.1, 0.3, 0.5]) AS threshold) SELECT coalesce(query_idx, -1) AS query_idx, coalesce(CAST(threshold AS DOUBLE), -1.0) AS threshold, contexts, kept FROM (SELECT query_idx, threshold, count(*) AS contexts, CAST(sum(len(list_filter(probs, lambda x: x > threshold))) AS BIGINT) AS kept FROM o, t GROUP BY ROLLUP (threshold, query_idx))")
def eval_rollup(spark, d):
    """Sums over thresholds and questions; -1 stands for all."""
    t = F.explode(F.array(*[F.lit(x) for x in THRESHOLDS]))
    x = pruned(spark, d).select("query_idx", t.alias("threshold"), "sentence_probabilities").select("query_idx", "threshold", F.size(F.filter("sentence_probabilities", lambda p: p > F.col("threshold"))).alias("k"))
    r = x.rollup("threshold", "query_idx").agg(F.count(F.lit(1)).alias("contexts"), F.sum("k").alias("kept"))
    return r.select(F.coalesce("query_idx", F.lit(-1)).alias("query_idx"), F.coalesce("threshold", F.lit(-1.0)).alias("threshold"), "contexts", "kept")


@query("teacher_scores", "SELECT conv_id, string_agg(printf('%.3f', length(text) / 1000.0), ',' ORDER BY turn) AS scores, count(*) AS n FROM conversations GROUP BY conv_id")
def teacher_scores(spark, d):
    """Scores of (row, text) pairs, back at their places of one array a row; the length stands for any model's score."""
    c = load(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("texts"))
    got = L.teacher_scores(c, "conv_id", "texts", lambda pairs: pairs.select("conv_id", "pos", (F.length("text") / 1000.0).cast("double").alias("score")))
    return got.select("conv_id", F.array_join(F.transform("teacher_scores", lambda x: F.format_string("%.3f", x)), ",").alias("scores"), F.size("teacher_scores").cast("long").alias("n"))


def by_length(prompt):
    """A labeler that stands for any model: it names the chunks that have 80 characters or more with their number."""
    numbered = F.filter(F.split(prompt, "\n"), lambda x: x.rlike(r"^\[[0-9]+\]") & (F.length(x) >= 80))
    return F.array_join(F.transform(numbered, lambda x: F.regexp_extract(x, r"^\[([0-9]+)\]", 1)), ", ")


@query("relevance_label", f"""WITH s AS (SELECT doc_id, text AS t, coalesce(source, '') AS question FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, question, {PARTS_D} AS p FROM s),
c AS (SELECT doc_id, p, list_filter({d_ladder('question', 'p')}, lambda x: length(x) <= 32000)[1] AS prompt FROM p),
n AS (SELECT doc_id, p, list_distinct(list_transform(list_filter(string_split(prompt, chr(10)), lambda x: regexp_matches(x, '^\\[[0-9]+\\]') AND length(x) >= 80), lambda x: CAST(regexp_extract(x, '^\\[([0-9]+)\\]', 1) AS INT))) AS k FROM c)
SELECT doc_id, CAST(len(p) AS INT) AS n_chunks, CAST(len(list_filter(k, lambda i: i <= len(p))) AS INT) AS n_relevant FROM n""".replace("\\\\", "\\"))
def relevance_label(spark, d):
    """Prompts within a limit, a labeler, flags from the numbers in its reply."""
    t = spread(load(spark, d, "documents").where("text is not null").select("doc_id", F.coalesce("source", F.lit("")).alias("query"), "text"))
    t = P.staged(t, chunks=T.split_generic(F.col("text"))).drop("text")
    got = L.label_chunks(t, by_length)
    return got.select("doc_id", F.size("chunks").alias("n_chunks"), F.aggregate("relevance", F.lit(0), lambda a, x: a + x).alias("n_relevant"))


#: Long documents: a conversation's first user turn asks, its other turns but the system's are the passages, assistant's positive.
LONG = """WITH first AS (SELECT conv_id, arg_min(text, turn) AS query, min(turn) AS asked FROM conversations WHERE role = 'user' GROUP BY conv_id),
l AS (SELECT c.conv_id AS query_id, c.turn AS doc_index, f.query, c.text, CASE WHEN c.role = 'assistant' THEN 1 ELSE 0 END AS label, c.role AS given_title FROM conversations c JOIN first f ON f.conv_id = c.conv_id AND c.turn <> f.asked WHERE c.role <> 'system' AND c.text IS NOT NULL)"""


def longdocs(spark, d):
    c = load(spark, d, "conversations")
    first = c.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("query"), F.min("turn").alias("asked"))
    p = c.where("role <> 'system' and text is not null").join(first, "conv_id").where("turn <> asked")
    return p.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("doc_index"), "query", "text", (F.col("role") == "assistant").cast("int").alias("label"), F.col("role").alias("given_title"))


def long_pruned(spark, d, window=WINDOW, **kw):
    """The passages pruned for their questions, the role as title in front."""
    c = longdocs(spark, d).select(F.col("query_id").alias("query_idx"), F.col("doc_index").alias("context_idx"), "query", F.col("text").alias("context_text"), "label", "given_title")
    return P.prune(spread(c, load(spark, d, "conversations")), F.col("given_title"), window=window, threshold=0.1, sentence_splitter=marked, **kw)


def long_d(scored):
    return f"WITH {scored.replace('@PREFIX@', "[given_title || chr(10)]").replace(ASKED, LONG[5:] + f", c AS (SELECT query_id AS query_idx, doc_index AS context_idx, query, text AS context_text, label, given_title, {TERMS_D('query')} AS qt FROM l)")}{finish_d().replace('SELECT query_idx, context_idx, query,', 'SELECT query_idx, context_idx, label, given_title, query,')}"


LONG_D = long_d(SCORED)
#: The same in fragments of 128 characters and blocks of 256, longer where a question leaves less than a fragment: no text is cut.
FINE_D = long_d(scored_d(SMALL_STEP, f"greatest({SMALL_WINDOW - 2}, length(query) + 1 + {SMALL_STEP})"))


def fine_pruned(spark, d):
    return long_pruned(spark, d, SMALL_WINDOW, cut_fragments="widen")


@query("longdoc_records", f"{FINE_D} SELECT query_idx AS query_id, context_idx AS doc_index, label, given_title AS title, CAST(length(context_text) AS INT) AS original_chars, md5(pruned) AS pruned_md5, round(score, 6) AS reranking_score, round(rate, 6) AS compression_rate, CAST(len(list_filter(kept, lambda x: x)) AS INT) AS n_kept, CAST(len(list_filter(kept, lambda x: NOT x)) AS INT) AS n_removed FROM o")
def longdoc_records(spark, d):
    r = E.long_records(fine_pruned(spark, d))
    return r.select("query_id", "doc_index", "label", "title", "original_chars", F.md5("pruned_text").alias("pruned_md5"), F.round("reranking_score", 6).alias("reranking_score"), F.round("compression_rate", 6).alias("compression_rate"), "n_kept", "n_removed")


@query("longdoc_original", f"{LONG} SELECT query_id, doc_index, md5(text) AS pruned_md5, CAST(NULL AS DOUBLE) AS reranking_score, 100.0 AS compression_rate FROM l")
def longdoc_original(spark, d):
    """The baseline that prunes nothing; its stored compression is the literal 100."""
    return E.original_records(longdocs(spark, d)).select("query_id", "doc_index", F.md5("pruned_text").alias("pruned_md5"), "reranking_score", "compression_rate")


@query("longdoc_stats", f"{LONG_D} SELECT label, round(avg(score), 6) AS mean_score, floor(sum(CAST(floor(rate * 1000000 + 0.5) AS BIGINT)) / count(*) / 100.0 + 0.5) / 10000 AS mean_compression, count(*) AS n FROM o GROUP BY label")
def longdoc_stats(spark, d):
    return E.label_stats(E.long_records(long_pruned(spark, d)), "label", "reranking_score", "compression_rate").withColumns({"mean_score": F.round("mean_score", 6), "mean_compression": F.floor(F.col("mean_compression") * 10000 + 0.5) / 10000})


@query("report_top_queries", f"{FINE_D}, ranked AS (SELECT *, dense_rank() OVER (ORDER BY query_idx) AS q FROM o) SELECT query_idx AS query_id, context_idx AS doc_index, label, row_number() OVER (PARTITION BY query_idx ORDER BY label DESC, score DESC NULLS LAST, context_idx) AS place FROM ranked WHERE q <= 5")
def report_top_queries(spark, d):
    """A report's first five queries (the limit is the feature), documents positives first, then by score."""
    return E.report_rows(E.long_records(fine_pruned(spark, d))).select("query_id", "doc_index", "label", F.col("place").cast("long").alias("place"))


@query("eval_eligible", f"{LONG} SELECT query_id, doc_index, text FROM l WHERE label = 1 AND query_id NOT IN (SELECT item_id * 2 FROM benchmark)")
def eval_eligible(spark, d):
    """Positive passages of questions that aren't on the ignore list, whole."""
    ignored = load(spark, d, "benchmark").select((F.col("item_id") * 2).alias("query_id"))
    return E.eligible(longdocs(spark, d), ignored, max_text_chars=0).select("query_id", "doc_index", "text")


def judge_by_length(prompt):
    """A judge that stands for any model: it goes by its prompt's length."""
    n = F.length(prompt)
    return F.to_json(F.struct((n >= 500).cast("int").alias("has_answer"), F.round(F.least(n / 1000.0, F.lit(1.0)), 4).alias("answer_score"), F.lit("by length").alias("reasoning")))


JUDGED_D = f"""{LONG}, e AS (SELECT * FROM l WHERE label = 1 AND query_id NOT IN (SELECT item_id * 2 FROM benchmark)),
p AS (SELECT query_id, doc_index, length('<instruction>{L.INSTRUCTION}</instruction>' || chr(10) || '<question>' || coalesce(nullif({d_strip('query')}, ''), '(empty question)') || '</question>' || chr(10) || '<title>' || coalesce(nullif({d_strip('given_title')}, ''), '(none)') || '</title>' || chr(10) || '<text>' || coalesce(nullif({d_strip('text')}, ''), '(empty text)') || '</text>') AS n FROM e),
j AS (SELECT query_id, doc_index, CASE WHEN n >= 500 THEN 1 ELSE 0 END AS has_answer, round(least(n / 1000.0, 1.0), 4) AS answer_score, 'by length' AS reasoning FROM p)"""


def judged(spark, d):
    ignored = load(spark, d, "benchmark").select((F.col("item_id") * 2).alias("query_id"))
    return L.judge(E.eligible(longdocs(spark, d), ignored), judge_by_length, "query", "text", "given_title")


@query("judge", f"{JUDGED_D} SELECT * FROM j")
def judge(spark, d):
    """A judge over eligible passages: prompt, reply, what is read from it."""
    return judged(spark, d).select("query_id", "doc_index", "has_answer", "answer_score", "reasoning")


@query("judge_summary", f"{JUDGED_D} SELECT count(*) FILTER (WHERE has_answer = 1) AS answered, count(*) FILTER (WHERE has_answer = 0) AS unanswered, 0 AS failed, round(avg(answer_score), 6) AS mean_score, median(answer_score) AS median_score, min(answer_score) AS least, max(answer_score) AS most FROM j")
def judge_summary(spark, d):
    return L.judge_summary(judged(spark, d)).withColumn("mean_score", F.round("mean_score", 6))


@query("judge_parse", "SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 1 WHEN role = 'user' THEN 0 END AS has_answer, CASE WHEN role IN ('assistant', 'user') THEN 0.75 END AS answer_score, CASE WHEN role = 'assistant' THEN role END AS reasoning FROM conversations")
def judge_parse(spark, d):
    """Replies of all kinds: has_answer or its older name, reason or reasoning, values out of range."""
    role = F.col("role")
    reply = F.when(role == "assistant", F.to_json(F.struct(F.lit(1).alias("has_answer"), F.lit(0.75).alias("answer_score"), role.alias("reason"))))
    reply = reply.when(role == "user", F.to_json(F.struct(F.lit(0).alias("contains_answer"), F.lit(0.75).alias("answer_score")))).otherwise(F.lit('{"has_answer": 7, "answer_score": 1.5}'))
    return load(spark, d, "conversations").select("conv_id", "turn", L.judge_parse(reply).alias("j")).select("conv_id", "turn", "j.*")


#: Logits for the losses: a document's flags for each item are the targets, the item's place gives the logits.
LOSS_D = f"WITH {ITEMS_D}, e AS (SELECT doc_id, unnest(r) AS v, generate_subscripts(r, 1) AS i FROM r), t AS (SELECT doc_id, i, list_sum(v) / len(v) AS y, CASE WHEN i % 7 = 0 THEN -100 WHEN list_sum(v) > 0 THEN 1 ELSE 0 END AS label FROM e)"


def loss_rows(spark, d):
    x = item_flags(spark, d).select("doc_id", F.posexplode("r").alias("pos", "v")).withColumn("i", F.col("pos") + 1)
    some = F.exists("v", lambda y: y != 0)
    return x.select("doc_id", "i", A.mean(F.transform("v", lambda y: y.cast("double")), F.lit(0.0)).alias("y"), F.when(F.col("i") % 7 == 0, E.IGNORED).when(some, 1).otherwise(0).alias("label"))


@query("ranking_mse", f"{LOSS_D} SELECT round(avg(pow(1.0 / i - y, 2)), 6) AS ranking_loss FROM t")
def ranking_mse(spark, d):
    return E.ranking_mse(loss_rows(spark, d), 1.0 / F.col("i"), F.col("y")).select(F.round("ranking_loss", 6).alias("ranking_loss"))


@query("pruning_ce", f"{LOSS_D} SELECT round(avg(ln(exp(0.01 * i) + exp(1 - 0.02 * i)) - CASE WHEN label = 1 THEN 1 - 0.02 * i ELSE 0.01 * i END), 6) AS pruning_loss FROM t WHERE label IN (0, 1)")
def pruning_ce(spark, d):
    """Two-class cross-entropy over labels 0 and 1; others are ignored."""
    i = F.col("i")
    return E.pruning_ce(loss_rows(spark, d), 0.01 * i, 1 - 0.02 * i, F.col("label")).select(F.round("pruning_loss", 6).alias("pruning_loss"))


@query("loss_means", f"{LOSS_D} SELECT CAST(ceil(i / 10.0) * 10 AS BIGINT) AS log_step, round(avg(y), 6) AS y FROM t GROUP BY 1")
def loss_means(spark, d):
    """A value's mean in each window of ten steps."""
    return E.loss_means(loss_rows(spark, d), "i", 10, "y").withColumn("y", F.round("y", 6))


#: A document's sentences as spans of tokens, one between two of them, four in front; relevant ones have the document's letter.
SPANS_D = f"WITH s AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(substring(source, 1, 1), 'e') AS key FROM documents), p AS (SELECT doc_id, key, {PARTS_D} AS p FROM s), e AS (SELECT doc_id, key, unnest(p) AS x, generate_subscripts(p, 1) AS k FROM p), n AS (SELECT doc_id, k, length(x) AS n, CASE WHEN contains(x, key) THEN 1 ELSE 0 END AS rel FROM e), r AS (SELECT doc_id, k, n, rel, 4 + sum(n + 1) OVER (PARTITION BY doc_id ORDER BY k) - 1 AS b FROM n), spans AS (SELECT doc_id, k, rel, b - n AS a, b FROM r)"
CAP = 2000


def spans(spark, d):
    """doc_id, spans (array<struct<a, b, label>>) of the texts that have sentences."""
    s = spread(load(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"), F.coalesce(F.substring("source", 1, 1), F.lit("e")).alias("key")))
    s = P.staged(s, p=T.split_generic(F.col("t"))).where(F.size("p") > 0)
    s = P.staged(s, at=K.running_ranges(F.transform("p", F.length), gap=1, offset=4))
    return s.select("doc_id", F.transform("p", lambda x, i: F.struct(F.get(F.col("at"), i)["a"].alias("a"), F.get(F.col("at"), i)["b"].alias("b"), F.contains(x, F.col("key")).cast("int").alias("label"))).alias("spans"))


@query("span_token_pos", f"{SPANS_D} SELECT doc_id, CAST(k - 1 AS BIGINT) AS k, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM spans")
def span_token_pos(spark, d):
    """Token positions of spans joined by one blank, with the document's offset, by running sums."""
    x = spans(spark, d).select("doc_id", F.posexplode("spans").alias("k", "s"))
    return x.select("doc_id", F.col("k").cast("long").alias("k"), F.col("s.a").cast("long").alias("a"), F.col("s.b").cast("long").alias("b"))


@query("token_labels", f"{SPANS_D}, z AS (SELECT doc_id, sum(CASE WHEN rel = 1 THEN greatest(least(b, {CAP}) - a, 0) ELSE 0 END) AS ones, sum(CASE WHEN rel = 0 THEN greatest(least(b, {CAP}) - a, 0) ELSE 0 END) AS zeros FROM spans GROUP BY doc_id) SELECT doc_id, CAST({CAP} - ones - zeros AS BIGINT) AS ignored, CAST(ones AS BIGINT) AS ones, CAST(zeros AS BIGINT) AS zeros FROM z")
def token_labels(spark, d):
    """-100 everywhere, 1 inside relevant spans and 0 inside others, cut at the end of a sequence of 2000 tokens."""
    x = P.staged(spans(spark, d), l=K.span_labels(F.lit(CAP), F.col("spans")))
    n = lambda v: F.size(F.filter("l", lambda y: y == v)).cast("long")
    return x.select("doc_id", n(-100).alias("ignored"), n(1).alias("ones"), n(0).alias("zeros"))


@query("token_labels_v1", f"{SPANS_D}, t AS (SELECT doc_id, unnest(range(0, CAST(ceil(max(b) / 4.0) AS BIGINT))) AS i FROM spans GROUP BY doc_id), hit AS (SELECT DISTINCT doc_id, unnest(range(CAST(a // 4 AS BIGINT), CAST((b - 1) // 4 + 1 AS BIGINT))) AS i FROM spans WHERE rel = 1 AND b > a) SELECT t.doc_id, count(*) FILTER (WHERE t.i < 1) AS ignored, count(*) FILTER (WHERE t.i >= 1 AND hit.i IS NOT NULL) AS ones, count(*) AS tokens FROM t LEFT JOIN hit ON hit.doc_id = t.doc_id AND hit.i = t.i GROUP BY t.doc_id")
def token_labels_v1(spark, d):
    """Offsets overlap: tokens of four characters over the whole text; those in front of the document are ignored, the document's
    are 0, and 1 where they touch a relevant span."""
    x = P.staged(spans(spark, d), tok=K.pieces(F.array_max(F.transform("spans", lambda s: s["b"])), 4))
    document = F.struct(F.lit(4).alias("a"), F.lit((1 << 31) - 1).alias("b"))
    x = P.staged(x, l=K.overlap_labels(F.col("tok"), F.filter("spans", lambda s: s["label"] == 1), document))
    n = lambda v: F.size(F.filter("l", lambda y: y == v)).cast("long")
    return x.select("doc_id", n(-100).alias("ignored"), n(1).alias("ones"), F.size("l").cast("long").alias("tokens"))
