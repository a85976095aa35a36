"""Sentence boundaries learned from the corpus, and the operators that work on a vocabulary file's tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.functions import text as T
from loomspan.operators import boundaries as B
from loomspan.operators import prune as P
from loomspan.operators.models import ModelScorer, overlap_model
from loomspan.operators.tokenizers import FileTokenizer
from loomspan.plans.base import d_all, digest, load, q, query, spread
from loomspan.plans.q_prune import contexts

# The twin's own patterns and limits.
TOKEN_D = r"[\p{L}\p{N}]+(?:[.'’-][\p{L}\p{N}]+)*\.?"
NUMBER_D = r"\A\p{N}+(?:[.,:-]\p{N}+)*\z"
LL_D = lambda k, n, p: f"({k} * ln(least(greatest({p}, 1e-12), 1 - 1e-12)) + ({n} - {k}) * ln(1 - least(greatest({p}, 1e-12), 1 - 1e-12)))"
MET_D = lambda k, a, b, n: f"-2 * ({LL_D(k, a, f'{b} / {n}')} + {LL_D(f'({b} - {k})', f'({n} - {a})', f'{b} / {n}')} - {LL_D(k, a, f'{k} / {a}')} - {LL_D(f'({b} - {k})', f'({n} - {a})', f'({b} - {k}) / greatest({n} - {a}, 1)')})"
LEXICON_D = f"""WITH w AS (SELECT {d_all("coalesce(text, '')", TOKEN_D)} AS w FROM documents),
t AS (SELECT w, list_transform(list_transform(w, lambda x: lower(regexp_replace(x, '\\.\\z', ''))), lambda x: CASE WHEN regexp_matches(x, {q(NUMBER_D)}) THEN '##' ELSE x END) AS t FROM w),
e AS (SELECT unnest(t) AS type, unnest(list_transform(w, lambda x: ends_with(x, '.'))) AS dot, unnest(list_concat(t[2:], [NULL])) AS next FROM t WHERE len(t) > 0),
c AS (SELECT type, CASE WHEN dot THEN next END AS next, count(*) FILTER (WHERE dot) AS dotted, count(*) FILTER (WHERE NOT dot) AS plain FROM e GROUP BY ALL),
y AS (SELECT type, sum(dotted)::DOUBLE AS dotted, sum(plain)::DOUBLE AS plain, sum(dotted + plain)::DOUBLE AS n FROM c GROUP BY type),
z AS (SELECT greatest(sum(n), 1) AS total, sum(dotted) AS periods FROM y),
l AS (SELECT *, length(type) - length(replace(type, '.', '')) AS points FROM y, z WHERE dotted > 0 AND NOT regexp_matches(type, {q(NUMBER_D)}) AND type <> '##'),
short AS (SELECT type, n, -2 * ({LL_D('dotted', 'n', 'periods / total')} - {LL_D('dotted', 'n', '0.99')}) * exp(-(length(type) - points)) * (points + 1) * pow(length(type) - points, -plain) AS score FROM l),
abbr AS (SELECT * FROM short WHERE score >= 0.3),
held AS (SELECT c.type, c.next, c.dotted::DOUBLE AS n, (a.type IS NOT NULL OR regexp_matches(c.type, '\\A\\p{{L}}\\z') OR c.type = '##') AS held FROM c LEFT JOIN abbr a USING (type) WHERE c.dotted > 0 AND c.next IS NOT NULL),
coll AS (SELECT h.type, h.next, h.n, {MET_D('h.n', 'a.n', 'b.n', 'total')} AS score FROM held h JOIN y a ON a.type = h.type JOIN y b ON b.type = h.next, z WHERE held AND h.n > 1 AND h.n * total > a.n * b.n),
breaks AS (SELECT greatest(coalesce(sum(n), 0), 1) AS breaks FROM held WHERE NOT held),
st AS (SELECT next AS type, sum(n) AS n FROM held WHERE NOT held AND next <> '##' GROUP BY next),
starts AS (SELECT st.type, st.n, {MET_D('st.n', 'breaks', 'b.n', 'total')} AS score FROM st JOIN y b ON b.type = st.type, z, breaks WHERE st.n * total > breaks * b.n)
SELECT 'abbreviation' AS kind, type, CAST(NULL AS VARCHAR) AS next, n::BIGINT AS n, round(score, 3) AS score FROM abbr
UNION ALL SELECT 'collocation', type, next, n::BIGINT, round(score, 3) FROM coll WHERE score >= 7.88
UNION ALL SELECT 'starter', type, NULL, n::BIGINT, round(score, 3) FROM starts WHERE score >= 30""".replace("\\\\", "\\")


@query("boundary_lexicon", LEXICON_D)
def boundary_lexicon(spark, d):
    """Abbreviations, collocations and sentence starters of all documents, with their scores."""
    return B.lexicon(spread(load(spark, d, "documents").select("text"))).select("kind", "type", "next", "n", F.round("score", 3).alias("score"))


@query("split_learned")
def split_learned(spark, d):
    """Sentences of every document by the boundaries learned from all of them."""
    docs = spread(load(spark, d, "documents").select("doc_id", "text"))
    s = P.staged(B.split_learned(docs, B.lexicon(docs)), s=F.col("sentences"))
    return s.select("doc_id", F.size("s").alias("n_sentences"), digest(F.col("s")).alias("sentences_md5"))


def vocabulary(name: str = "byte_bpe_50k.json") -> FileTokenizer:
    import public_tokenizers

    return FileTokenizer(public_tokenizers.path(name))


TOKEN_WINDOW = 512
#: Tokens and sentences take several times the memory of their text.
TOKEN_PART_BYTES = 1 << 20


@query("prune_tokenized")
def prune_tokenized(spark, d):
    """prune with windows and fragments in a vocabulary's tokens."""
    got = P.prune(contexts(spark, d), None, window=TOKEN_WINDOW, tokenizer=vocabulary(), language="en", cut_fragments="error")
    return got.select("query_idx", "context_idx", F.md5("pruned_context").alias("pruned_md5"), F.round("reranking_score", 6).alias("reranking_score"), F.size("kept_sentences").alias("n_kept"), F.size("kept").alias("n_sentences"), F.size("block_scores").alias("n_blocks"))


@query("prune_by_model")
def prune_by_model(spark, d):
    """prune by a model of token blocks, in batches over rows."""
    got = P.prune(contexts(spark, d), None, window=TOKEN_WINDOW, scorer=ModelScorer(overlap_model, vocabulary(), start=50256, separator=50256), language="en", threshold=0.5, cut_fragments="error")
    return got.select("query_idx", "context_idx", F.md5("pruned_context").alias("pruned_md5"), F.round("reranking_score", 5).alias("reranking_score"), F.size("kept_sentences").alias("n_kept"), F.size("kept").alias("n_sentences"))


@query("token_labels_tokenized")
def token_labels_tokenized(spark, d):
    """Labels of each document's tokens: 1 in sentences that hold a digit, 0 in others, -100 outside; sentences found by their
    places in the text, tokens by theirs."""
    x = spread(load(spark, d, "documents").where("text is not null").select("doc_id", "text"), part=TOKEN_PART_BYTES)
    x = P.staged(x, s=T.split_english(F.col("text")))
    x = P.staged(x, digit=F.transform("s", lambda t: t.rlike(r"\p{N}").cast("int")))
    x = P.staged(x, labels=vocabulary().sentence_labels(F.col("text"), F.col("s"), F.col("digit")))
    n = lambda v: F.size(F.filter("labels", lambda y: y == v)).alias({1: "ones", 0: "zeros", -100: "ignored"}[v])
    return x.select("doc_id", F.size("labels").alias("n_tokens"), n(1), n(0), n(-100))
