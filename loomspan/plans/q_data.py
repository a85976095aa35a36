"""Scans, conversion, duplicates, sampling and mixing, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.functions import arrays as A
from loomspan.functions import text as T
from loomspan.operators import datasets as D
from loomspan.operators import labeling as L
from loomspan.operators import prune as P
from loomspan.plans.base import d_all, d_digest, d_strip, digest, load, query, spread
from loomspan.plans.q_text import LINE_D, PARTS_D
from loomspan.sources import datasets as S

#: Triplets: a user turn, the assistant turn behind it, two other assistant texts of the table as negatives.
TRIPLETS = """u AS (SELECT conv_id, turn, text AS question FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn, text AS answer FROM conversations WHERE role = 'assistant'),
tri AS (SELECT u.conv_id, u.turn, u.question, a.answer, n.text AS negative_1, CASE WHEN u.turn % 4 = 0 THEN '' ELSE o.text END AS negative_2, n.text || ' x' AS neg_10
  FROM u JOIN a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  LEFT JOIN conversations n ON n.conv_id = u.conv_id + 1 AND n.turn = 0 LEFT JOIN conversations o ON o.conv_id = u.conv_id + 2 AND o.turn = 0)"""


def triplets(spark, d):
    c = load(spark, d, "conversations")
    u = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    first = c.where("turn = 0")
    n = first.select((F.col("conv_id") - 1).alias("conv_id"), F.col("text").alias("negative_1"))
    o = first.select((F.col("conv_id") - 2).alias("conv_id"), F.col("text").alias("o"))
    got = u.join(a, ["conv_id", "turn"]).join(n, "conv_id", "left").join(o, "conv_id", "left")
    return got.select("conv_id", "turn", "question", "answer", "negative_1", F.when(F.col("turn") % 4 == 0, "").otherwise(F.col("o")).alias("negative_2"), F.concat("negative_1", F.lit(" x")).alias("neg_10"))


NEGS_D = "list_filter([nullif(neg_10, ''), nullif(negative_1, ''), nullif(negative_2, '')], lambda x: x IS NOT NULL)"


@query("triplet_extract", f"WITH {TRIPLETS} SELECT conv_id, turn, md5(question) AS query_md5, md5(answer) AS positive_md5, {d_digest(NEGS_D)} AS negatives_md5 FROM tri")
def triplet_extract(spark, d):
    return D.extract_fields(triplets(spark, d), "conv_id", "turn").select("conv_id", "turn", F.md5("query").alias("query_md5"), F.md5("positive").alias("positive_md5"), digest(F.col("negatives")).alias("negatives_md5"))


@query("build_record", f"WITH {TRIPLETS} SELECT 'my_convs_all:train:' || (conv_id * 1000 + turn) AS id, md5(question) AS query_md5, CAST(len({NEGS_D}) + 1 AS INT) AS n_texts, array_to_string(list_transform(list_concat([answer], {NEGS_D}), lambda x, i: CASE WHEN i = 1 THEN 1 ELSE 0 END), '') AS labels FROM tri")
def build_record(spark, d):
    e = D.extract_fields(triplets(spark, d), "conv_id", "turn").withColumn("number", F.col("conv_id") * 1000 + F.col("turn"))
    r = D.build_records(e, D.slug("my/convs", "all"), "train", "number")
    return r.select("id", F.md5("query").alias("query_md5"), F.size("texts").alias("n_texts"), F.array_join(F.transform("labels", lambda x: x.cast("string")), "").alias("labels"))


@query("convert_triplets", f"WITH {TRIPLETS}, t AS (SELECT conv_id, turn, list_concat([answer], {NEGS_D}) AS texts FROM tri), e AS (SELECT conv_id, turn, unnest(texts) AS t, generate_subscripts(texts, 1) AS k FROM t), p AS (SELECT conv_id, turn, k, {PARTS_D} AS p FROM e) SELECT 'conv:train:' || (conv_id * 1000 + turn) AS id, CAST(sum(len(list_filter(p, lambda x: x <> ''))) AS BIGINT) AS n_spans, count(*) AS n_texts FROM p GROUP BY conv_id, turn")
def convert_triplets(spark, d):
    """Records with the character spans of each text's sentences."""
    e = D.extract_fields(triplets(spark, d), "conv_id", "turn").withColumn("number", F.col("conv_id") * 1000 + F.col("turn"))
    s = D.build_records(e, "conv", "train", "number")
    return s.select("id", F.aggregate("context_spans", F.lit(0).cast("long"), lambda a, x: a + F.size(x)).alias("n_spans"), F.size("context_spans").cast("long").alias("n_texts"))


@query("scan_split", "SELECT doc_id, lang AS split FROM documents WHERE lang = 'de'")
def scan_split(spark, d):
    """One split of a table whose split is a column (a partition column when written)."""
    return S.load_split(load(spark, d, "documents").withColumnRenamed("lang", "split"), "de").select("doc_id", "split")


@query("scan_head_n", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 50")
def scan_head_n(spark, d):
    """The first n rows of a stable id: the feature is the limit."""
    return S.head(load(spark, d, "documents"), 50, "doc_id").select("doc_id", "lang")


@query("resume_unscored", "SELECT doc_id FROM documents ANTI JOIN (SELECT doc_id FROM labels) USING (doc_id)")
def resume_unscored(spark, d):
    """Rows without a stored result: what a resumed run still has to do."""
    return load(spark, d, "documents").select("doc_id").join(load(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("merge_results", "SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, coalesce(n.value, o.value) AS value FROM (SELECT doc_id, n_chars AS value FROM documents WHERE lang = 'de') n FULL JOIN (SELECT doc_id, CAST(quality AS BIGINT) AS value FROM labels) o ON n.doc_id = o.doc_id")
def merge_results(spark, d):
    """Cached and fresh results; fresh ones win."""
    fresh = load(spark, d, "documents").where("lang = 'de'").select("doc_id", F.col("n_chars").alias("value"))
    return L.upsert(load(spark, d, "labels").select("doc_id", F.col("quality").cast("long").alias("value")), fresh, "doc_id")


@query("resume_work", "SELECT d.doc_id, coalesce(CAST(l.quality AS BIGINT), length(d.text)) AS value FROM documents d LEFT JOIN labels l USING (doc_id)")
def resume_work(spark, d):
    """Stored results where there are any, work on the other rows alone."""
    stored = load(spark, d, "labels").select("doc_id", F.col("quality").cast("long").alias("value"))
    return L.resume(load(spark, d, "documents").select("doc_id", "text"), stored, "doc_id", lambda rows: rows.select("doc_id", F.length("text").cast("long").alias("value")))


@query("ignore_upsert", "SELECT coalesce(n.qid, o.qid) AS qid, coalesce(n.reason, o.reason) AS reason FROM (SELECT item_id AS qid, 'old' AS reason FROM benchmark) o FULL JOIN (SELECT DISTINCT conv_id AS qid, 'new' AS reason FROM conversations) n ON n.qid = o.qid")
def ignore_upsert(spark, d):
    """The benchmark's ids as the old list, the conversations' as the new one."""
    old = load(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.lit("old").alias("reason"))
    return L.upsert(old, load(spark, d, "conversations").select(F.col("conv_id").alias("qid"), F.lit("new").alias("reason")).distinct(), "qid")


@query("ignore_antijoin", "SELECT conv_id, turn FROM conversations ANTI JOIN (SELECT item_id * 3 AS conv_id FROM benchmark) USING (conv_id)")
def ignore_antijoin(spark, d):
    return load(spark, d, "conversations").select("conv_id", "turn").join(load(spark, d, "benchmark").select((F.col("item_id") * 3).alias("conv_id")), "conv_id", "left_anti")


@query("ignore_semijoin", "SELECT conv_id, turn FROM conversations SEMI JOIN (SELECT item_id * 3 AS conv_id FROM benchmark) USING (conv_id)")
def ignore_semijoin(spark, d):
    return load(spark, d, "conversations").select("conv_id", "turn").join(load(spark, d, "benchmark").select((F.col("item_id") * 3).alias("conv_id")), "conv_id", "left_semi")


@query("drop_ids_antijoin", "SELECT doc_id FROM documents ANTI JOIN (SELECT doc_id FROM labels WHERE toxic = 1) USING (doc_id)")
def drop_ids_antijoin(spark, d):
    return load(spark, d, "documents").select("doc_id").join(load(spark, d, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_anti")


@query("rename_teacher", 'SELECT vec_id, round(embedding[1], 6) AS teacher_score FROM embeddings')
def rename_teacher(spark, d):
    """A dotted teacher column becomes teacher_score."""
    e = load(spark, d, "embeddings").select("vec_id", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("teacher_scores.first"))
    return e.withColumnRenamed("teacher_scores.first", "teacher_score")


@query("min_items_filter", "SELECT conv_id, count(*) AS n_items FROM conversations GROUP BY conv_id HAVING count(*) >= 4")
def min_items_filter(spark, d):
    return load(spark, d, "conversations").groupBy("conv_id").agg(F.count("turn").alias("n_items")).where("n_items >= 4")


@query("null_query_skip", "SELECT doc_id FROM documents WHERE lang IS NOT NULL AND length(text) > 0")
def null_query_skip(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "lang", F.filter(F.array("text"), lambda t: F.length(t) > 0).alias("texts"))
    return D.asked(docs, "lang", "texts").select("doc_id")


@query("attach_relevance", "SELECT d.doc_id, coalesce(CAST(l.toxic AS VARCHAR), '') AS relevance FROM documents d LEFT JOIN labels l USING (doc_id)")
def attach_relevance(spark, d):
    l = load(spark, d, "labels").select("doc_id", F.array("toxic").alias("r"))
    met = D.attach_by_id(load(spark, d, "documents").select("doc_id"), l, "doc_id", "r")
    return met.select("doc_id", F.array_join(F.transform("r", lambda x: x.cast("string")), ",").alias("relevance"))


@query("zip_truncate", """WITH c AS (SELECT conv_id, coalesce(list(length(text) ORDER BY turn) FILTER (WHERE role = 'user' AND text IS NOT NULL), []) AS a, coalesce(list(length(text) ORDER BY turn) FILTER (WHERE role = 'assistant' AND text IS NOT NULL), []) AS b FROM conversations GROUP BY conv_id)
SELECT conv_id, CAST(least(len(a), len(b)) AS INT) AS n, coalesce(array_to_string(list_transform(range(1, least(len(a), len(b)) + 1), lambda i: a[i] || '-' || b[i]), ' '), '') AS zipped FROM c""")
def zip_truncate(spark, d):
    """Lengths of a conversation's user turns beside those of its assistant turns, as far as both go."""
    side = lambda role: F.transform(F.array_sort(F.collect_list(F.when((F.col("role") == role) & F.col("text").isNotNull(), F.struct("turn", "text")))), lambda x: F.length(x["text"]))
    c = load(spark, d, "conversations").groupBy("conv_id").agg(side("user").alias("a"), side("assistant").alias("b"))
    z = c.select("conv_id", A.zip_shortest(F.col("a"), F.col("b")).alias("z"))
    return z.select("conv_id", F.size("z").alias("n"), F.array_join(F.transform("z", lambda x: F.concat_ws("-", x["a"].cast("string"), x["b"].cast("string"))), " ").alias("zipped"))


@query("unnest_passages", "SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS label, md5(text) AS text_md5 FROM conversations WHERE role <> 'system'")
def unnest_passages(spark, d):
    """Positives and negatives as flat rows with their label."""
    c = load(spark, d, "conversations").where("role <> 'system'")
    side = lambda ok: F.array_sort(F.collect_list(F.when(ok, F.struct("turn", "text"))))
    long = c.groupBy("conv_id").agg(side(F.col("role") == "assistant").alias("p"), side(F.col("role") != "assistant").alias("n"))
    return D.unnest_passages(long, "p", "n", "conv_id").select("conv_id", "turn", "label", F.md5("text").alias("text_md5"))


@query("dup_stats", "SELECT count(*) AS total, count(DISTINCT md5(text)) AS n_unique, count(*) - count(DISTINCT md5(text)) AS duplicates, CASE WHEN count(*) = 0 THEN 0.0 ELSE round((count(*) - count(DISTINCT md5(text))) / count(*), 6) END AS ratio FROM documents WHERE text IS NOT NULL")
def dup_stats(spark, d):
    return D.duplicate_stats(load(spark, d, "documents")).withColumn("ratio", F.round("ratio", 6))


def dedup_rows(spark, d):
    """Rows of texts for the frequency filter: the lines of each document, in doc_id order."""
    return load(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("idx"), T.split_lines(F.col("text")).alias("texts"))


#: The definition itself, one row after the other; lines that one row alone has can't have been seen.
FILTERED_D = f"""l AS (SELECT doc_id, unnest({d_all('text', LINE_D)}) AS t FROM documents WHERE text IS NOT NULL),
often AS (SELECT t FROM l GROUP BY t HAVING count(DISTINCT doc_id) > 1),
own AS (SELECT doc_id, list(md5(t)) AS h FROM l SEMI JOIN often USING (t) GROUP BY doc_id),
rows AS (SELECT d.doc_id, coalesce(own.h, []::VARCHAR[]) AS h, row_number() OVER (ORDER BY d.doc_id) AS k FROM documents d LEFT JOIN own USING (doc_id) WHERE d.text IS NOT NULL),
run AS (SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS idx, CAST(0 AS BIGINT) AS dup_count, true AS kept, []::VARCHAR[] AS seen
  UNION ALL SELECT k, doc_id, dup, dup <= @N@, CASE WHEN dup <= @N@ THEN list_distinct(list_concat(seen, h)) ELSE seen END
  FROM (SELECT rows.k, rows.doc_id, rows.h, run.seen, CAST(len(list_filter(rows.h, lambda x: list_contains(run.seen, x))) AS BIGINT) AS dup FROM run JOIN rows ON rows.k = run.k + 1)),
done AS (SELECT idx, dup_count, kept FROM run WHERE k > 0)"""


@query("freq_filter", f"WITH RECURSIVE {FILTERED_D.replace('@N@', '1')} SELECT * FROM done")
def freq_filter(spark, d):
    return D.frequency_filter(dedup_rows(spark, d), 1)


@query("dup_histogram", f"WITH RECURSIVE {FILTERED_D.replace('@N@', '3')} SELECT dup_count, count(*) AS total, count(*) FILTER (WHERE kept) AS kept, count(*) FILTER (WHERE NOT kept) AS removed FROM done GROUP BY dup_count")
def dup_histogram(spark, d):
    return D.dup_histogram(D.frequency_filter(dedup_rows(spark, d), 3))


@query("group_by_query", "SELECT conv_id, count(*) AS n_rows, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def group_by_query(spark, d):
    g = D.rows_of_query(load(spark, d, "conversations"), "conv_id", "turn", "role", into="r")
    return g.select("conv_id", F.col("n").alias("n_rows"), F.array_join(F.transform("r", lambda x: x["role"]), ",").alias("roles"))


@query("flag_too_long", f"SELECT conv_id, max(length({d_strip("'T' || chr(10) || text")})) AS longest, max(length({d_strip("'T' || chr(10) || text")})) > 800 AS too_long FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def flag_too_long(spark, d):
    return D.long_groups(load(spark, d, "conversations").where("role = 'assistant'"), "conv_id", F.concat(F.lit("T\n"), "text"), 800)


@query("score_stats", "SELECT round(avg(x), 5) AS mean, round(stddev_pop(x), 5) AS std, round(min(x), 6) AS least, round(max(x), 6) AS most, count(*) AS n FROM (SELECT CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)")
def score_stats(spark, d):
    s = D.score_stats(load(spark, d, "embeddings"), "embedding")
    return s.select(*[F.round(c, k).alias(c) for c, k in (("mean", 5), ("std", 5), ("least", 6), ("most", 6))], "n")


#: Relevance of a document's sentences for its language's name: whether they have its first letter; five sentences an item.
ITEMS_D = f"s AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(substring(source, 1, 1), 'e') AS key FROM documents), p AS (SELECT doc_id, key, {PARTS_D} AS p FROM s), f AS (SELECT doc_id, list_transform(p, lambda x: CASE WHEN contains(x, key) THEN 1 ELSE 0 END) AS f FROM p), r AS (SELECT doc_id, list_transform(range(0, len(f), 5), lambda i: f[i + 1:i + 5]) AS r FROM f)"


def item_flags(spark, d):
    """doc_id and r, array<array<int>>: the flags of each item's sentences."""
    s = spread(load(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"), F.coalesce(F.substring("source", 1, 1), F.lit("e")).alias("key")))
    f = P.staged(s, f=F.transform(T.split_generic(F.col("t")), lambda x: F.contains(x, F.col("key")).cast("int")))
    return f.select("doc_id", A.chunks(F.col("f"), 5).alias("r"))


@query("item_relevance", f"WITH {ITEMS_D}, e AS (SELECT doc_id, unnest(r) AS v FROM r) SELECT doc_id, count(*) AS n_items, round(sum(list_sum(v) / len(v)), 6) AS mean_sum, count(*) FILTER (WHERE list_sum(v) > 0) AS n_nonzero FROM e GROUP BY doc_id")
def item_relevance(spark, d):
    x = P.staged(item_flags(spark, d).where(F.size("r") > 0), m=D.item_means(F.col("r")))
    return x.select("doc_id", F.size("r").cast("long").alias("n_items"), F.round(F.aggregate("m", F.lit(0.0), lambda a, v: a + v), 6).alias("mean_sum"), F.size(F.filter("r", lambda v: F.exists(v, lambda y: y != 0))).cast("long").alias("n_nonzero"))


#: Numbers of each document's sentences: how many commas they have.
COMMAS_D = f"s AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), p AS (SELECT doc_id, {PARTS_D} AS p FROM s), x AS (SELECT doc_id, p, list_transform(p, lambda y: CAST(len(regexp_extract_all(y, ',')) AS INT)) AS r FROM p)"


def commas(spark, d):
    """doc_id, p (sentences) and r (their commas)."""
    docs = spread(load(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t")))
    return P.staged(docs, p=T.split_generic(F.col("t"))).select("doc_id", "p", F.transform("p", lambda x: F.regexp_count(x, F.lit(","))).alias("r"))


@query("filter_items", f"WITH {ITEMS_D}, e AS (SELECT doc_id, unnest(r) AS v, generate_subscripts(r, 1) AS i FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(list_sum(v) / len(v), 9) DESC, i) AS n, count(*) OVER (PARTITION BY doc_id) AS c FROM e WHERE list_sum(v) > 0) SELECT doc_id, string_agg('t' || (i - 1), ',' ORDER BY i) AS items FROM k WHERE n <= 3 AND c >= 3 GROUP BY doc_id")
def filter_items(spark, d):
    """Items without a relevant sentence go, the three most relevant stay (ties: the earlier), in their order; rows with fewer go."""
    x = item_flags(spark, d).withColumn("texts", F.transform("r", lambda v, i: F.concat(F.lit("t"), i.cast("string"))))
    return D.filter_items(x, "r", 3, ["texts"]).select("doc_id", F.array_join("texts", ",").alias("items"))


@query("filter_items_keep_first", f"WITH {ITEMS_D}, e AS (SELECT doc_id, unnest(r) AS v, generate_subscripts(r, 1) AS i FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN i = 1 THEN 0 ELSE 1 END, round(list_sum(v) / len(v), 9), i) AS n, count(*) OVER (PARTITION BY doc_id) AS c FROM e WHERE list_sum(v) > 0 OR i = 1) SELECT doc_id, string_agg('t' || (i - 1), ',' ORDER BY i) AS items FROM k WHERE n <= 3 AND c >= 3 GROUP BY doc_id")
def filter_items_keep_first(spark, d):
    """The first item always, then the two least relevant ones that have a relevant sentence."""
    x = item_flags(spark, d).where(F.size("r") > 0).withColumn("texts", F.transform("r", lambda v, i: F.concat(F.lit("t"), i.cast("string"))))
    return D.filter_items(x, "r", 3, ["texts"], reverse=True, keep_first=True).select("doc_id", F.array_join("texts", ",").alias("items"))


def items_sql(labels: bool) -> str:
    group = "CASE WHEN r[i + 1] = 1 THEN 0 ELSE 1 END" if labels else "1"
    key = "CASE WHEN r[i + 1] = 1 THEN lpad(CAST(i AS VARCHAR), 10, '0') ELSE md5('7:' || doc_id || ':' || i) END" if labels else "md5('7:' || doc_id || ':' || i)"
    return f"WITH {COMMAS_D}, e AS (SELECT doc_id, r, p, unnest(range(0, len(r))) AS i FROM x WHERE len(r) >= 4), k AS (SELECT doc_id, i, r[i + 1] AS v, p[i + 1] AS t, row_number() OVER (PARTITION BY doc_id ORDER BY {group}, {key}, i) AS n FROM e) SELECT doc_id, string_agg(CAST(v AS VARCHAR), ',' ORDER BY i) AS labels, md5(string_agg(t, chr(31) ORDER BY i)) AS texts_md5 FROM k WHERE n <= 4 GROUP BY doc_id"


def items(spark, d, labels):
    """Four sentences of each document, those with one comma first where that is the label."""
    x = commas(spark, d).select("doc_id", F.col("r").alias("labels"), F.col("p").alias("texts"))
    got = D.sample_items(x, 4, ["labels", "texts"] if labels else ["texts", "labels"], 7, "doc_id", "labels" if labels else None)
    return got.select("doc_id", F.array_join(F.transform("labels", lambda v: v.cast("string")), ",").alias("labels"), F.md5(F.array_join("texts", "\x1f")).alias("texts_md5"))


query("sample_items", items_sql(True))(lambda spark, d: items(spark, d, True))
query("sample_items_nolabel", items_sql(False))(lambda spark, d: items(spark, d, False))

LOT = lambda seed, key="doc_id": f"md5('{seed}:' || {key})"


@query("sample_rows", f"SELECT doc_id FROM documents QUALIFY row_number() OVER (ORDER BY {LOT(11)}, doc_id) <= 60")
def sample_rows(spark, d):
    return D.sample_rows(load(spark, d, "documents").select("doc_id"), 11, 60, "doc_id")


@query("sample_fraction", f"SELECT doc_id FROM documents QUALIFY row_number() OVER (ORDER BY {LOT(12)}, doc_id) <= greatest(1, ceil(0.125 * (SELECT count(*) FROM documents)))")
def sample_fraction(spark, d):
    x = load(spark, d, "documents").select("doc_id")
    return D.sample_rows(x, 12, D.wanted(0.125, x.count()), "doc_id")


@query("shuffle_take", f"SELECT doc_id, row_number() OVER (ORDER BY {LOT(13)}, doc_id) AS place FROM documents QUALIFY place <= 40")
def shuffle_take(spark, d):
    return D.shuffle_take(load(spark, d, "documents").select("doc_id"), 13, 40, "doc_id").select("doc_id", F.col("place").cast("long").alias("place"))


@query("carve_splits", f"WITH n AS (SELECT count(*) AS n FROM documents), z AS (SELECT n, greatest(0, least(least(greatest(1, round_even(n * 0.01, 0)), 5000), (n - 1) // 2)) AS v FROM n), y AS (SELECT v, greatest(0, least(least(greatest(1, round_even((n - v) * 0.01, 0)), 5000), (n - v - 1) // 2)) AS t FROM z) SELECT doc_id, CASE WHEN r <= v THEN 'validation' WHEN r <= v + t THEN 'test' ELSE 'train' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY {LOT(14)}, doc_id) AS r FROM documents), y")
def carve_splits(spark, d):
    return D.carve_splits(load(spark, d, "documents").select("doc_id"), 14, "doc_id")


@query("validation_split", f"SELECT doc_id, r <= (SELECT count(*) FROM documents) // 10 AS validation FROM (SELECT doc_id, row_number() OVER (ORDER BY {LOT(15)}, doc_id) AS r FROM documents)")
def validation_split(spark, d):
    return D.validation_split(load(spark, d, "documents").select("doc_id"), 0.1, 15, "doc_id")


@query("upsample", f"SELECT doc_id, unnest([1, 2]) AS copy FROM documents UNION ALL SELECT doc_id, 3 AS copy FROM (SELECT doc_id, row_number() OVER (ORDER BY {LOT(16)}, doc_id) AS r FROM documents) WHERE r <= round_even(0.25 * (SELECT count(*) FROM documents), 0)")
def upsample(spark, d):
    return D.upsample(load(spark, d, "documents").select("doc_id"), 2.25, 16, "doc_id")


@query("mix_union", "SELECT doc_id AS id, text, 'documents' AS origin FROM documents UNION ALL SELECT item_id, text, 'benchmark' FROM benchmark UNION ALL SELECT conv_id * 1000 + turn, text, 'conversations' FROM conversations")
def mix_union(spark, d):
    """Bag union over the common columns of several datasets."""
    parts = [
        load(spark, d, "documents").withColumnRenamed("doc_id", "id").withColumn("origin", F.lit("documents")),
        load(spark, d, "benchmark").withColumnRenamed("item_id", "id").withColumn("origin", F.lit("benchmark")),
        load(spark, d, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn")).withColumn("origin", F.lit("conversations")),
    ]
    return D.mix(parts)


#: Two datasets: documents by twos and a half, and a fifth of the benchmark; a twentieth of the mix for validation.
@query("prepare_mix", f"""WITH d AS (SELECT doc_id AS id, 'docs' AS origin, row_number() OVER (ORDER BY {LOT(42)}, doc_id) AS r, count(*) OVER () AS n FROM documents),
a AS (SELECT id, origin, unnest([1, 2]) AS copy FROM d UNION ALL SELECT id, origin, 3 FROM d WHERE r <= round_even(0.5 * n, 0)),
b AS (SELECT item_id AS id, 'bench' AS origin, 1 AS copy FROM (SELECT item_id, row_number() OVER (ORDER BY md5('42:' || item_id || ':1'), item_id) AS r, count(*) OVER () AS n FROM benchmark) WHERE r <= greatest(1, ceil(0.2 * n))),
m AS (SELECT * FROM a UNION ALL SELECT * FROM b), z AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || id || ':' || copy), id, copy, origin) AS r, count(*) OVER () AS n FROM m)
SELECT origin, r <= n // 20 AS validation, count(*) AS n FROM z GROUP BY ALL""")
def prepare_mix(spark, d):
    """Upsample, sample, union, and a validation split by lot."""
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("docs").alias("origin"))
    bench = load(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.lit("bench").alias("origin"))
    train, held = D.prepare([D.Part(docs, upsample=2.5), D.Part(bench, n_samples=0.2)], validation=0.05)
    both = train.withColumn("validation", F.lit(False)).unionByName(held.withColumn("validation", F.lit(True)))
    return both.groupBy("origin", "validation").agg(F.count(F.lit(1)).alias("n"))


@query("ignore_flags", f"""WITH p AS (SELECT conv_id AS qid, arg_min(text, turn) AS question FROM conversations WHERE role = 'user' GROUP BY conv_id), w AS (SELECT c.conv_id AS qid, {d_strip("c.role || chr(10) || coalesce(c.text, '')")} AS whole FROM conversations c WHERE role = 'assistant'),
g AS (SELECT qid, max(length(whole)) AS longest FROM w GROUP BY qid) SELECT qid, question, 'positive passage of ' || longest || ' characters' AS reason FROM g JOIN p USING (qid) WHERE longest > 600""")
def ignore_flags(spark, d):
    """Questions with a positive passage that is too long; no model is asked."""
    c = load(spark, d, "conversations")
    asked = c.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("question"))
    passages = c.where("role = 'assistant'").join(asked, "conv_id").select(F.col("conv_id").alias("qid"), "question", F.col("role").alias("title"), "text")
    return L.ignore_flags(passages, 600)


@query("norm_relevance", f"WITH {COMMAS_D}, y AS (SELECT x.doc_id, CASE WHEN lang IS NULL THEN NULL ELSE r END AS v FROM x JOIN documents USING (doc_id)) SELECT doc_id, array_to_string(list_transform(range(0, 4), lambda i: CASE WHEN v IS NULL THEN 0 WHEN len(v) = 4 THEN CASE WHEN v[i + 1] <> 0 THEN 1 ELSE 0 END WHEN list_contains(v, i) THEN 1 ELSE 0 END), '') AS flags FROM y")
def norm_relevance(spark, d):
    """Commas of a document's sentences as relevance of four places: a mask where there are four sentences, else indices."""
    x = commas(spark, d).join(load(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    v = F.when(F.col("lang").isNotNull(), F.col("r"))
    return x.select("doc_id", F.array_join(F.transform(A.norm_relevance(v, F.lit(4)), lambda y: y.cast("string")), "").alias("flags"))


@query("mask_to_indices", f"WITH {COMMAS_D} SELECT doc_id, coalesce(array_to_string(CASE WHEN len(r) = 4 AND len(list_filter(r, lambda y: y > 1)) = 0 THEN list_transform(list_filter(range(0, 4), lambda i: r[i + 1] = 1), lambda i: CAST(i AS INT)) ELSE r END, ','), '') AS indices FROM x")
def mask_to_indices(spark, d):
    return commas(spark, d).select("doc_id", F.array_join(F.transform(A.mask_to_indices(F.col("r"), F.lit(4)), lambda x: x.cast("string")), ",").alias("indices"))


@query("to_flags", f"WITH {COMMAS_D} SELECT doc_id, array_to_string(list_transform(range(0, 5), lambda i: CASE WHEN list_contains(r, i) THEN 1 ELSE 0 END), '') AS flags FROM x")
def to_flags(spark, d):
    return commas(spark, d).select("doc_id", F.array_join(F.transform(A.to_flags(F.col("r"), F.lit(5)), lambda x: x.cast("string")), "").alias("flags"))


@query("collate_pairs", f"WITH {ITEMS_D}, x AS (SELECT doc_id, list_transform(r, lambda v: list_sum(v)) AS r FROM r), e AS (SELECT doc_id, unnest(r) AS label, generate_subscripts(r, 1) - 1 AS doc_index, len(r) AS docs_per_query FROM x) SELECT doc_id AS batch_index, doc_index, CAST(label AS DOUBLE) AS target, docs_per_query FROM e")
def collate_pairs(spark, d):
    """One row per pair: ranking targets as (row, column, value), no padding."""
    x = item_flags(spark, d).select(F.col("doc_id").alias("batch_index"), F.transform("r", lambda v: F.aggregate(v, F.lit(0), lambda a, y: a + y)).alias("labels"))
    return D.flatten_pairs(x, "batch_index", "labels")


@query("window_average", "SELECT conv_id, turn, round(avg(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS mean_last_10 FROM conversations")
def window_average(spark, d):
    got = D.moving_average(load(spark, d, "conversations"), "conv_id", "turn", F.length("text"))
    return got.select("conv_id", "turn", F.round("mean", 6).alias("mean_last_10"))
