"""Text operators over whole documents, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.functions import arrays as A
from loomspan.functions import text as T
from loomspan.operators import labeling as L
from loomspan.operators import prune as P
from loomspan.operators import tokens as K
from loomspan.plans.base import d_all, d_digest, d_strip, d_stripped, digest, load, q, query, spread

# Texts with bullets, kana and line breaks, made from documents in both engines.
LISTED = r"replace(replace(coalesce(text, ''), '. ', '.' || chr(10) || '- '), ', ', chr(10) || '2) ')"
SOURCE = f"SELECT doc_id, coalesce(text, '') AS t, {LISTED} AS b, CASE WHEN doc_id % 3 = 0 THEN 'これはぺんです。' || coalesce(text, '') ELSE coalesce(text, '') END AS j FROM documents"


def src(spark, d):
    t = F.coalesce("text", F.lit(""))
    listed = F.replace(F.replace(t, F.lit(". "), F.lit(".\n- ")), F.lit(", "), F.lit("\n2) "))
    return spread(load(spark, d, "documents").select("doc_id", "text")).select("doc_id", t.alias("t"), listed.alias("b"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("これはぺんです。"), t)).otherwise(t).alias("j"))


def lists(name, column, fn, duck):
    """A query that returns the size and digest of an array made from one text column."""

    @query(name, f"WITH s AS ({SOURCE}), x AS (SELECT doc_id, {duck} AS p FROM s) SELECT doc_id, CAST(len(p) AS INT) AS n_parts, {d_digest('p')} AS parts_md5 FROM x")
    def run(spark, d):
        got = src(spark, d).select("doc_id", fn(F.col(column)).alias("p"))
        return got.select("doc_id", F.size("p").alias("n_parts"), digest(F.col("p")).alias("parts_md5"))

    return run


# Written by hand, apart from the library's own patterns: what the twins say must not follow from what they check.
SPACE_D = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
LINE_D = r"[^\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]*(?:\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}])|[^\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]+"
BULLET_D = rf"\A{SPACE_D}*(?:[-*•]+|\p{{Nd}}{{1,4}}[:.)]|[A-Za-z][:.)]){SPACE_D}+"
CHOMPED_D = r"regexp_replace({}, '[\r\n]+\z', '')"
SIMPLE_D = d_all("j", r"(?s).+?(?:[。！？!?\n]|\z)")
GENERIC_D = r"(?s).+?(?:[.!?\n]|\z)"
lists("split_simple", "j", T.split_simple, SIMPLE_D)
lists("split_regex_strip", "j", T.split_regex, d_stripped(SIMPLE_D, "j"))
lists("split_generic", "t", T.split_generic, d_stripped(d_all("t", GENERIC_D), "t"))
lists("py_splitlines", "b", T.split_lines, d_all("b", LINE_D))


def d_overlong(source: str, limit: int) -> str:
    """CTE `pieces` (doc_id, k, i, piece) of `source` (doc_id, k, rest): each step cuts one piece off what is left."""
    reach = f"substring(rest, 1, {limit})"
    cut = rf"CASE WHEN n <= {limit} AND i = 0 THEN n WHEN length(regexp_extract({reach}, '(?s)\A.+\n')) > 0 THEN length(regexp_extract({reach}, '(?s)\A.+\n')) WHEN length(regexp_extract({reach}, '(?s)\A.*[.?!;:\n]')) > 0 THEN length(regexp_extract({reach}, '(?s)\A.*[.?!;:\n]')) ELSE least(n, {limit}) END"
    return f"""steps AS (SELECT doc_id, k, 0 AS i, rest, length(rest) AS n, '' AS piece FROM ({source}) WHERE rest <> ''
  UNION ALL SELECT doc_id, k, i + 1, substring(rest, CAST(m + 1 AS INT)), n - m, substring(rest, 1, CAST(m AS INT)) FROM (SELECT *, CAST({cut} AS INT) AS m FROM steps WHERE n > 0)),
pieces AS (SELECT doc_id, k, i, piece FROM steps WHERE i > 0)"""


@query("split_overlong", f"WITH RECURSIVE s AS ({SOURCE}), {d_overlong('SELECT doc_id, 0 AS k, t AS rest FROM s', 300)}, x AS (SELECT doc_id, list(piece ORDER BY i) AS p FROM pieces GROUP BY doc_id) SELECT s.doc_id, CAST(coalesce(len(p), 0) AS INT) AS n_parts, {d_digest('coalesce(p, []::VARCHAR[])')} AS parts_md5 FROM s LEFT JOIN x USING (doc_id)")
def split_overlong(spark, d):
    got = src(spark, d).select("doc_id", T.split_overlong(F.col("t"), 300).alias("p"))
    return got.select("doc_id", F.size("p").alias("n_parts"), digest(F.col("p")).alias("parts_md5"))


def d_multiline(x: str, limit: int = 1200) -> str:
    full = f"list_filter({d_all(x, LINE_D)}, lambda y: {d_strip('y')} <> '')"
    return f"CASE WHEN contains({x}, chr(10)) AND len({full}) >= 2 AND length(regexp_replace({x}, '[^.?!]', '', 'g')) < len({full}) AND len(list_filter({full}, lambda y: length({d_strip('y')}) > {limit})) = 0 THEN {full} ELSE [{x}] END"


lists("split_multiline", "b", T.split_multiline, d_multiline("b"))
lists("split_multiline_strip", "b", lambda c: T.split_multiline(c, True), f"list_transform({d_multiline('b')}, lambda z: {d_strip('z')})")
NORMAL_D = f"list_filter(flatten(list_transform({SIMPLE_D.replace('j', 'b')}, lambda s: {d_multiline('s')})), lambda s: s <> '')"
lists("normalize_sentences", "b", lambda c: T.normalize(T.split_simple(c), c), f"CASE WHEN len({NORMAL_D}) > 0 THEN {NORMAL_D} ELSE [b] END")

BLOCKS = f"""s AS ({SOURCE}),
l AS (SELECT doc_id, unnest({d_all("b", LINE_D)}) AS line, generate_subscripts({d_all("b", LINE_D)}, 1) AS i FROM s),
g AS (SELECT *, sum(CASE WHEN i > 1 AND regexp_matches({CHOMPED_D.format("line")}, {q(BULLET_D)}) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM l),
k AS (SELECT doc_id, g, string_agg(line, '' ORDER BY i) AS blk FROM g GROUP BY doc_id, g),
blocks AS (SELECT doc_id, list(blk ORDER BY g) AS p FROM k GROUP BY doc_id)"""


@query("english_blocks", f"WITH {BLOCKS} SELECT s.doc_id, CAST(coalesce(len(p), 0) AS INT) AS n_parts, {d_digest('coalesce(p, []::VARCHAR[])')} AS parts_md5 FROM s LEFT JOIN blocks USING (doc_id)")
def english_blocks(spark, d):
    got = src(spark, d).select("doc_id", T.english_blocks(F.col("b")).alias("p"))
    return got.select("doc_id", F.size("p").alias("n_parts"), digest(F.col("p")).alias("parts_md5"))


MARKED_D = rf"(?s).+?(?:[.!?]+[\"')\]]*(?:{SPACE_D}+|\z)|\z)"
ENGLISH_SQL = f"""WITH RECURSIVE {BLOCKS},
raw AS (SELECT doc_id, list_filter(flatten(list_transform(p, lambda y: {d_all(f'regexp_replace(y, {q(rf"\A{SPACE_D}+")}, {q("")})', MARKED_D)})), lambda z: {d_strip('z')} <> '') AS p FROM blocks),
{d_overlong('SELECT doc_id, generate_subscripts(p, 1) AS k, unnest(p) AS rest FROM raw', 300)},
e AS (SELECT doc_id, list(piece ORDER BY k, i) AS p FROM pieces GROUP BY doc_id),
x AS (SELECT s.doc_id, s.j, CASE WHEN len(e.p) > 0 THEN e.p ELSE list_filter([{d_strip('b')}], lambda z: z <> '') END AS p FROM s LEFT JOIN e USING (doc_id))"""


@query("split_english", f"{ENGLISH_SQL} SELECT doc_id, CAST(len(p) AS INT) AS n_parts, {d_digest('p')} AS parts_md5 FROM x")
def split_english(spark, d):
    got = src(spark, d).select("doc_id", T.split_english(F.col("b"), 300).alias("p"))
    return got.select("doc_id", F.size("p").alias("n_parts"), digest(F.col("p")).alias("parts_md5"))


JAP_D = f"(length(j) > 0 AND len({d_all('j', T.KANA)}) >= ceil(length(j) / 500.0))"


@query("is_japanese", f"WITH s AS ({SOURCE}) SELECT doc_id, {JAP_D} AS japanese FROM s")
def is_japanese(spark, d):
    return src(spark, d).select("doc_id", T.is_japanese(F.col("j")).alias("japanese"))


@query("split_auto", f"{ENGLISH_SQL}, y AS (SELECT doc_id, CASE WHEN {JAP_D} THEN {SIMPLE_D} ELSE p END AS p FROM x) SELECT doc_id, CAST(len(p) AS INT) AS n_parts, {d_digest('p')} AS parts_md5 FROM y")
def split_auto(spark, d):
    """Kana texts by the simple splitter, others by the English one."""
    got = src(spark, d).select("doc_id", F.when(T.is_japanese(F.col("j")), T.split_simple(F.col("j"))).otherwise(T.split_english(F.col("b"), 300)).alias("p"))
    return got.select("doc_id", F.size("p").alias("n_parts"), digest(F.col("p")).alias("parts_md5"))


@query("py_strip", f"WITH s AS ({SOURCE}) SELECT doc_id, md5({d_strip('chr(9) || chr(160) || b || chr(28) || chr(12288)')}) AS stripped_md5 FROM s")
def py_strip(spark, d):
    return src(spark, d).select("doc_id", F.md5(T.strip(F.concat(F.lit("\t\xa0"), "b", F.lit("\x1c　")))).alias("stripped_md5"))


@query("is_bullet", f"WITH s AS ({SOURCE}), l AS (SELECT doc_id, unnest({d_all('b', LINE_D)}) AS line FROM s) SELECT doc_id, CAST(count(*) FILTER (WHERE regexp_matches({CHOMPED_D.format('line')}, {q(BULLET_D)})) AS INT) AS bullets FROM l GROUP BY doc_id")
def is_bullet(spark, d):
    lines = src(spark, d).select("doc_id", T.split_lines(F.col("b")).alias("l")).where(F.size("l") > 0)
    return lines.select("doc_id", F.size(F.filter("l", T.is_bullet)).alias("bullets"))


@query("first_line_title", f"""WITH s AS ({SOURCE}), l AS (SELECT doc_id, chr(10) || ' ' || chr(10) || b AS b0, {d_all("chr(10) || ' ' || chr(10) || b", LINE_D)} AS l FROM s),
a AS (SELECT *, list_position(list_transform(l, lambda y: {d_strip('y')} <> ''), true) AS pos FROM l)
SELECT doc_id, CASE WHEN pos > 0 THEN {CHOMPED_D.format('l[pos]')} ELSE '' END AS title, md5(CASE WHEN pos > 0 THEN coalesce(array_to_string(l[pos + 1:], ''), '') ELSE b0 END) AS rest_md5 FROM a""")
def first_line_title(spark, d):
    got = src(spark, d).select("doc_id", T.first_line_title(F.concat(F.lit("\n \n"), "b")).alias("x"))
    return got.select("doc_id", F.col("x.title").alias("title"), F.md5("x.rest").alias("rest_md5"))


@query("prefix_sentences", f"""WITH d AS (SELECT doc_id, list_filter(list_transform([' ' || coalesce(source, '') || chr(10), '', coalesce(lang, '') || '  '], lambda y: {d_strip('y')}), lambda y: y <> '') AS p FROM documents)
SELECT doc_id, CASE WHEN len(p) = 0 THEN '' ELSE array_to_string(p, '|') || chr(10) END AS prefix FROM d""")
def prefix_sentences(spark, d):
    titles = F.array(F.concat(F.lit(" "), F.coalesce("source", F.lit("")), F.lit("\n")), F.lit(""), F.concat(F.coalesce("lang", F.lit("")), F.lit("  ")))
    return load(spark, d, "documents").select("doc_id", F.array_join(T.prefix_sentences(titles), "|").alias("prefix"))


@query("manual_context", f"WITH s AS ({SOURCE}), p AS (SELECT doc_id, list_filter({d_all('b', LINE_D)}, lambda y: {d_strip('y')} <> '') AS p FROM s) SELECT doc_id, CAST(len(p) AS INT) AS kept, md5(coalesce(array_to_string(p, ''), '')) AS context_md5 FROM p")
def manual_context(spark, d):
    got = src(spark, d).select("doc_id", F.filter(T.split_lines(F.col("b")), T.filled).alias("p"))
    return got.select("doc_id", F.size("p").alias("kept"), F.md5(F.array_join("p", "")).alias("context_md5"))


@query("collect_sentences", f"WITH s AS ({SOURCE}), x AS (SELECT doc_id, list_concat(['T' || doc_id || chr(10)], CASE WHEN doc_id % 2 = 0 THEN ['a', 'b'] ELSE {SIMPLE_D} END) AS p FROM s) SELECT doc_id, CAST(len(p) AS INT) AS n_parts, {d_digest('p')} AS parts_md5 FROM x")
def collect_sentences(spark, d):
    """Prefix sentences, then the manual ones where given, else the split text."""
    manual = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("a"), F.lit(None), F.lit("b")))
    got = src(spark, d).select("doc_id", F.concat(F.array(F.concat(F.lit("T"), F.col("doc_id").cast("string"), F.lit("\n"))), F.array_compact(F.coalesce(manual, T.split_simple(F.col("j"))))).alias("p"))
    return got.select("doc_id", F.size("p").alias("n_parts"), digest(F.col("p")).alias("parts_md5"))


@query("extract_spans", f"""WITH s AS ({SOURCE}), x AS (SELECT doc_id, list_transform([[0, 10], [10, 40], [30, 20], [-5, 8], [length(t) - 3, length(t) + 9]], lambda p:
  substring(t, CAST(least(greatest(p[1], 0), length(t)) + 1 AS INT), CAST(greatest(least(greatest(p[2], 0), length(t)) - least(greatest(p[1], 0), length(t)), 0) AS INT))) AS p FROM s)
SELECT doc_id, CAST(len(p) AS INT) AS n_parts, {d_digest('p')} AS parts_md5 FROM x""")
def extract_spans(spark, d):
    n = F.length("t")
    spans = F.array(*[F.array(a, b) for a, b in ((F.lit(0), F.lit(10)), (F.lit(10), F.lit(40)), (F.lit(30), F.lit(20)), (F.lit(-5), F.lit(8)), (n - 3, n + 9))])
    got = src(spark, d).select("doc_id", T.extract_spans(F.col("t"), spans).alias("p"))
    return got.select("doc_id", F.size("p").alias("n_parts"), digest(F.col("p")).alias("parts_md5"))


@query("chunk_texts", f"""WITH s AS ({SOURCE}), x AS (SELECT doc_id, list_transform(range(0, CAST(ceil(length(t) / 40.0) AS BIGINT)), lambda i: {d_strip('substring(t, CAST(i * 40 + 1 AS INT), 40)')}) AS p FROM s)
SELECT doc_id, CAST(len(p) AS INT) AS n_parts, {d_digest('p')} AS parts_md5 FROM x""")
def chunk_texts(spark, d):
    """Chunks of 40 characters over the whole text, stripped; an empty and an inverted span between them say nothing."""
    spans = F.transform(K.pieces(F.length("t"), 40), lambda r: F.array(r["a"], r["b"]))
    odd = F.array(F.array(F.lit(3), F.lit(3)), F.array(F.lit(9), F.lit(4)))
    got = src(spark, d).select("doc_id", T.chunk_texts(F.col("t"), F.concat(odd, spans)).alias("p"))
    return got.select("doc_id", F.size("p").alias("n_parts"), digest(F.col("p")).alias("parts_md5"))


@query("text_to_spans", f"""WITH s AS ({SOURCE}), p AS (SELECT doc_id, t, {d_stripped(d_all('t', GENERIC_D), 't')} AS p FROM s),
f AS (SELECT doc_id, list_reduce(list_transform(p, lambda y: {{'txt': y, 'cur': 0, 'out': []::INT[]}}), lambda a, y: CASE
  WHEN y.txt = '' OR strpos(t, y.txt) = 0 THEN a
  WHEN strpos(substring(t, a.cur + 1), y.txt) > 0 THEN {{'txt': '', 'cur': CAST(a.cur + strpos(substring(t, a.cur + 1), y.txt) - 1 + length(y.txt) AS INT), 'out': list_concat(a.out, [CAST(a.cur + strpos(substring(t, a.cur + 1), y.txt) - 1 AS INT), CAST(a.cur + strpos(substring(t, a.cur + 1), y.txt) - 1 + length(y.txt) AS INT)])}}
  ELSE {{'txt': '', 'cur': CAST(strpos(t, y.txt) - 1 + length(y.txt) AS INT), 'out': list_concat(a.out, [CAST(strpos(t, y.txt) - 1 AS INT), CAST(strpos(t, y.txt) - 1 + length(y.txt) AS INT)])}} END,
  {{'txt': '', 'cur': 0, 'out': []::INT[]}}) AS r FROM p)
SELECT doc_id, CAST(len(r.out) / 2 AS INT) AS n_spans, {d_digest('r.out')} AS spans_md5 FROM f""")
def text_to_spans(spark, d):
    got = src(spark, d).select("doc_id", T.text_to_spans(F.col("t"), T.split_generic(F.col("t"))).alias("p"))
    return got.select("doc_id", F.size("p").alias("n_spans"), digest(F.flatten("p")).alias("spans_md5"))


@query("text_md5", "SELECT doc_id, md5(text) AS text_md5 FROM documents")
def text_md5(spark, d):
    return load(spark, d, "documents").select("doc_id", F.md5("text").alias("text_md5"))


@query("parse_indices", f"""WITH r AS (SELECT doc_id, list_sort(list_distinct(list_filter(list_transform({d_all("coalesce(text, '')", '[0-9]+')}, lambda x: TRY_CAST(x AS BIGINT) - 1), lambda i: i IS NOT NULL AND i >= 0 AND i < 60))) AS p FROM documents)
SELECT doc_id, coalesce(array_to_string(p, ','), '') AS indices, array_to_string(list_transform(range(0, 60), lambda i: CASE WHEN list_contains(p, i) THEN 1 ELSE 0 END), ',') AS flags FROM r""")
def parse_indices(spark, d):
    """The numbers of each document's text as places among sixty."""
    got = P.staged(load(spark, d, "documents").select("doc_id", "text"), p=A.parse_indices(F.coalesce("text", F.lit("")), F.lit(60)))
    return got.select("doc_id", F.array_join(F.transform("p", lambda x: x.cast("string")), ",").alias("indices"), F.array_join(F.transform(A.to_flags(F.col("p"), F.lit(60)), lambda x: x.cast("string")), ",").alias("flags"))


PARTS_D = d_stripped(d_all("t", GENERIC_D), "t")


def d_prompt(query_, parts, width=None):
    each = "x" if width is None else f"CASE WHEN length(x) > {width} THEN substring(x, 1, {width}) || '...' ELSE x END"
    return f"{query_} || chr(10) || '---' || chr(10) || coalesce(array_to_string(list_transform({parts}, lambda x, i: '[' || i || '] ' || {each}), chr(10)), '')"


@query("build_prompt", f"WITH s AS ({SOURCE}), p AS (SELECT doc_id, {PARTS_D} AS p FROM s) SELECT doc_id, md5({d_prompt(repr('which?'), 'p')}) AS prompt_md5 FROM p")
def build_prompt(spark, d):
    got = src(spark, d).select("doc_id", T.split_generic(F.col("t")).alias("p"))
    return got.select("doc_id", F.md5(L.prompt(F.lit("which?"), F.col("p"))).alias("prompt_md5"))


LADDER = [(256, None, None), (100, 10, 200), (100, 10, 100), (100, 5, 50)]


def d_ladder(question: str, parts: str) -> str:
    tries = [d_prompt(f"substring({question}, 1, {a})", parts if n is None else f"{parts}[1:{n}]", w) for a, n, w in LADDER]
    return f"[{', '.join(tries)}, {d_prompt(f'substring({question}, 1, 100)', "['none']")}]"


@query("prompt_ladder", f"""WITH s AS ({SOURCE}), p AS (SELECT doc_id, t, {PARTS_D} AS p FROM s), c AS (SELECT doc_id, {d_ladder('t', 'p')} AS c FROM p)
SELECT doc_id, CAST(coalesce(list_position(list_transform(c, lambda x: length(x) <= 1500), true), 0) AS INT) AS step, md5(coalesce(list_filter(c, lambda x: length(x) <= 1500)[1], '')) AS prompt_md5 FROM c""")
def prompt_ladder(spark, d):
    """The first of five ever shorter prompts that fits 1500 characters."""
    p = P.staged(src(spark, d), p=T.split_generic(F.col("t")))
    c = P.staged(p, c=L.prompt_ladder(F.col("t"), F.col("p"), 1500))
    return c.select("doc_id", "c.step", F.md5(F.coalesce("c.prompt", F.lit(""))).alias("prompt_md5"))


@query("judge_prompt", f"""SELECT doc_id, md5('<instruction>{L.INSTRUCTION}</instruction>' || chr(10) || '<question>' || coalesce(nullif({d_strip('lang')}, ''), '(empty question)') || '</question>' || chr(10) || '<title>' || coalesce(nullif({d_strip('source')}, ''), '(none)') || '</title>'
  || chr(10) || '<text>' || coalesce(nullif({d_strip('text')}, ''), '(empty text)') || '</text>') AS prompt_md5 FROM documents""")
def judge_prompt(spark, d):
    return load(spark, d, "documents").select("doc_id", F.md5(L.judge_prompt(F.col("lang"), F.col("text"), F.col("source"))).alias("prompt_md5"))


@query("ignore_reason_rule", r"""WITH r AS (SELECT conv_id, turn, lower(coalesce(text, '')) AS r FROM conversations), k AS (SELECT conv_id, turn, regexp_matches(r, 'question|prompt|query|malformed|incoherent|blank|empty') AS a, regexp_matches(r, 'does not contain|no answer|answer missing|passage') AS m, regexp_matches(r, 'malformed|incoherent|broken|empty|invalid') AS b FROM r)
SELECT conv_id, turn, a AND NOT (m AND NOT b) AS accepted FROM k""")
def ignore_reason_rule(spark, d):
    """A flag is accepted if its reason, here a turn's text, is about the question, not only about a missing answer."""
    return load(spark, d, "conversations").select("conv_id", "turn", L.accepted_reason(F.coalesce("text", F.lit(""))).alias("accepted"))


@query("norm_title", f"WITH x AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE ' ' || source END AS t, [' a', '', lang] AS l FROM documents) SELECT doc_id, nullif({d_strip('t')}, '') AS title, nullif(coalesce(array_to_string(list_filter(list_transform(l, lambda y: {d_strip('y')}), lambda y: y <> ''), ' '), ''), '') AS joined FROM x")
def norm_title(spark, d):
    t = F.when(F.col("doc_id") % 3 == 0, F.lit(None).cast("string")).when(F.col("doc_id") % 3 == 1, "  ").otherwise(F.concat(F.lit(" "), "source"))
    parts = F.array(F.lit(" a"), F.lit(""), F.col("lang"))
    return load(spark, d, "documents").select("doc_id", T.title(t).alias("title"), T.title_of(parts).alias("joined"))


@query("text_similarity", r"""WITH x AS (SELECT doc_id, trim(lower(regexp_replace(text, '[ \t\n\r\x0B\x0C]+', ' ', 'g'))) AS a, trim(lower(regexp_replace(substring(text, CAST(length(text) // 3 + 1 AS INT), CAST(length(text) // 3 AS INT)), '[ \t\n\r\x0B\x0C]+', ' ', 'g'))) AS b FROM documents WHERE text IS NOT NULL)
SELECT doc_id, a = b AS equal, contains(a, b) AS contained, len(list_filter(string_split(b, ' '), lambda w: NOT contains(replace(a, ' ', ''), w))) = 0 AS words_contained FROM x""")
def text_similarity(spark, d):
    """A text against its middle third."""
    third = F.floor(F.length("text") / 3).cast("int")
    x = spread(load(spark, d, "documents").where("text is not null").select("doc_id", "text")).withColumn("part", F.substr("text", third + 1, third))
    return x.select("doc_id", T.similar(F.col("text"), F.col("part")).alias("s")).select("doc_id", "s.*")
