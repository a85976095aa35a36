"""Labels and judgements by outside models: prompts, replies, what is read from them, and stored results.

A labeler or judge is a function from a prompt column to a reply column. python_replies() makes one of a
Python function from a prompt to a reply; it runs in Arrow batches on the executors, tries again after errors,
and leaves null where none of the tries succeeds.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.functions import arrays as A
from loomspan.functions import text as T
from loomspan.operators.prune import staged

Replies = Callable[[Column], Column]

# The steps of ever shorter prompts: characters of the question; chunks, and characters of each.
LADDER = ((256, None, None), (100, 10, 200), (100, 10, 100), (100, 5, 50))
NO_CHUNKS = "none"
# Words that tell what a reason to ignore a question is about.
ABOUT_QUESTION = ("question", "prompt", "query", "malformed", "incoherent", "blank", "empty")
MISSING_ANSWER = ("does not contain", "no answer", "answer missing", "passage")
BROKEN_QUESTION = ("malformed", "incoherent", "broken", "empty", "invalid")
# What stands for blank parts of a judge's prompt.
BLANKS = {"question": "(empty question)", "title": "(none)", "text": "(empty text)"}
INSTRUCTION = "Does the text answer the question? Reply in JSON with has_answer (0 or 1), answer_score (0 to 1) and reasoning."


def python_replies(fn: Callable[[str], str], tries: int = 3) -> Replies:
    def ask(prompt: str | None) -> str | None:
        for _ in range(tries if prompt is not None else 0):
            try:
                return fn(prompt)
            except Exception:  # noqa: BLE001, S112 - the outside model's errors of any kind mean another try
                continue
        return None

    @F.pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        return prompts.map(ask)

    return run


def prompt(question: Column, chunks: Column, width: int | None = None) -> Column:
    """The question, a line of dashes, and the numbered chunks, each on a line; longer ones than `width` are cut and dotted."""
    cut = (lambda x: x) if width is None else (lambda x: F.when(F.length(x) > width, F.concat(F.substring(x, 1, width), F.lit("..."))).otherwise(x))
    return F.concat(question, F.lit("\n---\n"), F.array_join(F.transform(chunks, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), cut(x))), "\n"))


def prompt_ladder(question: Column, chunks: Column, limit: int, size: Callable[[Column], Column] = F.length) -> Column:
    """struct<step, prompt>: the first of five ever shorter prompts whose size is within the limit; step 0 and null if none is."""
    tries = [prompt(F.substring(question, 1, a), chunks if n is None else F.slice(chunks, 1, n), w) for a, n, w in LADDER]
    tries.append(prompt(F.substring(question, 1, 100), F.array(F.lit(NO_CHUNKS))))

    def pick(all_: Column) -> Column:
        fits = F.transform(all_, lambda x: size(x) <= limit)
        return T.let(F.array_position(fits, True).cast("int"), lambda k: F.struct(k.alias("step"), F.get(all_, k - 1).alias("prompt")))

    return T.let(F.array(*tries), pick)


def judge_prompt(question: Column, text: Column, title: Column | None = None, instruction: str = INSTRUCTION) -> Column:
    """The instruction, question, title and text in tags; blank parts by their stand-ins."""
    def part(tag: str, value: Column) -> Column:
        filled = F.coalesce(F.nullif(T.strip(value), F.lit("")), F.lit(BLANKS[tag]))
        return F.concat(F.lit(f"<{tag}>"), filled, F.lit(f"</{tag}>"))

    return F.concat_ws("\n", F.lit(f"<instruction>{instruction}</instruction>"), part("question", question), part("title", title if title is not None else F.lit(None).cast("string")), part("text", text))


def accepted_reason(reason: Column) -> Column:
    """Whether a reason to ignore a question is about the question, and not only about an answer that isn't there."""
    r = F.lower(T.strip(reason))
    any_of = lambda words: F.greatest(*[F.contains(r, F.lit(w)) for w in words])
    return any_of(ABOUT_QUESTION) & ~(any_of(MISSING_ANSWER) & ~any_of(BROKEN_QUESTION))


def label_chunks(rows: DataFrame, labeler: Replies, question: str = "query", chunks: str = "chunks", limit: int = 32_000) -> DataFrame:
    """rows and `relevance`, one flag for each chunk, from the numbers in the labeler's reply; null where it gave none."""
    asked = staged(rows, prompt_=prompt_ladder(F.col(question), F.col(chunks), limit)["prompt"])
    asked = staged(asked, reply_=labeler(F.col("prompt_"))).drop("prompt_")
    n = F.size(chunks)
    flags = F.when(F.col("reply_").isNotNull(), A.to_flags(A.parse_indices(F.col("reply_"), n), n))
    return asked.withColumn("relevance", flags).drop("reply_")


def resume(rows: DataFrame, stored: DataFrame | None, key: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """work() on the rows without a stored result, together with the stored ones of the others. A key of `rows` has one stored
    row at most."""
    if stored is None:
        return work(rows)
    fresh = work(rows.join(stored.select(key), key, "left_anti"))
    return fresh.unionByName(stored.join(rows.select(key).distinct(), key, "left_semi"), allowMissingColumns=True)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The rows of both; where both have a key, the new one's."""
    return new.select(old.columns).unionByName(old.join(new.select(key), key, "left_anti"))


def judge_parse(reply: Column) -> Column:
    """struct(has_answer, answer_score, reasoning) of a judge's JSON reply; anything out of range is null."""
    j = F.from_json(reply, "has_answer int, contains_answer int, answer_score double, reasoning string, reason string")
    told = F.coalesce(j["has_answer"], j["contains_answer"])
    return F.struct(
        F.when(told.isin(0, 1), told).alias("has_answer"),
        F.when(j["answer_score"].between(0, 1), j["answer_score"]).alias("answer_score"),
        F.substring(F.coalesce(j["reasoning"], j["reason"]), 1, 16000).alias("reasoning"),
    )


def judge(rows: DataFrame, judge_fn: Replies, question: str = "question", text: str = "text", title: str | None = None) -> DataFrame:
    """rows and the judge's has_answer, answer_score and reasoning; null where it failed."""
    asked = judge_prompt(F.col(question), F.col(text), F.col(title) if title else None)
    told = staged(staged(rows, prompt_=asked), reply_=judge_fn(F.col("prompt_")))
    return told.withColumn("j_", judge_parse(F.col("reply_"))).select(*rows.columns, "j_.*")


def judge_summary(judged: DataFrame) -> DataFrame:
    """One row: how many have an answer, none, or failed; mean, median, least and largest score."""
    s = "answer_score"
    return judged.agg(
        F.count_if(F.col("has_answer") == 1).alias("answered"), F.count_if(F.col("has_answer") == 0).alias("unanswered"), F.count_if(F.col("has_answer").isNull()).alias("failed"),
        F.avg(s).alias("mean_score"), F.median(s).alias("median_score"), F.min(s).alias("least"), F.max(s).alias("most"),
    )


def teacher_scores(rows: DataFrame, key: str, texts: str, score: Callable[[DataFrame], DataFrame], into: str = "teacher_scores", overwrite: bool = False) -> DataFrame:
    """rows and `into`, an array with one score for each of the texts. score() adds a column `score` to (key, pos, text), one
    row a text, wherever and in whatever order it likes."""
    if into in rows.columns:
        if not overwrite:
            raise ValueError(f"there is a column {into}; overwrite it?")
        rows = rows.drop(into)
    pairs = rows.select(key, F.posexplode(texts).alias("pos", "text"))
    back = score(pairs).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "score"))), lambda x: x["score"]).alias(into))
    return rows.join(back, key, "left").withColumn(into, F.coalesce(into, F.array().cast("array<double>")))


IGNORE_INSTRUCTION = "Is the question itself malformed, incoherent or empty? Reply in JSON with ignore (0 or 1) and reason. A passage that doesn't answer is no reason."


def ignore_prompt(question: Column, positives: Column, instruction: str = IGNORE_INSTRUCTION) -> Column:
    """The instruction, the question and its numbered positive passages, (none) without any."""
    listed = F.array_join(F.transform(positives, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
    return F.concat_ws("\n", F.lit(instruction), F.concat(F.lit("Question: "), question), F.lit("Positive passages:"), F.coalesce(F.nullif(listed, F.lit("")), F.lit("(none)")))


def ignore_flags(passages: DataFrame, most_chars: int, ask: Replies | None = None) -> DataFrame:
    """qid, question, reason of the questions to leave out, from positive passages (qid, question, title, text): those whose
    longest passage, title and text, has more than most_chars characters, and those that a model flags with a reason that is
    about the question. A question's text is that of its first passage by title and text; its passages meet in one row."""
    whole = T.strip(F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit(""))))
    grouped = passages.withColumn("whole", whole).groupBy("qid").agg(F.min_by("question", F.struct("title", "text")).alias("question"), F.max(F.length("whole")).alias("longest"), F.array_sort(F.collect_list("whole")).alias("positives"))
    long_ = grouped.where(F.col("longest") > most_chars).select("qid", "question", F.concat(F.lit("positive passage of "), F.col("longest").cast("string"), F.lit(" characters")).alias("reason"))
    if ask is None:
        return long_
    asked = staged(grouped.where(F.col("longest") <= most_chars), prompt_=ignore_prompt(F.col("question"), F.col("positives")))
    told = staged(asked, reply_=ask(F.col("prompt_"))).withColumn("j_", F.from_json("reply_", "ignore int, reason string"))
    flagged = told.where((F.col("j_.ignore") == 1) & accepted_reason(F.col("j_.reason"))).select("qid", "question", T.strip(F.col("j_.reason")).alias("reason"))
    return long_.unionByName(flagged)
