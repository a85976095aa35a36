"""Chat formatting: a role state machine and a declarative template, in Catalyst expressions only.

Rows (conv_id, turn, role, text) become one formatted string per conversation plus its segments
(text, loss flag). Null text and null role are empty; a null conv_id is a conversation of its own;
equal turns are ordered by role, then text; null turns come first. Conversations with an invalid
order of roles are formatted all the same and flagged by `valid`.

Control strings inside texts are escaped reversibly: every `<` `\\`* `|` gets one backslash more, so a
formatted string holds `<|` only where the template put it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """turn_open + role + role_end + text + turn_close per turn; which roles carry loss; the role machine."""

    turn_open: str = "<|im_start|>"
    role_end: str = "\n"
    turn_close: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: state -> role -> next state; a role that is not listed leads to the state "bad".
    machine: dict = field(
        default_factory=lambda: {
            "start": {"system": "system", "user": "user"},
            "system": {"user": "user"},
            "user": {"assistant": "assistant", "tool": "tool"},
            "tool": {"assistant": "assistant", "tool": "tool"},
            "assistant": {"user": "user", "tool": "tool"},
        }
    )
    accepting: tuple[str, ...] = ("assistant",)


CHATML = Template()
NEWLINE_MARK = "<|nl|>"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", "<$1|")


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit(NEWLINE_MARK))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit(NEWLINE_MARK), F.lit("\n")))


def _next_state(state: Column, role: Column, template: Template) -> Column:
    out = F.lit("bad")
    for s, moves in template.machine.items():
        for r, t in moves.items():
            out = F.when((state == s) & (role == r), F.lit(t)).otherwise(out)
    return out


def chat_format(rows: DataFrame, template: Template = CHATML) -> DataFrame:
    """One row per conversation: conv_id, valid, segments (text, loss), formatted.

    The shuffle is the grouping by conv_id; each conversation is one output string, so its turns meet in
    one row by definition.
    """
    turns = rows.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            F.coalesce(F.col("role"), F.lit("")).alias("role"),
            F.coalesce(F.col("text"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t"), _turn_order).alias("turns"))
    state = F.aggregate("turns", F.lit("start"), lambda s, t: _next_state(s, t["role"], template))
    loss = lambda t: t["role"].isin(*template.loss_roles)
    segments = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                F.struct(F.concat(F.lit(template.turn_open), escape_role(t["role"]), F.lit(template.role_end)).alias("text"), F.lit(False).alias("loss")),
                F.struct(escape(t["text"]).alias("text"), loss(t).alias("loss")),
                F.struct(F.lit(template.turn_close).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    out = grouped.select("conv_id", state.isin(*template.accepting).alias("valid"), segments.alias("segments"))
    return out.select("*", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))


def _turn_order(a: Column, b: Column) -> Column:
    def cmp(x: Column, y: Column, rest: Column) -> Column:
        return F.when(x < y, -1).when(x > y, 1).otherwise(rest)

    inner = cmp(a["role"], b["role"], cmp(a["text"], b["text"], F.lit(0)))
    both = F.when(a["turn"].isNull() & b["turn"].isNull(), inner).when(a["turn"].isNull(), -1).when(b["turn"].isNull(), 1)
    return both.otherwise(cmp(a["turn"], b["turn"], inner))


def chat_parse(formatted: DataFrame, template: Template = CHATML, keep: tuple[str, ...] = ()) -> DataFrame:
    """The turns read back from `formatted`: conv_id, turns (role, text) and the columns of `keep`; inverse of chat_format."""
    parts = F.split("formatted", _quoted(template.turn_open))
    body = F.slice(parts, F.lit(2), F.size(parts) - 1)
    cut = lambda s: F.substring_index(s, template.role_end, 1)
    turns = F.transform(
        body,
        lambda s: F.struct(
            unescape_role(cut(s)).alias("role"),
            unescape(F.substr(s, F.length(cut(s)) + len(template.role_end) + 1, F.greatest(F.length(s) - F.length(cut(s)) - len(template.role_end) - len(template.turn_close), F.lit(0)))).alias("text"),
        ),
    )
    return formatted.select("conv_id", turns.alias("turns"), *keep)


def _quoted(s: str) -> str:
    return "\\Q" + s + "\\E"
