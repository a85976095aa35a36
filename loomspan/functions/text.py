"""Text functions with Python's string semantics, as Catalyst expressions.

Patterns are written for Java's engine, which tries the parts of a class one after the other with each character: single
characters below 256 are one part, rare ranges lie behind one range around them, and nothing is read again where a run can
only end in one place: its quantifier is possessive, or greedy where whatever follows it always matches, as Java goes through
those in a tighter loop. `\\z` stands for the end of a text.
"""

from __future__ import annotations

from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspan.functions.arrays import let, scan

# The characters that str.strip removes, and the line breaks of str.splitlines.
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
SPACE = r"[[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]]\x09\x0A\x0B\x0C\x0D\x1C\x1D\x1E\x1F\x20\x{85}\x{A0}]"
BREAK = r"\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}-\x{2029}"
# Kana letters.
KANA = r"[\x{3041}-\x{3096}\x{30A1}-\x{30FA}\x{31F0}-\x{31FF}\x{FF71}-\x{FF9D}]"

# What ends a line for rstrip, a list item's mark at a line's start, and sentence marks.
LINE_END = "\r\n"
BULLET = rf"\A{SPACE}*(?:[-*•]+|\p{{Nd}}{{1,4}}[:.)]|[A-Za-z][:.)]){SPACE}+"
SIMPLE = r"(?s).[^。！？!?\n]*+(?:[。！？!?\n]|\z)"
GENERIC = r"(?s).[^.!?\n]*+(?:[.!?\n]|\z)"

LINES = rf"[^{BREAK}]+(?:\n|\r\n?|[{BREAK}])?|\n|\r\n?|[{BREAK}]"


def sentence_pattern(more: str = "") -> str:
    """A sentence: up to a run of marks, closing quotes and brackets, and white space or the end. Runs with something else
    behind them lie inside."""
    mark, closing = rf"[.!?{more}]", r"[\"')\]]*+"
    rest = rf"[^.!?{more}]*+"
    return rf"(?s).{rest}(?:{mark}++(?!{closing}(?:{SPACE}|\z)){rest})*+(?:{mark}++{closing}(?:{SPACE}++|\z)|\z)"


ENGLISH = sentence_pattern()
TERM = r"[\p{L}\p{N}]+"
OVERLONG = 1200


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def filled(c: Column) -> Column:
    """Whether a text has anything but white space; reads it up to there."""
    return F.ltrim(c, F.lit(SPACES)) != ""


def extract(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def split_lines(c: Column) -> Column:
    """Lines with their ends."""
    return extract(c, LINES)


def chomp(c: Column) -> Column:
    """A line without the carriage returns and line feeds at its end."""
    return F.rtrim(c, F.lit(LINE_END))


def is_japanese(c: Column, window: int = 500, least: int = 1) -> Column:
    return (F.length(c) > 0) & (F.regexp_count(c, F.lit(KANA)) >= F.ceil(F.length(c) / window) * least)


def split_simple(c: Column) -> Column:
    """Sentences by their marks or line ends, white space kept; nothing from an empty text."""
    return extract(c, SIMPLE)


# Brackets and quotes by their sides, and the marks that end a Japanese sentence.
OPENING, CLOSING = "「『（【〈《〔［｛“(", "」』）】〉》〕］｝”)"
JAPANESE_MARKS = "。！？!?．｡"
#: Up to a run of marks, one bracket, or a line end. A point between digits is no mark.
JAPANESE = rf"(?s).*?(?:(?:(?<!\p{{N}})．|．(?!\p{{N}})|[。！？!?｡])[{JAPANESE_MARKS}…♪☆]*|[{OPENING}{CLOSING}]|\n|\z)"


def split_japanese(c: Column) -> Column:
    """Sentences by their marks and line ends, white space kept. Marks inside brackets or quotes hold no sentence's end, however
    deep they are nested; a line end closes all that was left open. Closing brackets behind a mark of the outside, blanks and
    faces in brackets stay with their sentence. Nothing from an empty text."""
    side = lambda p: F.when(p.rlike(rf"[{OPENING}]\z"), 1).when(p.rlike(rf"[{CLOSING}]\z"), -1).when(p.endswith("\n"), 0)

    def cut(pieces: Column) -> Column:
        # depth behind each piece; null turns mean no bracket
        turns = F.transform(pieces, side)
        depth = scan(turns, F.lit(0), "int", lambda d, t: F.when(t == 0, F.lit(0)).otherwise(F.greatest(d + F.coalesce(t, F.lit(0)), F.lit(0))), lambda d, got: got)

        def ends(depths: Column) -> Column:
            def over(p: Column, i: Column) -> Column:
                return p.endswith("\n") | ((F.get(depths, i) == 0) & p.rlike(rf"[{JAPANESE_MARKS}…♪☆]\z") & F.get(turns, i).isNull())

            stop = F.filter(F.transform(pieces, lambda p, i: F.when(over(p, i) | (i == F.size(pieces) - 1), i)), lambda i: i.isNotNull())
            return let(stop, lambda at: F.transform(at, lambda i, k: F.array_join(F.slice(pieces, F.coalesce(F.get(at, k - 1), F.lit(-1)) + 2, i - F.coalesce(F.get(at, k - 1), F.lit(-1))), "")))

        return let(depth, ends)

    return let(F.filter(extract(c, JAPANESE), lambda p: p != ""), cut)


def stripped(parts: Column, whole: Column) -> Column:
    """Stripped non-blank parts; the stripped whole, if it isn't blank, where none is left."""
    got = F.filter(F.transform(parts, strip), lambda s: s != "")
    return let(got, lambda g: F.when(F.size(g) > 0, g).otherwise(F.filter(F.array(strip(whole)), lambda s: s != "")))


def split_regex(c: Column) -> Column:
    return stripped(extract(c, SIMPLE), c)


def split_generic(c: Column) -> Column:
    return stripped(extract(c, GENERIC), c)


def is_bullet(line: Column) -> Column:
    return chomp(line).rlike(BULLET)


def english_blocks(c: Column) -> Column:
    """Blocks of lines: a bullet line opens a new one."""
    def cut(lines: Column) -> Column:
        n = F.size(lines)
        first = F.filter(F.transform(lines, lambda x, i: F.when((i == 0) | is_bullet(x), i)), lambda i: i.isNotNull())
        return let(first, lambda at: F.transform(at, lambda i, k: F.array_join(F.slice(lines, i + 1, F.coalesce(F.get(at, k + 1), n) - i), "")))

    return let(split_lines(c), cut)


def overlong_pattern(limit: int) -> str:
    """Pieces of at most `limit` characters, up to the last line end in reach that isn't the first character, else up to the
    last sentence mark in reach, else as long as they can be. The rest of a text is cut in the same way."""
    def upto(a: int, n: int) -> str:  # one repeat: of two, every pair of lengths is tried where no mark is in reach
        return f".{{{a},{n}}}" if n else ""

    return rf"(?s){upto(1, limit - 1)}\n|{upto(0, limit - 1)}[.?!;:\n]|{upto(1, limit)}"


def split_overlong(c: Column, limit: int = OVERLONG) -> Column:
    """A text of more than `limit` characters in pieces, white space kept; nothing from an empty text."""
    return F.when(c == "", F.array().cast("array<string>")).when(F.length(c) <= limit, F.array(c)).otherwise(extract(c, overlong_pattern(limit)))


def english_splitter(limit: int = OVERLONG):
    """A splitter by rules: sentences inside bullet blocks, trailing white space kept, blank ones dropped, overlong ones cut."""
    if limit <= 0:
        raise ValueError("limit must be positive")
    return lambda c: split_english(c, limit)


def split_english(c: Column, limit: int = OVERLONG, sentences=None) -> Column:
    """Sentences inside bullet blocks, by `sentences`, a function from a block to its sentences, or else by their marks."""
    sentences = sentences or (lambda b: extract(b, ENGLISH))
    return finished(F.flatten(F.transform(trimmed_blocks(c), sentences)), c, limit)


def trimmed_blocks(c: Column) -> Column:
    """Bullet blocks without the white space in front."""
    return F.transform(english_blocks(c), lambda b: F.ltrim(b, F.lit(SPACES)))


def finished(sentences: Column, c: Column, limit: int = OVERLONG) -> Column:
    """Sentences without blank ones, overlong ones cut; the stripped text, if it isn't blank, where none is left."""
    got = F.flatten(F.transform(F.filter(sentences, filled), lambda s: split_overlong(s, limit)))
    return let(got, lambda g: F.when(F.size(g) > 0, g).otherwise(F.filter(F.array(strip(c)), lambda s: s != "")))


def split_auto(c: Column) -> Column:
    """The Japanese splitter for texts with kana, else the English one."""
    return F.when(is_japanese(c), split_japanese(c)).otherwise(split_english(c))


def split_multiline(c: Column, strip_sentences: bool = False, limit: int = OVERLONG) -> Column:
    """Non-blank lines of a sentence that is a list of lines: it has a line feed, two non-blank lines at least, fewer sentence
    marks than those, and none of them too long without the white space around it."""
    trimmed = strip if strip_sentences else (lambda x: x)

    def choose(lines: Column) -> Column:
        n = F.size(lines)
        marks = F.length(F.regexp_replace(c, "[^.?!]+", ""))
        # bytes are known without reading a line, and are no fewer than its characters
        short = F.forall(lines, lambda x: (F.octet_length(x) <= limit) | (F.length(strip(x)) <= limit))
        return F.when((n > 1) & short & (marks < n), F.transform(lines, strip) if strip_sentences else lines).otherwise(F.array(trimmed(c)))

    return F.when(F.contains(c, F.lit("\n")), let(F.filter(split_lines(c), filled), choose)).otherwise(F.array(trimmed(c)))


def normalize(sentences: Column, whole: Column, strip_sentences: bool = False) -> Column:
    """Sentences split by lines, empty ones dropped; where none is left the whole text (stripped if it is asked for and leaves
    something)."""
    got = F.filter(F.flatten(F.transform(F.array_compact(sentences), lambda s: split_multiline(s, strip_sentences))), lambda s: s != "")
    rest = F.when(filled(whole), strip(whole)).otherwise(whole) if strip_sentences else whole
    return let(got, lambda g: F.when(F.size(g) > 0, g).otherwise(F.array(rest)))


def first_line_title(c: Column) -> Column:
    """struct(title, rest): the first non-blank line and what follows it; all blank: '' and the text unchanged."""
    def cut(lines: Column, at: Column) -> Column:
        return F.when(
            at > 0,
            F.struct(chomp(F.get(lines, at - 1)).alias("title"), F.array_join(F.slice(lines, at + 1, F.greatest(F.size(lines) - at, F.lit(0))), "").alias("rest")),
        ).otherwise(F.struct(F.lit("").alias("title"), c.alias("rest")))

    return let(split_lines(c), lambda lines: let(first_filled(lines), lambda at: cut(lines, at)))


def first_item_title(items: Column) -> Column:
    """struct(title, rest) of a list of sentences: its first non-blank one and those behind it; all blank: '' and the list."""
    def cut(at: Column) -> Column:
        return F.when(at > 0, F.struct(chomp(F.get(items, at - 1)).alias("title"), F.slice(items, at + 1, F.greatest(F.size(items) - at, F.lit(0))).alias("rest"))).otherwise(
            F.struct(F.lit("").alias("title"), items.alias("rest"))
        )

    return let(first_filled(items), cut)


def first_filled(items: Column) -> Column:
    """The place, from 1, of the first item that isn't blank; 0 if there is none."""
    return F.array_position(F.transform(items, filled), True).cast("int")


def prefix_sentences(titles: Column) -> Column:
    """Stripped titles, blank ones dropped; the last one gets exactly one line end."""
    got = F.filter(F.transform(F.array_compact(titles), strip), lambda s: s != "")
    return let(got, lambda g: F.transform(g, lambda s, i: F.when(i == F.size(g) - 1, F.concat(s, F.lit("\n"))).otherwise(s)))


#: Characters of the stretches in which a text is kept for many cuts.
STRETCH = 512


def cut_up(text: Column) -> Column:
    """The text in stretches, for cut(): a place of a long text is found without reading all that is in front of it."""
    return extract(text, f"(?s).{{1,{STRETCH}}}")


def cut(stretches: Column, start: Column, end: Column) -> Column:
    """Characters [start, end) of a text that cut_up() made stretches of; empty where end <= start."""
    first = F.floor(start / STRETCH).cast("int")
    count = F.floor((end - 1) / STRETCH).cast("int") - first + 1
    own = F.array_join(F.slice(stretches, first + 1, F.greatest(count, F.lit(0))), "")
    return F.when(end > start, F.substr(own, start - first * STRETCH + 1, end - start)).otherwise(F.lit(""))


def extract_spans(text: Column, spans: Column) -> Column:
    """Substrings of [start, end) spans, clamped; inverted ones are empty; no spans: the whole text."""
    inside = lambda x, n: F.least(F.greatest(x, F.lit(0)), n)
    got = let(F.length(text), lambda n: let(cut_up(text), lambda parts: F.transform(spans, lambda s: cut(parts, inside(s[0], n), inside(s[1], n)))))
    return F.when(F.size(spans) > 0, got).otherwise(F.array(text))


def chunk_texts(text: Column, spans: Column) -> Column:
    """The stripped texts of [start, end) spans that hold something."""
    return let(cut_up(text), lambda parts: F.transform(F.filter(spans, lambda s: s[1] > s[0]), lambda s: strip(cut(parts, s[0], s[1]))))


def text_to_spans(text: Column, sentences: Column) -> Column:
    """[start, end) of each stripped sentence, sought from the end of the one before, else from the start; absent ones
    are skipped. Null sentences have no places, in a null text none is found."""

    @F.arrow_udf("array<array<int>>")
    def run(texts: pa.Array, sentences: pa.Array) -> pa.Array:
        upto, spans, _ = places(texts, sentences)
        inner = pa.ListArray.from_arrays(pa.array(np.arange(0, len(spans) + 1, 2, dtype=np.int32)), pa.array(spans))
        return pa.ListArray.from_arrays(pa.array(upto), inner, mask=sentences.is_null())

    return run(text, sentences)


def places(texts: pa.Array, sentences: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For text_to_spans: how many places there are up to each row, their starts and ends in turn, and which of all the rows'
    sentences each is of."""
    upto, spans, which, k = array("i", [0]), array("i"), array("i"), 0
    some = 256  # rows are Python's for a while, not the whole batch
    for t, own in chain.from_iterable(zip(texts[i : i + some].to_pylist(), sentences[i : i + some].to_pylist()) for i in range(0, len(texts), some)):
        cursor = 0
        for i, s in enumerate(own or () if t is not None else (), k):
            s = s.strip() if s is not None else ""
            if not s:
                continue
            at = t.find(s, cursor)
            if at < 0 and (at := t.find(s)) < 0:
                continue
            cursor = at + len(s)
            spans.append(at)
            spans.append(cursor)
            which.append(i)
        k += len(own or ())
        upto.append(len(which))
    return tuple(np.array(x, np.int32) for x in (upto, spans, which))


def text_to_spans_inside(text: Column, sentences: Column) -> Column:
    """The same as an expression, for lambda functions, in which no Python runs; several times as dear."""
    def found(parts: Column) -> Column:
        def step(cursor: Column, sent: Column) -> Column:
            def place(s: Column) -> Column:
                span = lambda k: F.array(k, k + F.length(s))
                seek = lambda start: F.call_function("locate", s, text, start)
                far = let(let(seek(cursor + 1), lambda k: F.when(k > 0, k).otherwise(seek(F.lit(1)))), lambda k: F.when(k > 0, span(k - 1)))
                # sentences mostly follow one another: a look at what comes next spares reading the text from its start
                near = F.call_function("locate", s, cut(parts, cursor, cursor + F.length(s) + 64), F.lit(1))
                return F.when(s != "", let(near, lambda k: F.when(k > 0, span(cursor + k - 1)).otherwise(far)))

            return let(strip(sent), place)

        return scan(sentences, F.lit(0), "array<int>", step, lambda cursor, span: F.coalesce(F.get(span, F.lit(1)), cursor))

    return F.filter(let(cut_up(text), found), lambda x: x.isNotNull())


def similar(text: Column, part: Column) -> Column:
    """struct<equal, contained, words_contained>: how a text and a decoded part of it agree, white space and case aside; words
    are looked for in the text without its blanks, as tokens may cut them."""
    flat = lambda c: F.trim(F.lower(F.regexp_replace(c, r"[ \t\n\r\x0B\x0C]+", " ")))

    def told(a: Column, b: Column) -> Column:
        joined = F.replace(a, F.lit(" "), F.lit(""))
        return let(joined, lambda j: F.struct((a == b).alias("equal"), F.contains(a, b).alias("contained"), F.forall(F.split(b, " "), lambda w: F.contains(j, w)).alias("words_contained")))

    return let(flat(text), lambda a: let(flat(part), lambda b: told(a, b)))


def terms(c: Column) -> Column:
    """Distinct lower-case words, the units of the lexical scorer."""
    return F.array_distinct(extract(F.lower(c), TERM))


def title(c: Column) -> Column:
    """A stripped title; null for a blank one."""
    return F.nullif(strip(c), F.lit(""))


def title_of(parts: Column) -> Column:
    """The stripped parts of a title that aren't blank, joined by blanks; null without any."""
    return F.nullif(F.array_join(F.filter(F.transform(F.array_compact(parts), strip), lambda s: s != ""), " "), F.lit(""))
