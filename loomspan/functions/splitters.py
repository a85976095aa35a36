"""Which sentence splitter to use: by name, by language, or the caller's own.

A splitter is a function from a text column to a column of array<string>. python_splitter() makes one of a
Python function; it runs in Arrow batches.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspan.functions import text as T

Splitter = Callable[[Column], Column]

#: Languages of the flagship call; boundaries.learned_splitter() makes further ones from a corpus.
SPLITTERS: dict[str, Splitter] = {"auto": T.split_auto, "ja": T.split_japanese, "en": T.split_english}

# The languages with sentence models of their own, by ISO 639-1 code, and further names for them.
LANGUAGES = {
    "da": "danish", "de": "german", "en": "english", "es": "spanish", "et": "estonian", "fi": "finnish", "fr": "french", "el": "greek",
    "it": "italian", "nb": "norwegian", "nl": "dutch", "pl": "polish", "pt": "portuguese", "sl": "slovene", "sv": "swedish", "tr": "turkish",
}
ALIASES = {"no": "norwegian", "nn": "norwegian"}
# Sentence marks beside . ! ? by language.
MARKS = {"greek": ";·"}


def python_splitter(fn: Callable[[str], list[str]]) -> Splitter:
    """A splitter of a Python function from a text to its sentences; null texts stay null."""
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [str(s) for s in fn(t) if s is not None])

    return run


def resolve(splitter: Splitter | Mapping[str, Splitter] | None = None, language: str | None = None) -> Splitter:
    """The splitter to use: one from a mapping by language, the given one, or that of the language (none: auto)."""
    if isinstance(splitter, Mapping):
        if language is None:
            raise ValueError("a mapping of splitters needs a language")
        if language not in splitter:
            raise ValueError(f"no splitter for language {language!r}")
        return splitter[language]
    if splitter is not None:
        return splitter
    name = (language or "auto").lower()
    if name not in SPLITTERS:
        raise ValueError(f"no splitter for language {language!r}; there are {', '.join(SPLITTERS)}")
    return SPLITTERS[name]


def language_name(language: str) -> str | None:
    """The canonical name of a language with sentences of its own, None for any other."""
    known = language.lower()
    if known in LANGUAGES.values():
        return known
    return LANGUAGES.get(known) or ALIASES.get(known)


def for_conversion(language: str, learned: Callable[[str], Splitter] | None = None) -> Splitter:
    """The splitter that dataset conversion uses: stripped sentences, blanks dropped. Japanese by marks outside of brackets, the
    known languages by their marks or, if given, by learned(marks), a splitter with boundaries learned from a corpus
    (boundaries.learned_splitter); others by the generic rule, with a warning."""
    if language.lower() == "ja":
        return lambda c: T.stripped(T.split_japanese(c), c)
    name = language_name(language)
    if name is None:
        warnings.warn(f"no splitter for language {language!r}: the generic rule is used", stacklevel=2)
        return T.split_generic
    if learned is not None:
        known = learned(MARKS.get(name, ""))
        return lambda c: T.stripped(known(c), c)
    pattern = T.sentence_pattern(MARKS.get(name, ""))
    return lambda c: T.stripped(T.extract(c, pattern), c)
