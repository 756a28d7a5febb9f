"""Column expressions shared by the corpus operators: white space, words, normalised text.

White space is the fixed set ``[\\x20\\x09-\\x0D]`` everywhere in this subpackage
(space, tab, line feed, vertical tab, form feed, carriage return); a word is a
maximal run of other characters.  Null text counts as empty text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS_CHARS = " \t\n\x0b\x0c\r"
WS = r"[\x20\x09-\x0D]"


def text_of(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def single_spaced(col: Column) -> Column:
    """Every run of white space becomes one space.  Runs that already are one
    space are left out of the pattern, so plain prose is scanned, not rewritten."""
    return F.regexp_replace(text_of(col), rf"{WS}{{2,}}|[\x09-\x0D]", " ")


def words_of(col: Column) -> Column:
    """The words of a text, in order (an empty array for a text without a word)."""
    trimmed = F.btrim(text_of(col), F.lit(WS_CHARS))
    return F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, rf"{WS}+"))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row: a bound variable is
    never inlined into the lambdas that use it, as the optimizer does with plain columns."""
    return F.transform(F.array(value), body)[0]
