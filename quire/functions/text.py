"""Text column functions (all JVM-side built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def word_tokens(text) -> Column:
    """Split on a single space, keeping empty tokens; ``""`` gives ``[""]``."""
    return F.split(_c(text), " ", -1)


def char_tokens(text) -> Column:
    """Tokens a character-wise join then space split gives for a plain string:
    every character is a token and every space becomes two empty tokens."""
    return F.split(F.concat_ws(" ", F.split(_c(text), "", -1)), " ", -1)


def flatten_whitespace(text) -> Column:
    """Line breaks (``\\r\\n``, ``\\r``, ``\\n``) and tabs become one space each."""
    return F.regexp_replace(_c(text), "\r\n|[\r\n\t]", " ")


def join_paragraphs(paragraphs) -> Column:
    """A list of paragraphs joined with one space."""
    return F.concat_ws(" ", _c(paragraphs))


def tokens_for(text, unit: str = "word") -> Column:
    """Token array for a text column.  ``unit``: ``word`` (space split),
    ``char`` (the character behaviour a string input gets), or ``paragraphs``
    (an array column joined with spaces, then split on spaces)."""
    if unit == "word":
        return word_tokens(text)
    if unit == "char":
        return char_tokens(text)
    if unit == "paragraphs":
        return word_tokens(join_paragraphs(text))
    raise ValueError(f"unknown token unit {unit!r}")


# What lies between the terms of the bag-of-words features, which are runs of letters or digits (the common ones
# are named first, as they are the quickest to tell).
GAP_PATTERN = r"[^a-z0-9\p{L}\p{N}]+"


def spaced_terms(text) -> Column:
    """Lower-cased letter/digit runs of a text, with one space between them (and where the text begins or ends
    with something else)."""
    return F.regexp_replace(F.lower(_c(text)), GAP_PATTERN, " ")
