"""Column expressions on text: blank tests, keyword tests, tokens."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stopwords and delimiters of the message index.
STOPWORDS = (
    "the", "a", "an", "is", "in", "on", "at", "to", "for", "of", "and", "or", "not", "with", "this", "that", "was", "has", "have", "are", "be", "been", "by", "from", "after",
)
DELIMITERS = r"""[\s\.,;:!?\[\](){}"'=<>|/\\@#$%^&*+~`]+"""
MIN_TERM = 2


def is_blank(c: Column) -> Column:
    """Null, empty or white space only."""
    return c.isNull() | (F.regexp_replace(c, r"\s", "") == "")


def contains_any(c: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def raw_tokens(c: Column) -> Column:
    """The pieces between delimiters, lower-cased; a leading delimiter gives an empty first piece, trailing ones give none."""
    pieces = F.split(F.lower(c), DELIMITERS)
    return F.when(is_blank(c), F.array().cast("array<string>")).otherwise(F.when(F.element_at(pieces, -1) == "", F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces))


def is_term(token: Column) -> Column:
    """Whether a token is indexed; the others only take up a position."""
    return (F.length(token) >= MIN_TERM) & ~token.isin(*STOPWORDS)
