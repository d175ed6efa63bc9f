"""Text column functions; all of them are built-in expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from staffmart.schema import TEXT_NULL_TOKENS

# The characters Unicode counts as white space (plus the four ASCII separators).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

COLLATION = "UTF8_LCASE_RTRIM"
FENCE = "```"


def strip_text(col: Column) -> Column:
    """Remove white space of every kind from both ends (the one-argument ``trim`` knows blanks only)."""
    return F.trim(col, F.lit(WHITESPACE))


def tokens_to_null(col: Column, tokens: Iterable[str] = TEXT_NULL_TOKENS) -> Column:
    return F.when(~col.isin(list(tokens)), col)


def exact(col: Column) -> Column:
    """Keys match byte by byte."""
    return col


def folded(col: Column) -> Column:
    """Keys match whatever their case and trailing blanks: a collation that grouping, joins and comparisons follow."""
    return F.collate(col, COLLATION)


def full_name(first: Column, last: Column) -> Column:
    """First and last name with one blank between; a missing part counts as empty text."""
    return F.concat(F.coalesce(first, F.lit("")), F.lit(" "), F.coalesce(last, F.lit("")))


def strip_fences(col: Column) -> Column:
    """Drop code fences (with or without a ``sql`` tag) wherever they stand, then trim."""
    without_tagged = F.replace(col, F.lit(FENCE + "sql"), F.lit(""))
    return strip_text(F.replace(without_tagged, F.lit(FENCE), F.lit("")))
