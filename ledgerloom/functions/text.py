"""Text normalisation, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"


def squeezed(c: Column) -> Column:
    """White space runs to one blank, none at the ends."""
    return F.btrim(F.regexp_replace(c, r"(?U)\s+", " "))


def tokens(c: Column) -> Column:
    """Lower-case runs of letters, digits and underscores; null gives an empty array."""
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def bounded_by_words(text: Column, value: Column) -> Column:
    """Whether a literal value stands in a text with no word character on either side."""
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![\p{L}\p{N}_])"))
    return F.contains(text, value) & F.regexp_like(text, pattern)
