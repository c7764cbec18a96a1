"""Text to number, in a strict and a loose reading."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from statloom.functions.text import clean_text, placeholder_text

# Numbers that publishers write where they mean "missing".
NUMERIC_SENTINELS = (-999.0, -9999.0, 999999.0)

# A plain decimal number with optional sign and exponent. It guards the cast:
# Spark alone would read '12d' as 12.0.
NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def strict_number(c: Column) -> Column:
    """Number if the trimmed text is one and nothing else, else NULL."""
    t = F.trim(c.cast("string"))
    return F.when(t.rlike(NUMBER_PATTERN), t.try_cast("double"))


def drop_sentinel(x: Column) -> Column:
    """NULL for a sentinel number."""
    return F.when(~x.isin(*NUMERIC_SENTINELS), x)


def is_sentinel(c: Column) -> Column:
    return F.coalesce(strict_number(c).isin(*NUMERIC_SENTINELS), F.lit(False))


def loose_number(c: Column) -> Column:
    """Number after removing thousands commas, currency signs and percent signs."""
    return loose_text(clean_text(c))


def loose_text(t: Column) -> Column:
    """Same as ``loose_number`` for text that is clean already."""
    number = strict_number(F.translate(t, ",£$€%", ""))
    return F.when(~placeholder_text(t) & ~number.isin(*NUMERIC_SENTINELS), number)


def numeric_like(c: Column) -> Column:
    """True if the cell reads as a number once commas and currency signs are gone."""
    bare = F.trim(F.regexp_replace(c, "[,£$€]", ""))
    return F.coalesce(bare.rlike(NUMBER_PATTERN), F.lit(False))


def text_cell(c: Column) -> Column:
    """True for a non-blank cell that is not just digits and separators."""
    t = F.trim(c)
    digits = F.regexp_replace(t, r"[,.\-+]", "")
    return F.coalesce((t != "") & ~digits.rlike("^[0-9]+$"), F.lit(False))
