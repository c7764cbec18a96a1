"""Cell text: cleaning, placeholders, footnote markers, categories, names."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F

# Spellings that mean "no value here".
PLACEHOLDERS = (
    "", "n/a", "na", "#n/a", "#na", "null", "none", "nan", "-", "--",
    "unknown", "unk", "not available", "not applicable", "missing",
    "no data", "tbd", "tbc", ".",
)

# Footnote marker inside square brackets -> flag code.
BRACKET_FLAGS = {
    "c": "suppressed_confidential",
    "low": "suppressed_low",
    "x": "not_applicable",
    "r": "revised",
    "p": "provisional",
    "e": "estimate",
    "w": "withheld",
}
DOTS_FLAG = "missing"
COLON_FLAG = "not_available"

# Spellings of two country names.
COUNTRY_ALIASES = {
    "usa": "United States",
    "us": "United States",
    "united states": "United States",
    "united states of america": "United States",
    "uk": "United Kingdom",
    "united kingdom": "United Kingdom",
    "great britain": "United Kingdom",
}

# Any marker at all; the leftmost match decides the flag.
_BLANK = "[\\s\u00a0]"
FOOTNOTE_PATTERN = (
    rf"(?i)(\[{_BLANK}*(?:c|low|x|r|p|e|w){_BLANK}*\]|\[{_BLANK}*note{_BLANK}*[1-9]{_BLANK}*\]|\.\."
    rf"|{_BLANK}*:(?={_BLANK}|$){_BLANK}*)"
)

# Compatibility forms that publisher sheets really contain. A full NFKC pass is
# the pandas UDF below; this JVM-side set keeps the hot path in codegen.
_WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85"
_COMPAT_SPACES = "\u00a0\u2002\u2003\u2007\u2009\u202f\u3000"
_COMPAT_SINGLE = _COMPAT_SPACES + "０１２３４５６７８９．，％－＋／：（）" + "²³¹µ"
_COMPAT_TARGET = " " * len(_COMPAT_SPACES) + "0123456789.,%-+/:()" + "231μ"


def compat_fold(c: Column) -> Column:
    """Compatibility folding of the common characters, without leaving the JVM."""
    return F.translate(c, _COMPAT_SINGLE, _COMPAT_TARGET)


def nfkc():
    """Pandas UDF: full NFKC, for columns known to hold exotic characters."""
    def fold(values: pd.Series) -> pd.Series:
        return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")

    return F.pandas_udf(fold, "string")


def clean_text(c: Column, full_nfkc: bool = False) -> Column:
    """Fold compatibility characters, drop control characters and tags, trim."""
    t = nfkc()(c) if full_nfkc else compat_fold(c)
    t = F.regexp_replace(t, r"[\x00-\x08\x0b\x0c\x0e-\x1f]|<[^>]+>", "")
    return F.btrim(t, F.lit(_WHITESPACE))


def placeholder_text(t: Column) -> Column:
    """Same as ``is_placeholder`` for text that is clean already."""
    return F.lower(t).isin(*PLACEHOLDERS)


def is_placeholder(c: Column) -> Column:
    """True if the cleaned cell is empty or one of the placeholder spellings."""
    return placeholder_text(clean_text(c))


def has_footnote(c: Column) -> Column:
    """True if the cell holds a marker. Plain text searches rule out most cells before the regex."""
    possible = c.contains("[") | c.contains("..") | c.contains(":")
    return F.coalesce(possible & c.rlike(FOOTNOTE_PATTERN), F.lit(False))


def footnote_code(c: Column) -> Column:
    """Flag code of the leftmost marker, NULL without one."""
    first = F.regexp_extract(c, FOOTNOTE_PATTERN, 1)
    token = F.lower(F.regexp_replace(first, r"[\[\]\s\u00a0]", ""))
    code = F.when(token == "..", F.lit(DOTS_FLAG)).when(token == ":", F.lit(COLON_FLAG))
    code = code.when(token.rlike("^note[1-9]$"), F.concat(F.lit("footnote_"), F.substring(token, 5, 1)))
    for mark, flag in BRACKET_FLAGS.items():
        code = code.when(token == mark, F.lit(flag))
    return F.when(has_footnote(c), code)


def strip_footnotes(c: Column) -> Column:
    """Cell without any marker; an empty rest is NULL. Cells without one stay as they are."""
    rest = F.regexp_replace(c, FOOTNOTE_PATTERN, " ")
    rest = F.trim(F.regexp_replace(rest, _BLANK + "+", " "))
    return F.when(has_footnote(c), F.when(rest != "", rest)).otherwise(c)


def title_case(t: Column) -> Column:
    """Upper-case every letter that follows a non-letter, lower-case the others."""
    marked = F.regexp_replace(F.lower(t), r"(?U)([^\p{L}]+)", "\u0001$1\u0001")
    words = F.split(marked, "\u0001")
    return F.concat_ws("", F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))))


def canonical_category(c: Column) -> Column:
    """Country alias, acronym kept, other all-capitals text in title case."""
    return canonical_text(clean_text(c))


def canonical_text(t: Column) -> Column:
    """Same as ``canonical_category`` for text that is clean already."""
    key = F.replace(F.lower(t), F.lit("."), F.lit(""))
    alias = F.create_map(*[F.lit(x) for pair in COUNTRY_ALIASES.items() for x in pair])
    all_caps = (F.upper(t) == t) & (F.lower(t) != t)
    acronym = all_caps & F.length(t).between(2, 12) & F.replace(t, F.lit("-"), F.lit("")).rlike(r"(?U)^[\p{L}\p{N}]+$")
    return (
        F.when(key.isin(*COUNTRY_ALIASES), F.try_element_at(alias, key))
        .when(acronym, t)
        .when(all_caps & (F.length(t) > 1), title_case(t))
        .otherwise(t)
    )


def snake_name(c: Column) -> Column:
    """Snake-case form of a header cell, without the collision suffix."""
    base = F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_")
    base = F.regexp_replace(base, "^_+|_+$", "")
    return F.when(F.coalesce(base, F.lit("")) == "", F.lit("column")).otherwise(base)


def snake_case_names(names: list[str]) -> list[str]:
    """Snake-case header names of one table; repeats get the next free suffix."""
    taken: set[str] = set()
    result = []
    for name in names:
        base = re.sub("[^a-z0-9]+", "_", str(name).strip().lower()).strip("_") or "column"
        pick, k = base, 1
        while pick in taken:
            k += 1
            pick = f"{base}_{k}"
        taken.add(pick)
        result.append(pick)
    return result


def output_stem(workbook: Column, sheet: Column, max_len: int = 180) -> Column:
    """Stable name of a cleaned table: file stem, two underscores, sheet name."""
    stem = F.regexp_replace(F.element_at(F.split(workbook, "/"), -1), r"\.[^.]*$", "")
    joined = F.concat(stem, F.lit("__"), F.trim(F.regexp_replace(sheet, r"(?U)\s+", " ")))
    safe = F.regexp_replace(joined, "[^a-zA-Z0-9_-]+", "_")
    safe = F.regexp_replace(safe, "^_+|_+$", "")
    # a long name is cut, and a digest of the whole keeps it apart from others that begin alike
    digest = F.substring(F.sha2(F.concat_ws("\u0001", workbook, sheet), 256), 1, 16)
    safe = F.when(F.length(safe) > max_len, F.concat(F.substring(safe, 1, max_len - 17), F.lit("_"), digest)).otherwise(safe)
    return F.when(safe == "", F.lit("sheet")).otherwise(safe)
