"""Date readings of text cells and calendar arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from statloom.functions.text import clean_text, placeholder_text

# One separator on both sides, every part numeric.
STRICT_DATE = r"^([0-9]{1,4})([\-/.])([0-9]{1,2})\2([0-9]{1,4})$"

# Formats tried when a column as a whole is read as dates, with their shapes.
COLUMN_FORMATS = {
    "yyyy-MM-dd": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
    "dd-MM-yyyy": r"^[0-9]{2}-[0-9]{2}-[0-9]{4}$",
    "yyyy/MM/dd": r"^[0-9]{4}/[0-9]{2}/[0-9]{2}$",
    "dd/MM/yyyy": r"^[0-9]{2}/[0-9]{2}/[0-9]{4}$",
    "MMM-yy": r"^[A-Za-z]{3}-[0-9]{2}$",
    "MMM-yyyy": r"^[A-Za-z]{3}-[0-9]{4}$",
    "MMMM yyyy": r"^[A-Za-z]{3,9} [0-9]{4}$",
    "yyyy": r"^[0-9]{4}$",
    "yyyyMM": r"^[0-9]{6}$",
}

# Free-form spellings accepted for a single cell, with their shapes.
FREE_FORMATS = {
    "yyyy-MM-dd HH:mm:ss": r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$",
    "yyyy-MM-dd'T'HH:mm:ss": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}$",
    "d MMM yyyy": r"^[0-9]{1,2} [A-Za-z]{3} [0-9]{4}$",
    "d MMMM yyyy": r"^[0-9]{1,2} [A-Za-z]{4,9} [0-9]{4}$",
    "MMM d, yyyy": r"^[A-Za-z]{3} [0-9]{1,2}, [0-9]{4}$",
    "MMMM d, yyyy": r"^[A-Za-z]{4,9} [0-9]{1,2}, [0-9]{4}$",
    "MMM yyyy": r"^[A-Za-z]{3} [0-9]{4}$",
    "MMMM yyyy": r"^[A-Za-z]{4,9} [0-9]{4}$",
    "MMM-yyyy": r"^[A-Za-z]{3}-[0-9]{4}$",
    "MMM-yy": r"^[A-Za-z]{3}-[0-9]{2}$",
}

# Day-first labels and timestamps of monthly and weekly series.
DAY_FIRST_FORMATS = {
    "dd-MM-yyyy": r"^[0-9]{2}-[0-9]{2}-[0-9]{4}$",
    "dd/MM/yyyy": r"^[0-9]{2}/[0-9]{2}/[0-9]{4}$",
    "yyyy-MM-dd HH:mm:ss": r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$",
    "yyyy-MM-dd": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
}

CENTURY_PIVOT = 70
EPOCH_MILLIS_ABOVE = 10_000_000_000
EPOCH_SECONDS_ABOVE = 1_000_000_000


def hours_in_year(year: Column) -> Column:
    """8,784 in a leap year, else 8,760; NULL for a NULL year."""
    return F.dayofyear(F.make_date(year.cast("int"), F.lit(12), F.lit(31))) * 24


# Only cells that start like this are worth the full patterns.
LIKE_THREE_NUMBERS = r"^[0-9]{1,4}[\-/.][0-9]"
LIKE_SPELLED_DATE = r"^([0-9]{4}-[0-9]{2}-|[0-9]{1,2} [A-Za-z]{3}|[A-Za-z]{3})"


def _int(digits: Column) -> Column:
    """Integer of an extracted digit group; no match is the empty text and NULL."""
    return digits.try_cast("int")


FIRST_YEAR_OF_69 = 2069


def parse_shaped(t: Column, formats: dict[str, str]) -> Column:
    """First format that reads the text, tried only where the shape fits.

    A failed parse costs an exception inside Spark, a regex does not.
    """
    out = F.lit(None).cast("date")
    for fmt, shape in reversed(formats.items()):
        date = F.to_date(F.try_to_timestamp(t, F.lit(fmt)))
        if fmt.endswith("-yy"):
            # two digits name 1969 to 2068; Spark reads them all as 20yy
            date = F.when(F.year(date) >= FIRST_YEAR_OF_69, F.add_months(date, -1200)).otherwise(date)
        out = F.when(t.rlike(shape), date).otherwise(out)
    return out


def three_numbers(t: Column) -> dict[str, Column]:
    """a, b, c of a strictly three-part numeric cell, NULLs otherwise."""
    near = t.rlike(LIKE_THREE_NUMBERS)
    return {n: F.when(near, _int(F.regexp_extract(t, STRICT_DATE, g))) for n, g in (("a", 1), ("b", 3), ("c", 4))}


def order_parts(a: Column, b: Column, c: Column) -> dict[str, Column]:
    """ambiguous, y, m, d of the three numbers.

    Day and month are accepted only when exactly one of the two exceeds 12; a
    first part above 99 is a year.
    """
    year_first, day_first, month_first = a > 99, (a > 12) & (b <= 12), (a <= 12) & (b > 12)
    century = F.when(c >= 100, c).when(c < CENTURY_PIVOT, c + 2000).otherwise(c + 1900)
    return {
        "ambiguous": F.coalesce(~year_first & (a <= 12) & (b <= 12), F.lit(False)),
        "y": F.when(year_first, a).otherwise(century),
        "m": F.when(year_first | day_first, b).when(month_first, a),
        "d": F.when(year_first, c).when(day_first, a).when(month_first, b),
    }


def date_of_parts(t: Column, y: Column, m: Column, d: Column) -> Column:
    """Date of a cell given its ordered parts: three numbers, an epoch, or a spelling.

    Whole numbers above 1e9 are epoch seconds and above 1e10 epoch milliseconds.
    """
    parts = F.when(m.isNotNull() & d.isNotNull(), F.format_string("%04d-%02d-%02d", y, m, d).try_cast("date"))
    whole = F.when(t.rlike("^-?[0-9]{10,18}$"), t.try_cast("bigint"))
    epoch = F.when(
        F.abs(whole) > EPOCH_SECONDS_ABOVE,
        F.to_date(F.timestamp_millis(F.when(F.abs(whole) > EPOCH_MILLIS_ABOVE, whole).otherwise(whole * 1000))),
    )
    return F.when(y.isNotNull(), parts).when(t.rlike("^-?[0-9]+$"), epoch).when(
        t.rlike(LIKE_SPELLED_DATE), parse_shaped(t, FREE_FORMATS)
    )


def date_status(t: Column, ambiguous: Column, date: Column) -> Column:
    """ok, empty, ambiguous or failed."""
    return (
        F.when(t.isNull() | placeholder_text(t), "empty")
        .when(ambiguous, "ambiguous")
        .when(date.isNotNull(), "ok")
        .otherwise("failed")
    )


def read_dates(df: DataFrame, column: str) -> DataFrame:
    """Add ``date_status`` and ``date`` of a text column.

    The steps are separate projections of plain columns, so that none of them is
    repeated inside the next.
    """
    t = F.col("_text")
    out = df.withColumn("_text", clean_text(F.col(column).cast("string")))
    out = out.withColumns({f"_{k}": v for k, v in three_numbers(t).items()})
    out = out.withColumns({f"_{k}": v for k, v in order_parts(F.col("_a"), F.col("_b"), F.col("_c")).items()})
    out = out.withColumn("date", date_of_parts(t, F.col("_y"), F.col("_m"), F.col("_d")))
    out = out.withColumn("date_status", date_status(t, F.col("_ambiguous"), F.col("date")))
    return out.drop("_text", "_a", "_b", "_c", "_ambiguous", "_y", "_m", "_d")


def day_first_date(c: Column) -> Column:
    """dd-MM-yyyy, dd/MM/yyyy or an ISO timestamp, whichever reads."""
    return parse_shaped(c, DAY_FIRST_FORMATS)


def month_year_date(c: Column) -> Column:
    """'Apr-25' -> first day of that month."""
    return parse_shaped(c, {"MMM-yy": COLUMN_FORMATS["MMM-yy"]})


def quarter_and_year(c: Column) -> tuple[Column, Column]:
    """'Q1 1998' -> (1, 1998)."""
    pattern = r"Q([1-4])\s+([0-9]{4})"
    return _int(F.regexp_extract(c, pattern, 1)), _int(F.regexp_extract(c, pattern, 2))


def financial_year_start(c: Column) -> Column:
    """'2014/15' -> 2014."""
    start = F.substring(c.cast("string"), 1, 4)
    return F.when(start.rlike("^[0-9]+$"), _int(start))


def read_as_dates(c: Column, fmt: str) -> Column:
    return parse_shaped(c, {fmt: COLUMN_FORMATS[fmt]})


def best_date_format(df: DataFrame, column: str) -> DataFrame:
    """Share of cells each format reads; the caller takes the best row.

    One aggregate over the column gives all shares at once.
    """
    text = F.trim(F.col(column).cast("string"))
    one = df.agg(
        *[
            F.avg(F.when(read_as_dates(text, f).isNotNull(), 1.0).otherwise(0.0)).alias(f"f{i}")
            for i, f in enumerate(COLUMN_FORMATS)
        ]
    )
    shares = F.array(
        *[
            F.struct(F.lit(f).alias("format"), F.lit(i).alias("position"), F.col(f"f{i}").alias("share"))
            for i, f in enumerate(COLUMN_FORMATS)
        ]
    )
    return one.select(F.inline(shares))
