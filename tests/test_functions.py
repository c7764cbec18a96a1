from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from statloom.functions import dates, names, nulls, numbers, stats, text, units


def values(df, expr):
    return [r["v"] for r in df.select("i", expr.alias("v")).orderBy("i").collect()]


def test_footnotes_leftmost_marker_decides_and_all_go(column):
    df = column(["12 [c]", "[ c]", "[note 3] 5", "[Low]", "..", "Total: 5", "3 [r] [p]", None, "abc", "3 [c ]"])
    assert values(df, text.footnote_code(F.col("c"))) == [
        "suppressed_confidential", "suppressed_confidential", "footnote_3", "suppressed_low", "missing",
        "not_available", "revised", None, None, "suppressed_confidential"]
    assert values(df, text.strip_footnotes(F.col("c"))) == ["12", None, "5", None, None, "Total 5", "3", None, "abc", "3"]


def test_numbers_strict_and_loose(column):
    df = column(["1,234", "£5", "12%", "-999", "12d", "5f", "inf", "NaN", " 7 ", "n/a", "1e3", None])
    assert values(df, numbers.strict_number(F.col("c"))) == [None, None, None, -999.0, None, None, None, None, 7.0, None, 1000.0, None]
    assert values(df, numbers.loose_number(F.col("c"))) == [1234.0, 5.0, 12.0, None, None, None, None, None, 7.0, None, 1000.0, None]


def test_placeholders_and_cell_kinds(column):
    df = column(["", " N/A ", "x", "-", "1,200", "+1.5", "2020-01-01"])
    assert values(df, text.is_placeholder(F.col("c"))) == [True, True, False, True, False, False, False]
    assert values(df, numbers.text_cell(F.col("c"))) == [False, True, True, True, False, False, False]
    assert values(df, numbers.numeric_like(F.col("c"))) == [False, False, False, False, True, True, False]


def test_dates_statuses_and_values(column):
    df = column(["19/04/2015", "04/05/2015", "31-12-69", "31-12-70", "11-29.99", "2024-03-15", "2003-01-01 00:00:00",
                 "May", "1700000000", "1700000000000", "1 Mar 2020", "30/02/2015", None, "12", "n/a"])
    rows = dates.read_dates(df, "c").orderBy("i").collect()
    assert [r["date_status"] for r in rows] == ["ok", "ambiguous", "ok", "ok", "failed", "ok", "ok", "failed", "ok", "ok", "ok",
                                               "failed", "empty", "failed", "empty"]
    d = [r["date"] for r in rows]
    assert d[0] == dt.date(2015, 4, 19) and d[2] == dt.date(2069, 12, 31) and d[3] == dt.date(1970, 12, 31)
    assert d[5] == dt.date(2024, 3, 15) and d[8] == d[9] == dt.date(2023, 11, 14) and d[10] == dt.date(2020, 3, 1)


def test_labels_of_series(column):
    df = column(["01-04-2014", "19/04/2015", "2015-04-05 00:00:00", "Apr-25", "Q3 2001", "2014/15"])
    assert values(df, dates.day_first_date(F.col("c")))[:3] == [dt.date(2014, 4, 1), dt.date(2015, 4, 19), dt.date(2015, 4, 5)]
    assert values(df, dates.month_year_date(F.col("c")))[3] == dt.date(2025, 4, 1)
    q, y = dates.quarter_and_year(F.col("c"))
    assert (values(df, q)[4], values(df, y)[4]) == (3, 2001)
    assert values(df, dates.financial_year_start(F.col("c")))[5] == 2014


def test_hours_in_leap_years(column):
    assert values(column([2023, 2024, 1900, 2000, None], "int"), dates.hours_in_year(F.col("c"))) == [8760, 8784, 8760, 8784, None]


def test_units_decimal_comma_and_unknown_unit(column):
    df = column(["10 kg", "2 lb", "5 m", "1,5 t", "3 ft", "7 foo", "1,234 kg"])
    got = values(df, units.embedded_quantity(F.col("c")))
    assert [g["kind"] for g in got] == ["mass_kg", "mass_kg", "length_cm", "mass_kg", "length_cm", None, "mass_kg"]
    assert [g["value"] for g in got] == pytest.approx([10.0, 0.90718474, 500.0, 1500.0, 91.44, None, 1.234], nan_ok=True) or got[5]["value"] is None
    assert values(column(["212 °F", "5", "50 Fahrenheit"]), units.fahrenheit_cell(F.col("c"))) == [100.0, None, 10.0]


def test_categories(column):
    df = column(["U.K.", "usa", "SOUTH WEST", "CO2", "SIC-07", "Wales", None, "SOUTH-WESTERN AREA"])
    assert values(df, text.canonical_category(F.col("c"))) == [
        "United Kingdom", "United States", "South West", "CO2", "SIC-07", "Wales", None, "South-Western Area"]


def test_clean_text_and_full_nfkc(column):
    df = column([" <b>x</b>\u0007１２ ", "ﬁ ℡"])
    assert values(df, text.clean_text(F.col("c")))[0] == "x12"
    assert values(df, text.clean_text(F.col("c"), full_nfkc=True))[1] == "fi TEL"


def test_header_names_get_the_next_free_suffix():
    assert text.snake_case_names(["A b", "a-b", "", "A  B", "£"]) == ["a_b", "a_b_2", "column", "a_b_3", "column_2"]


def test_name_hints():
    assert names.unit_hint("total_gwh") == "_gwh" and names.unit_hint("total_gwh", longest=False) == "_gw"
    assert names.data_columns(["a", "raw__a", "a_flag", "a_iso_date"]) == ["a"]
    assert names.suggests_currency("unit_price") and names.suggests_temperature("temp_max") and not names.suggests_date("value")


def test_null_safe_arithmetic(spark):
    df = spark.createDataFrame([(1, 4.0, 2.0), (2, 1.0, 0.0), (3, None, 1.0), (4, float("nan"), -2.0)], "i int, a double, b double")
    clean = nulls.nan_to_null(df)
    assert [r["v"] for r in clean.select("i", nulls.safe_div(F.col("a"), F.col("b")).alias("v")).orderBy("i").collect()] == [2.0, None, None, None]
    assert [r["v"] for r in clean.select("i", nulls.clip_low(F.col("b")).alias("v")).orderBy("i").collect()] == [2.0, 0.0, 1.0, 0.0]
    assert clean.where(F.col("a").isNull()).agg(nulls.sum0(F.col("a")).alias("v")).first()["v"] == 0.0
    assert [r["v"] for r in clean.select("i", nulls.row_sum([F.col("a"), F.col("b")]).alias("v")).orderBy("i").collect()] == [6.0, 1.0, 1.0, -2.0]


def test_corrected_moments(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 10, 4.5)], "x double")
    n, sd = F.count("x").cast("double"), F.stddev_samp("x")
    row = df.agg(stats.corrected_skew(n, F.skewness("x"), sd).alias("s"), stats.corrected_kurtosis(n, F.kurtosis("x"), sd).alias("k")).first()
    assert row["s"] == pytest.approx(1.5469, abs=1e-4) and row["k"] == pytest.approx(2.5159, abs=1e-4)


def test_two_digit_years_and_long_stems(spark):
    from statloom.functions import dates, text

    df = spark.createDataFrame([("Apr-95", "a" * 300 + "x.xls"), ("Jan-69", "a" * 300 + "y.xls"), ("Dec-68", "b.xls"), ("Apr-25", "c.xls")], "m string, w string")
    rows = df.select(dates.month_year_date(df.m).cast("string").alias("d"), text.output_stem(df.w, F.lit("Ark1")).alias("s")).collect()
    assert [r.d for r in rows] == ["1995-04-01", "1969-01-01", "2068-12-01", "2025-04-01"]
    assert len({r.s for r in rows}) == 4 and max(len(r.s) for r in rows) <= 180 and rows[2].s == "b__Ark1"
