"""Column cleaning rules with provenance flags and an issue register.

The rules are expressions on one cell, so the same code serves one wide table
(``clean_table``) and a long cell frame of many sheets (``clean_cells``).
Order of the rules: footnotes, placeholders, sentinels, embedded units, dates,
temperature, categories. Counts come from one aggregate over all columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from statloom.functions import names
from statloom.functions.dates import date_of_parts, date_status, order_parts, three_numbers
from statloom.functions.numbers import is_sentinel, loose_text, strict_number
from statloom.functions.text import (
    COUNTRY_ALIASES, canonical_text, clean_text, footnote_code, has_footnote, placeholder_text, strip_footnotes,
)
from statloom.functions.units import fahrenheit_cell, quantity_kind, quantity_parts, quantity_value
from statloom.operators.ordered import attach, is_small, median_and_mad
from statloom.sources.landing import land, spread

PROMOTION_SHARE = 0.95
OUTLIER_MIN_VALUES = 12
ROBUST_Z = 3.5
FEW_VALUES = 200_000
MIXED_LOW, MIXED_HIGH = 0.2, 1.0

ISSUE_SCHEMA = (
    "workbook string, sheet string, column string, issue_code string, detail string, confidence string, "
    "rows_affected bigint, example_before string, example_after string, recommendation string"
)

# Codes and confidences are fixed values; the texts are free: code -> (confidence, detail, recommendation).
ISSUE_TEXT = {
    "footnote_marker_stripped": ("high", "Footnote markers moved to the flag column", "The marker is kept in the flag column next to the value."),
    "placeholder_to_na": ("high", "Placeholder text treated as missing", "Decide per analysis whether to fill the gap or leave the row out."),
    "numeric_sentinel": ("high", "Sentinel numbers set to missing", ""),
    "mixed_type_numeric_string": ("medium", "Column mixes numbers and text", "Consider one column for the numbers and one for the notes."),
    "unit_embedded_normalized": ("high", "Quantities with a unit converted to kg or cm", "Make sure the heading names the same unit."),
    "date_normalized_iso8601": ("high", "Unambiguous dates copied to the ISO helper column", ""),
    "ambiguous_date": ("low", "Day and month order unclear; left as is", "Ask the publisher which of day and month comes first."),
    "temperature_f_to_c": ("medium", "Fahrenheit converted to Celsius", ""),
    "multi_currency_detected": ("medium", "More than one currency symbol in the column", "Amounts stay as published; convert them before adding up."),
    "categorical_canonicalized": ("medium", "Category spellings unified", "Each replaced spelling is listed in the log."),
    "outlier_robust_log_mad": ("low", "Robust z above 3.5 on log positives (flag only)", "Compare the value with the published source."),
    "negative_value_suspicious": ("medium", "Negative values where none are expected (flag only)", ""),
    "unparsed_text_nulled": ("low", "Text cells of a numeric column became missing", "The raw column still holds the text."),
}


def apply_rules(df: DataFrame, cells: dict[str, Column]) -> DataFrame:
    """Add the rule columns of each named cell: ``<name>.raw`` … ``<name>.value``.

    The rules build on each other, so they are staged in separate projections:
    each stage is computed once and read by name in the next one. (One nested
    expression would repeat the early stages hundreds of times; so would structs,
    which the optimizer takes apart.) Spark keeps such projections apart.

    ``cells`` maps a text column to the condition that it holds temperatures.
    """
    def stage(frame: DataFrame, suffix_exprs) -> DataFrame:
        new = {}
        for c in cells:
            new.update({f"{c}.{suffix}": e for suffix, e in suffix_exprs(c).items()})
        return frame.withColumns(new)

    def at(c: str, suffix: str) -> Column:
        return F.col(f"`{c}.{suffix}`")

    out = stage(df, lambda c: {"raw": F.col(f"`{c}`").cast("string")})
    out = stage(out, lambda c: {
        "footnote": has_footnote(at(c, "raw")), "flag": footnote_code(at(c, "raw")),
        "noted": strip_footnotes(at(c, "raw")),
    })
    out = stage(out, lambda c: {"text": clean_text(at(c, "noted"))})
    out = stage(out, lambda c: {
        "placeholder": F.coalesce((at(c, "text") != "") & placeholder_text(at(c, "text")), F.lit(False)),
        "sentinel": is_sentinel(at(c, "text")),
        "loose": loose_text(at(c, "text")),
        **quantity_parts(at(c, "text")),
    })
    out = stage(out, lambda c: {"usable": ~at(c, "placeholder") & ~at(c, "sentinel")})
    out = stage(out, lambda c: {
        "unit": F.coalesce(at(c, "usable") & quantity_kind(at(c, "unit_name")).isNotNull() & at(c, "number").isNotNull(), F.lit(False)),
        "mixed_text": at(c, "usable") & (at(c, "text") != ""),
    })
    out = stage(out, lambda c: {
        "amount": F.when(at(c, "unit"), quantity_value(at(c, "number"), at(c, "unit_name")).cast("string")),
    })
    out = stage(out, lambda c: {
        "sized": F.coalesce(at(c, "amount"), F.when(at(c, "usable"), at(c, "noted"))),
        "sized_text": F.coalesce(at(c, "amount"), F.when(at(c, "usable"), at(c, "text"))),
    })
    out = stage(out, lambda c: {
        **three_numbers(at(c, "sized_text")),
        "celsius": F.when(cells[c], fahrenheit_cell(at(c, "sized_text"))),
    })
    out = stage(out, lambda c: order_parts(at(c, "a"), at(c, "b"), at(c, "c")))
    out = stage(out, lambda c: {"date": date_of_parts(at(c, "sized_text"), at(c, "y"), at(c, "m"), at(c, "d"))})
    return stage(out, lambda c: {
        "date_status": date_status(at(c, "sized_text"), at(c, "ambiguous"), at(c, "date")),
        "iso_date": F.date_format(at(c, "date"), "yyyy-MM-dd"),
        "value": F.when(at(c, "celsius").isNotNull(), at(c, "celsius").cast("string")).otherwise(at(c, "sized")),
    })


def rule_counts(c: str, weight: str | None = None) -> list[Column]:
    """Counts over rule columns: what the register and the schema need but for the example.

    A row stands for ``weight`` equal cells, or for one. Buffers are numbers only, so rows are hashed and never sorted.
    """
    def at(suffix: str) -> Column:
        return F.col(f"`{c}.{suffix}`")

    def counted(hit: Column) -> Column:
        return F.count_if(hit) if weight is None else F.coalesce(F.sum(F.when(hit, F.col(weight))), F.lit(0))

    value = at("value")
    number = strict_number(value)

    def symbol(sym: str) -> Column:
        return F.coalesce(F.max(F.when(value.contains(sym), 1).otherwise(0)), F.lit(0))

    return [
        counted(F.lit(True)).alias("n_rows"),
        counted(at("footnote")).alias("n_footnote"),
        counted(at("placeholder")).alias("n_placeholder"),
        counted(at("sentinel")).alias("n_sentinel"),
        counted(at("mixed_text")).alias("n_text"),
        counted(at("mixed_text") & at("loose").isNotNull()).alias("n_loose"),
        counted(at("unit")).alias("n_unit"),
        counted(at("date_status") == "ok").alias("n_date"),
        counted(at("date_status") == "ambiguous").alias("n_ambiguous"),
        counted(at("celsius").isNotNull()).alias("n_temperature"),
        (symbol("£") + symbol("$") + symbol("€")).alias("n_currencies"),
        counted(number < 0).alias("n_negative"),
        counted(number.isNotNull()).alias("n_numeric"),
        counted(value.isNotNull()).alias("n_value"),
        counted(~at("raw").eqNullSafe(value)).alias("n_changed"),
    ]


COUNT_NAMES = (
    "n_rows", "n_footnote", "n_placeholder", "n_sentinel", "n_text", "n_loose", "n_unit", "n_date", "n_ambiguous",
    "n_temperature", "example", "n_currencies", "n_negative", "n_numeric", "n_value", "n_changed",
)


def rule_summary(cells: DataFrame, keys: list[str], row: str | None = None, weight: str | None = None) -> DataFrame:
    """The counts of each group of ruled cells, and the example of a converted temperature.

    ``row`` orders the cells: the example is the first one, without it the least text. Only converted cells are compared for it.
    """
    order = F.col("`cell.sized`" if row is None else row)
    pair = F.struct(F.col("`cell.sized`").alias("before"), F.col("`cell.value`").alias("after"))
    example = cells.where(F.col("`cell.celsius`").isNotNull()).groupBy(*keys).agg(F.min_by(pair, order).alias("example"))
    return attach(cells.groupBy(*keys).agg(*rule_counts("cell", weight)), example, keys, "left")


RULED = (
    "raw", "value", "flag", "iso_date", "footnote", "placeholder", "sentinel", "unit", "mixed_text", "loose", "date_status", "celsius", "sized",
)


def land_ruled(cells: DataFrame, hot: Column, keys: list[str]) -> DataFrame:
    """The rules applied to (keys, cell) once, and written: what counts, dictionary and table read later.

    Cells are dealt out over all cores first: the rules cost far more than the move.
    """
    return land(apply_rules(spread(cells), {"cell": hot}).select(*keys, *[f"`cell.{c}`" for c in RULED]))


def distinct_values(cells: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """(keys, value, text, number, n) of the non-null cells; a row stands for ``weight`` of them, or for one.

    NULLs go by their count; text and number are aggregates. So no filter on them
    is pushed below the grouping, where it would repeat all the rules.
    """
    value = F.col("value")
    n = F.count("value") if weight is None else F.sum(F.when(value.isNotNull(), F.col(weight)))
    grouped = cells.groupBy(*keys, "value").agg(
        n.alias("n"), F.max(clean_text(value)).alias("text"), F.max(strict_number(value)).alias("number")
    )
    return grouped.where(F.col("n") > 0)


def category_changes(cells: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """(keys, from_value, to_value, rows_affected): the spellings that change, for columns of any number of values.

    ``cells`` is (keys, value), a row stands for ``weight`` cells or for one. Only cells that change are grouped, so the dictionary and its shuffle are as large as the
    changes. A column of one value is no category and keeps it. The frame is the canonicalisation log.
    """
    text = clean_text(F.col("value"))
    spelled = cells.where(F.col("value").isNotNull()).select(*keys, "value", *([weight] if weight else []), text.alias("_text")).withColumn("_to", canonical_text(F.col("_text")))
    # An alias counts as a change even where the spelling is right already.
    alias = F.replace(F.lower("_text"), F.lit("."), F.lit("")).isin(*COUNTRY_ALIASES)
    changed = spelled.where((F.col("_to") != F.col("_text")) | alias).groupBy(*keys, "value", "_to").agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("rows_affected"))
    # numbers are counted, as the least and greatest text would have all cells sorted
    several = cells.where(F.col("value").isNotNull()).select(*keys, "value").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("_k")).where("_k > 1")
    return attach(changed, several.select(*keys), keys).select(
        *keys, F.col("value").alias("from_value"), F.col("_to").alias("to_value"), "rows_affected")


def few_values(values: DataFrame) -> bool:
    """Few enough landed values for a percentile that holds all of them: their files may be far smaller than that."""
    return is_small(values) and values.count() <= FEW_VALUES


def log_mad_outliers(values: DataFrame, keys: list[str], small: bool | None = None) -> DataFrame:
    """(keys, n_outlier): values far from the median of the logs, 12 positives or more.

    ``values`` is (keys, value, number, n); ``small``: all values of a key fit one task.
    """
    small = is_small(values) if small is None else small
    positive = values.where(F.col("number") > 0)
    logs = positive.select(*keys, F.log("number").alias("_log"), "n")
    enough = logs.groupBy(*keys).agg(F.sum("n").alias("_m")).where(F.col("_m") >= OUTLIER_MIN_VALUES)
    logs = attach(logs, enough, keys)
    centre = median_and_mad(logs, keys, "_log", weight="n", small=small)
    z = 0.6745 * (F.col("_log") - F.col("median")) / F.col("mad")
    scored = attach(logs, centre, keys).where((F.col("mad") > 0) & (F.abs(z) > ROBUST_Z))
    return scored.groupBy(*keys).agg(F.sum("n").alias("n_outlier"))


def column_issues(stats: DataFrame, keys: list[str]) -> DataFrame:
    """Issue rows from the per-column counts (keys must include workbook, sheet, column).

    ``stats`` also carries n_outlier and n_recoded.
    """
    name = F.lower("column")

    def named(hints: tuple[str, ...]) -> Column:
        hit = F.lit(False)
        for h in hints:
            hit = hit | name.contains(h)
        return hit

    ratio = F.when(F.col("n_text") > 0, F.col("n_loose") / F.col("n_text"))
    promoted = promotes(F.col("n_numeric"), F.col("n_value"))
    rows = {
        "footnote_marker_stripped": F.col("n_footnote"),
        "placeholder_to_na": F.col("n_placeholder"),
        "numeric_sentinel": F.col("n_sentinel"),
        "mixed_type_numeric_string": F.when((ratio > MIXED_LOW) & (ratio < MIXED_HIGH), F.col("n_text")),
        "unit_embedded_normalized": F.col("n_unit"),
        "date_normalized_iso8601": F.col("n_date"),
        "ambiguous_date": F.col("n_ambiguous"),
        "temperature_f_to_c": F.col("n_temperature"),
        "multi_currency_detected": F.when(
            named(names.CURRENCY_HINTS) & (F.col("n_currencies") > 1), F.col("n_rows")
        ),
        "categorical_canonicalized": F.col("n_recoded"),
        "outlier_robust_log_mad": F.col("n_outlier"),
        "negative_value_suspicious": F.when(named(names.NON_NEGATIVE_HINTS), F.col("n_negative")),
        "unparsed_text_nulled": F.when(promoted, F.col("n_value") - F.col("n_numeric")),
    }
    entries = F.array(
        *[
            F.struct(
                F.lit(code).alias("issue_code"), F.lit(ISSUE_TEXT[code][1]).alias("detail"),
                F.lit(ISSUE_TEXT[code][0]).alias("confidence"), n.cast("bigint").alias("rows_affected"),
                *[(F.coalesce(f"example.{x}", F.lit("")) if code == "temperature_f_to_c" else F.lit("")).alias(f"example_{x}") for x in ("before", "after")],
                F.lit(ISSUE_TEXT[code][2]).alias("recommendation"),
            )
            for code, n in rows.items()
        ]
    )
    return stats.select(*keys, F.inline(entries)).where(F.col("rows_affected") > 0)


def promotes(n_numeric: Column, n_value: Column) -> Column:
    """A column becomes a number when at least 95 % of its cells are one."""
    return F.coalesce((n_value > 0) & (n_numeric >= PROMOTION_SHARE * n_value), F.lit(False))


def duplicate_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row (n_duplicate_rows): members of groups of equal rows, NULLs equal."""
    groups = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias("n_duplicate_rows"))


def row_fingerprints(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row_idx, fingerprint): one row of cells as a value that does not depend on the order of its cells.

    Two digests of each (column, value), each combined over the row bit by bit, and the number of filled cells. A NULL cell
    adds nothing, so a cell that is missing equals a blank one. Both steps combine before they shuffle.
    """
    filled = F.col("value").isNotNull()

    def part(*of) -> Column:
        return F.bit_xor(F.when(filled, F.xxhash64(*of)))

    rows = cells.groupBy(*keys, "row_idx").agg(
        part("column", "value").alias("_p"), part(F.lit("row"), "value", "column").alias("_q"), F.count("value").alias("_n"))
    return rows.select(*keys, "row_idx", F.struct("_n", "_p", "_q").alias("fingerprint"))


def duplicate_cells(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_duplicate_rows) for sheets with equal rows: members of groups of equal rows, blank cells equal."""
    groups = row_fingerprints(cells, keys).groupBy(*keys, "fingerprint").agg(F.count(F.lit(1)).alias("_n"))
    return groups.where(F.col("_n") > 1).groupBy(*keys).agg(F.sum("_n").alias("n_duplicate_rows"))


def duplicate_issues(found: DataFrame) -> DataFrame:
    """Register rows of (workbook, sheet, n_duplicate_rows)."""
    return found.where(F.col("n_duplicate_rows") > 0).select(
        "workbook", "sheet", F.lit("*").alias("column"), F.lit("duplicate_row").alias("issue_code"),
        F.lit("Exact duplicate rows").alias("detail"), F.lit("high").alias("confidence"),
        F.col("n_duplicate_rows").alias("rows_affected"), F.lit("").alias("example_before"), F.lit("").alias("example_after"),
        F.lit("Find out which columns should tell the rows apart.").alias("recommendation"),
    )


def workbook_and_sheet(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of other names stand for both: the first is the workbook, the last the sheet."""
    if {"workbook", "sheet"} <= set(keys):
        return df
    return df.withColumns({"workbook": F.col(keys[0]), "sheet": F.col(keys[-1])})


@dataclass(frozen=True)
class Cleaned:
    table: DataFrame
    issues: DataFrame
    log: DataFrame


def clean_table(df: DataFrame, workbook: str, sheet: str) -> Cleaned:
    """Clean one wide table of text cells.

    The register needs every cell once: cells are unpivoted, so the rules compile
    once and not once per column. Equal cells of a column have equal results, so they are
    counted before the shuffle and ruled once; all counts weigh them. Ruled values are landed,
    so the table is read once for the register, once for equal rows and once for the result. What the counts say then shapes the output: the cleaned table is a lazy
    projection over rows dealt out once, in which a column carries only the rules that fired.
    """
    cols = list(df.columns)
    spark = df.sparkSession
    text = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in cols])
    hot = F.col("column").isin(*[c for c in cols if names.suggests_temperature(c)]) if any(
        map(names.suggests_temperature, cols)
    ) else F.lit(False)
    spelled = text.unpivot([], cols, "column", "cell").groupBy("column", "cell").agg(F.count(F.lit(1)).alias("n"))
    cells = land_ruled(spelled, hot, ["column", "n"])
    per_column = land(rule_summary(cells, ["column"], weight="n"))
    facts = {c: dict.fromkeys(COUNT_NAMES, 0) for c in cols} | {r["column"]: r for r in per_column.collect()}  # one row per column

    numeric = [c for c in cols if facts[c]["n_numeric"] >= OUTLIER_MIN_VALUES]
    kept = cells.select("column", F.col("`cell.value`").alias("value"), "n")
    values = land(distinct_values(kept.where(F.col("column").isin(numeric)), ["column"], "n").drop("text"))
    log = land(category_changes(kept, ["column"], "n"))
    outliers = log_mad_outliers(values, ["column"], few_values(values))
    recoded = log.groupBy("column").agg(F.sum("rows_affected").alias("n_recoded"))
    recode = {r["column"] for r in recoded.select("column").collect()}

    stats = per_column.join(outliers, "column", "left").join(recoded, "column", "left")
    stats = stats.select(F.lit(workbook).alias("workbook"), F.lit(sheet).alias("sheet"), "*")
    issues = column_issues(stats, ["workbook", "sheet", "column"])
    dup = duplicate_issues(duplicate_rows(df, cols).select(F.lit(workbook).alias("workbook"), F.lit(sheet).alias("sheet"), "*"))

    fired = ("n_footnote", "n_placeholder", "n_sentinel", "n_unit", "n_date", "n_temperature")
    touched = [c for c in cols if c in recode or any(facts[c][n] for n in fired)]
    ruled = apply_rules(spread(text) if touched else text, {c: F.lit(names.suggests_temperature(c)) for c in touched})
    ruled = ruled.withColumns({f"{c}.clean": clean_text(F.col(f"`{c}.value`")) for c in touched if c in recode})
    out: list[Column] = []
    shadows: list[Column] = []
    for c in cols:
        f = facts[c]
        if c in recode:
            cell = canonical_text(F.col(f"`{c}.clean`"))
        else:
            cell = F.col(f"`{c}.value`") if c in touched else F.col(f"`{c}`")
        is_number = f["n_value"] > 0 and f["n_numeric"] >= PROMOTION_SHARE * f["n_value"]
        out.append((strict_number(cell) if is_number else cell).alias(c))
        if f["n_footnote"]:
            shadows.append(F.col(f"`{c}.flag`").alias(f"{c}_flag"))
        if f["n_date"]:
            shadows.append(F.col(f"`{c}.iso_date`").alias(f"{c}_iso_date"))
        if f["n_changed"] or c in recode or (is_number and f["n_numeric"] < f["n_value"]):
            shadows.append(F.col(f"`{c}`").alias(f"raw__{c}"))
    return Cleaned(
        table=ruled.select(*out, *shadows),
        issues=dup.unionByName(issues),
        log=log.select(F.lit(workbook).alias("workbook"), F.lit(sheet).alias("sheet"), "*"),
    )


def clean_cells(body: DataFrame, keys: list[str]) -> Cleaned:
    """Clean the cells of many sheets at once.

    ``body`` is (keys, row_idx, column, value). The cleaned frame is (keys,
    row_idx, column, raw, value, number, flag, iso_date); ``number`` is filled for
    columns that become numeric. Equal rows of a sheet are one issue of it. Nothing is
    collected; the counts and the distinct values are landed.
    """
    by_column = [*keys, "column"]
    hot = F.lower("column").contains(names.TEMPERATURE_HINTS[0])
    ruled = land_ruled(body.select(*keys, "row_idx", "column", F.col("value").alias("cell")), hot, [*by_column, "row_idx"])
    stats = land(rule_summary(ruled, by_column, row="row_idx"))
    kept = ruled.select(*by_column, F.col("`cell.value`").alias("value"))
    values = land(distinct_values(kept, by_column).drop("text"))
    log = land(category_changes(kept, by_column))
    recoded = log.groupBy(*by_column).agg(F.sum("rows_affected").alias("n_recoded"))
    wide = attach(attach(stats, log_mad_outliers(values, by_column, few_values(values)), by_column, "left"), recoded, by_column, "left")
    issues = duplicate_issues(workbook_and_sheet(duplicate_cells(body, keys), keys)).unionByName(
        column_issues(workbook_and_sheet(wide, keys), ["workbook", "sheet", "column"]))
    decided = wide.select(
        *by_column, promotes(F.col("n_numeric"), F.col("n_value")).alias("_number"),
        F.col("n_recoded").isNotNull().alias("_recode"),
    )
    final = attach(ruled, decided, by_column).withColumn("_clean", clean_text(F.col("`cell.value`")))
    text = F.when(F.col("_recode"), canonical_text(F.col("_clean"))).otherwise(F.col("`cell.value`"))
    table = final.select(
        *keys, "row_idx", "column", F.col("`cell.raw`").alias("raw"), text.alias("value"),
        F.when(F.col("_number"), strict_number(F.col("`cell.value`"))).alias("number"),
        F.col("`cell.flag`").alias("flag"), F.col("`cell.iso_date`").alias("iso_date"),
    )
    return Cleaned(table=table, issues=issues, log=log)
