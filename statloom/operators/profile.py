"""Column profiles.

The working frame is *cells*: (keys, value), one row per cell, where the keys
name the column (and the table, when many tables are profiled at once). A wide
table becomes cells by one unpivot. Aggregates over cells combine map-side, so
only (keys x partitions) rows are shuffled; exact quantiles and distinct counts
use value counts (see ``ordered``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql import types as T

from statloom.functions import names, stats
from statloom.functions.nulls import share_of
from statloom.functions.numbers import strict_number
from statloom.operators.ordered import attach, average_ranks, is_small, quantiles, running_totals, value_counts
from statloom.sources.landing import land, unweighed

NUMERIC_ROLE_SHARE = 0.5
MIXED_LOW, MIXED_HIGH = 0.05, 0.95
T1_ROWS, T2_ROWS, T1_COLUMNS = 200, 50, 4
BIMODAL_ABOVE, HEAVY_TAIL_ABOVE, LOG_RATIO_ABOVE = 0.555, 2.0, 100.0
RARE_COUNT = 3
DIGESTS_HELD = 1 << 22  # digests that a task holds before it sorts and cuts them
DIGESTS_OF_A_BLOCK = 1 << 21  # digests of a set of columns that are compared at once
MOST_TASKS = 4096
TURN = 21  # bits by which the digest of each further column of a set is turned

DESCRIPTIVE_QUANTILES = {
    "p01": 0.01, "p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99,
}


# ---- roles and tiers ---------------------------------------------------------

@dataclass(frozen=True)
class Roles:
    numeric: list[str]
    categorical: list[str]
    temporal: list[str]


def column_roles(df: DataFrame) -> Roles:
    """Role of every data column. Text columns count as numeric when most cells parse.

    One aggregate over the text columns; a vector as long as the schema comes back.
    """
    typed = {f.name: f.dataType for f in df.schema.fields}
    cols = [c for c in df.columns if not (names.is_shadow(c) or names.is_flag(c))]
    text = [c for c in cols if isinstance(typed[c], T.StringType) and not names.is_iso_date(c)]
    share = {}
    if text:
        def parsed(c: str) -> Column:
            return F.avg(F.when(F.col(f"`{c}`").isNull(), None).when(strict_number(F.col(f"`{c}`")).isNull(), 0.0).otherwise(1.0))

        row = df.agg(*[parsed(c).alias(c) for c in text]).first()
        share = row.asDict()
    numeric, categorical, temporal = [], [], []
    for c in cols:
        if names.is_iso_date(c) or isinstance(typed[c], (T.DateType, T.TimestampType, T.TimestampNTZType)):
            temporal.append(c)
        elif isinstance(typed[c], T.NumericType) or (share.get(c) or 0.0) > NUMERIC_ROLE_SHARE:
            numeric.append(c)
        else:
            categorical.append(c)
    return Roles(numeric, categorical, temporal)


def tier(n_rows: Column, n_profiled: Column, sheet_id: Column) -> Column:
    """T1 deep dive, T2 medium, T3 inventory only."""
    meta = F.lit(False)
    for hint in names.METADATA_SHEET_HINTS:
        meta = meta | F.lower(sheet_id).contains(hint)
    return (
        F.when(meta | (n_rows < T2_ROWS), "T3")
        .when((n_rows >= T1_ROWS) & (n_profiled >= T1_COLUMNS), "T1")
        .otherwise("T2")
    )


def catalog_row(df: DataFrame, publisher: str, sheet_id: str, roles: Roles) -> DataFrame:
    """Catalog entry of one table: size, role counts and tier."""
    profiled = F.lit(len(roles.numeric) + len(roles.categorical))
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(publisher).alias("publisher"), F.lit(sheet_id).alias("sheet_id"),
        tier(F.col("n_rows"), profiled, F.lit(sheet_id)).alias("tier"),
        "n_rows", F.lit(len(df.columns)).alias("n_cols"),
        F.lit(len(roles.numeric)).alias("n_numeric"), F.lit(len(roles.categorical)).alias("n_categorical"),
        F.lit(len(roles.temporal)).alias("n_temporal"),
    )


def inventory(catalog: DataFrame, by: str) -> DataFrame:
    """Tables and rows per tier or per publisher."""
    return catalog.groupBy(by).agg(F.count(F.lit(1)).alias("n_sheets"), F.sum("n_rows").alias("n_rows"))


# ---- cells -------------------------------------------------------------------

def numeric_cells(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value double) of the named columns."""
    number = (T.NumericType,)
    typed = {f.name: f.dataType for f in df.schema.fields}
    picked = [
        (F.col(f"`{c}`").cast("double") if isinstance(typed[c], number) else strict_number(F.col(f"`{c}`"))).alias(c)
        for c in cols
    ]
    return df.select(*picked).unpivot([], cols, "column", "value")


def text_cells(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value string) of the named columns."""
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in cols]).unpivot([], cols, "column", "value")


# ---- schema and missingness --------------------------------------------------

def schema_report(df: DataFrame) -> DataFrame:
    """Per column: dtype, nulls, distinct values, share of numbers in text, housekeeping flags."""
    kinds = F.create_map(*[x for c, t in df.dtypes for x in (F.lit(c), F.lit(t))])
    cells = text_cells(df, df.columns)
    number = strict_number(F.col("value"))
    counted = cells.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    per = counted.groupBy("column").agg(
        F.sum("n").alias("n_total"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("n_null"),
        F.count("value").alias("n_unique"),
        F.coalesce(F.sum(F.when(number.isNotNull(), F.col("n"))), F.lit(0)).alias("_numeric"),
    )
    filled = F.col("n_total") - F.col("n_null")
    dtype = F.try_element_at(kinds, F.col("column"))
    share = F.when((dtype == "string") & (filled > 0), F.col("_numeric") / filled)
    return per.select(
        "column", dtype.alias("dtype"), "n_total", "n_null",
        F.round(100.0 * F.col("n_null") / F.greatest(F.col("n_total"), F.lit(1)), 2).alias("null_pct"),
        "n_unique",
        F.round(100.0 * F.col("n_unique") / F.greatest(filled, F.lit(1)), 2).alias("uniq_pct"),
        F.startswith("column", F.lit("raw__")).alias("is_raw_shadow"),
        F.endswith("column", F.lit("_iso_date")).alias("is_iso_date"),
        F.endswith("column", F.lit("_flag")).alias("is_flag"),
        F.round(share, 4).alias("object_with_numeric_share"),
        F.coalesce((share > MIXED_LOW) & (share < MIXED_HIGH), F.lit(False)).alias("mixed_type_residue"),
    )


def null_profile(df: DataFrame) -> DataFrame:
    """(column, n, n_null, null_share), one pass, no value is shuffled."""
    cols = df.columns
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"_{i}") for i, c in enumerate(cols)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("n_null")) for i, c in enumerate(cols)])
    return one.select("n", F.inline(rows)).select(
        "column", "n", "n_null", F.when(F.col("n") > 0, F.col("n_null") / F.col("n")).alias("null_share")
    )


def null_summary(profile: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Table level: cells, null cells, null_pct, all-null / no-null / half-null columns."""
    share = F.col("null_share")
    return profile.groupBy(*(keys or [])).agg(
        F.sum("n").alias("n_cells"), F.sum("n_null").alias("n_null_cells"),
        F.round(100.0 * F.avg(share), 2).alias("null_pct"),
        F.count_if(share == 1.0).alias("cols_all_null"),
        F.count_if(share == 0.0).alias("cols_no_null"),
        F.count_if(share >= 0.5).alias("cols_high_null_50pct"),
    )


def partly_null(df: DataFrame) -> list[str]:
    """Columns with some but not all cells missing (a role vector)."""
    rows = null_profile(df).where((F.col("n_null") > 0) & (F.col("n_null") < F.col("n"))).collect()
    found = {r["column"] for r in rows}
    return [c for c in df.columns if c in found]


def null_pairs(df: DataFrame, above: float = 0.7, cols: list[str] | None = None) -> DataFrame:
    """(col_a, col_b, null_corr): columns that are missing together, one aggregate for all pairs."""
    cols = partly_null(df) if cols is None else cols
    flags = {c: F.when(F.col(f"`{c}`").isNull(), 1.0).otherwise(0.0) for c in cols}
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    return _pair_rows(df, pairs, lambda a, b: F.round(F.corr(flags[a], flags[b]), 4), "null_corr").where(
        F.abs("null_corr") > above
    )


def _pair_rows(df: DataFrame, pairs: list[tuple[str, str]], measure, name: str) -> DataFrame:
    if not pairs:
        return df.sparkSession.createDataFrame([], f"col_a string, col_b string, {name} double")
    one = df.agg(*[measure(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(
        *[F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"_{i}").alias(name)) for i, (a, b) in enumerate(pairs)]
    )
    return one.select(F.inline(rows))


def missing_by_quartile(
    df: DataFrame, value_cols: list[str], null_cols: list[str] | None = None, spread_above: float = 0.3
) -> DataFrame:
    """Does the null share of X change with the quartile of Y? Rows where the spread is large.

    Buckets are right-closed; equal edges merge.
    """
    null_cols = partly_null(df) if null_cols is None else null_cols
    values = list(value_cols)
    flags = [F.col(f"`{c}`").isNull().cast("int").alias(f"_null_{i}") for i, c in enumerate(null_cols)]
    wide = df.select(*flags, *[F.col(f"`{c}`").cast("double").alias(c) for c in values])
    long = wide.unpivot([f"_null_{i}" for i in range(len(null_cols))], values, "varies_with", "_y").where(F.col("_y").isNotNull())
    edges = quantiles(long, ["varies_with"], "_y", {"_q0": 0.0, "_q1": 0.25, "_q2": 0.5, "_q3": 0.75}, small=is_small(df))
    placed = attach(long, edges, ["varies_with"])
    bucket = F.lit(0)
    for q in ("_q1", "_q2", "_q3"):
        bucket = bucket + F.when((F.col(q) > F.col("_q0")) & (F.col(q) < F.col("_y")), 1).otherwise(0)
    shares = placed.groupBy("varies_with", bucket.alias("_bucket")).agg(
        *[F.avg(f"_null_{i}").alias(c) for i, c in enumerate(null_cols)]
    )
    rows = shares.unpivot(["varies_with"], null_cols, "missing_in", "_share")
    out = rows.where(F.col("missing_in") != F.col("varies_with")).groupBy("missing_in", "varies_with").agg(
        F.round(F.min("_share"), 4).alias("null_share_min"), F.round(F.max("_share"), 4).alias("null_share_max"),
        (F.max("_share") - F.min("_share")).alias("_spread"),
    )
    return out.where(F.col("_spread") > spread_above).withColumn("spread", F.round("_spread", 4)).drop("_spread")


# ---- numeric profiles --------------------------------------------------------

def settled_counts(cells: DataFrame, keys: list[str]) -> tuple[DataFrame, bool]:
    """Landed value counts, and whether they are small enough for in-memory quantiles.

    Several measures read the counts, so they are grouped once and written.
    """
    counts = land(value_counts(cells, keys, "value"))
    return counts, is_small(counts)


def numeric_moments(cells: DataFrame, keys: list[str]) -> DataFrame:
    """n, mean, std, min, max, corrected skew and kurtosis, zero and negative share."""
    v = F.col("value")
    raw = cells.where(v.isNotNull()).groupBy(*keys).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"), F.skewness(v).alias("_g1"), F.kurtosis(v).alias("_g2"),
        share_of(v == 0).alias("zero_share"), share_of(v < 0).alias("negative_share"),
    )
    n, std = F.col("n"), F.col("std")
    return raw.select(
        *keys, "n", "mean", "std", "min", "max",
        stats.corrected_skew(n, F.col("_g1"), std).alias("skew"),
        stats.corrected_kurtosis(n, F.col("_g2"), std).alias("kurtosis"),
        "zero_share", "negative_share",
    )


def numeric_descriptives(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Moments, exact quantiles, MAD and distinct values, one row per column.

    Cells are read once, for the value counts; one selection over them gives all quantiles. With mean and median
    known, a second pass over the counts gives the central moments and the selection of the median distance.
    """
    counts, small = settled_counts(cells, keys)
    v, n = F.col("value"), F.col("n")
    points = quantiles(counts, keys, "value", DESCRIPTIVE_QUANTILES, weight="n", small=small)
    sums = counts.groupBy(*keys).agg(
        F.sum(n).alias("n"), F.count(F.lit(1)).alias("n_unique"), (F.sum(v * n) / F.sum(n)).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"),
        (F.coalesce(F.sum(F.when(v == 0, n)), F.lit(0)) / F.sum(n)).alias("zero_share"),
        (F.coalesce(F.sum(F.when(v < 0, n)), F.lit(0)) / F.sum(n)).alias("negative_share"),
    )
    base = land(attach(points, sums, keys))
    near = attach(counts, base.select(*keys, F.col("mean").alias("_mean"), F.col("median").alias("_median")), keys)
    d = v - F.col("_mean")
    central = near.groupBy(*keys).agg(F.sum(n * d * d).alias("_m2"), F.sum(n * d * d * d).alias("_m3"), F.sum(n * d * d * d * d).alias("_m4"))
    mad = quantiles(near.withColumn("_away", F.abs(v - F.col("_median"))), keys, "_away", {"mad": 0.5}, weight="n", small=small)
    out = attach(attach(base, central, keys), mad, keys)
    m2 = F.when(F.col("_m2") > 0, F.col("_m2"))
    out = out.withColumn("std", F.coalesce(F.sqrt(F.when(n > 1, F.col("_m2") / (n - 1))), F.lit(0.0)))
    skew = stats.corrected_skew(n, F.sqrt(n) * F.col("_m3") / F.pow(m2, F.lit(1.5)), F.col("std"))
    kurtosis = stats.corrected_kurtosis(n, n * F.col("_m4") / (m2 * m2) - 3.0, F.col("std"))
    return out.select(
        *keys, "n", "n_unique", "mean", "std", "min", "p01", "p05", "p25", "median", "p75", "p95", "p99", "max",
        (F.col("p75") - F.col("p25")).alias("iqr"), "mad", skew.alias("skew"), kurtosis.alias("kurtosis"), "zero_share", "negative_share",
        (F.col("n_unique") <= 1).alias("constant"),
    )


def distribution_flags(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Two modes, zero inflation, heavy tail, log scale; columns with 8 values or more."""
    m = numeric_moments(cells, keys).where(F.col("n") >= 8)
    bc = stats.bimodality(F.col("n"), F.col("skew"), F.col("kurtosis"))
    return m.select(
        *keys, "n", F.round(bc, 4).alias("bimodality_coefficient"),
        F.coalesce(bc > BIMODAL_ABOVE, F.lit(False)).alias("bimodal_likely"),
        F.round("zero_share", 4).alias("zero_inflation"),
        F.round(F.col("n") * (1 - F.col("zero_share"))).cast("bigint").alias("n_nonzero"),
        F.coalesce(F.abs("skew") > HEAVY_TAIL_ABOVE, F.lit(False)).alias("heavy_tail"),
        ((F.col("min") > 0) & (F.col("max") / F.greatest("min", F.lit(1e-9)) > LOG_RATIO_ABOVE)).alias("log_scale_recommended"),
        "min", "max",
    )


def bin_index(v: Column, low: Column, high: Column, bins: Column) -> Column:
    """0-based equal-width bin; the last bin is closed on the right."""
    place = F.floor((v - low) / (high - low) * bins)
    return F.when(high > low, F.least(place, bins - 1)).otherwise(F.lit(0)).cast("bigint")


def histogram(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bin, bin_low, bin_high, n) with Freedman-Diaconis bins, 5 at least; bins without values have no row."""
    counts, small = settled_counts(cells, keys)
    q = quantiles(counts, keys, "value", {"_q25": 0.25, "_q75": 0.75}, weight="n", small=small)
    size = counts.groupBy(*keys).agg(F.sum("n").alias("_n"), F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    iqr = F.col("_q75") - F.col("_q25")
    width = F.when(iqr > 0, 2.0 * iqr * F.pow(F.col("_n"), F.lit(-1.0 / 3)))
    flat = F.greatest(F.lit(10), F.floor(F.sqrt("_n")))
    fd = F.greatest(F.lit(5), F.ceil((F.col("_hi") - F.col("_lo")) / width))
    bins = F.when(F.col("_n") < 2, 10).otherwise(F.coalesce(fd, flat)).cast("bigint")
    plan = attach(size, q, keys).select(*keys, "_lo", "_hi", bins.alias("_bins"))
    step = (F.col("_hi") - F.col("_lo")) / F.col("_bins")
    placed = attach(counts, plan, keys).withColumn("bin", bin_index(F.col("value"), F.col("_lo"), F.col("_hi"), F.col("_bins")))
    return placed.groupBy(*keys, "bin", "_lo", "_hi", "_bins").agg(F.sum("n").alias("n")).select(
        *keys, "bin", (F.col("_lo") + F.col("bin") * step).alias("bin_low"),
        (F.col("_lo") + (F.col("bin") + 1) * step).alias("bin_high"), "n",
    )


def outlier_register(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Tukey, modified z and log-MAD counts, their agreement and disagreement.

    Everything runs on value counts: an outlier is a property of the value. Values and logs share one selection of
    quartiles and medians, their distances one of the median distance.
    """
    counts, small = settled_counts(cells, keys)
    v, n = F.col("value"), F.col("n")

    def both(plain: Column, log: Column, name: str) -> Column:
        return F.inline(F.array(F.struct(F.lit("plain").alias("_kind"), plain.alias(name)), F.struct(F.lit("log").alias("_kind"), log.alias(name))))

    def side_by_side(found: DataFrame, names: dict[tuple[str, str], str]) -> DataFrame:
        return found.groupBy(*keys).agg(*[F.max(F.when(F.col("_kind") == kind, F.col(c))).alias(out) for (kind, c), out in names.items()])

    size = counts.groupBy(*keys).agg(F.sum("n").alias("_n"), F.coalesce(F.sum(F.when(v > 0, n)), F.lit(0)).alias("_n_pos"))
    centre = quantiles(counts.select(*keys, "n", both(v, F.log(F.when(v > 0, v)), "_x")), [*keys, "_kind"], "_x", {"_q1": 0.25, "_m": 0.5, "_q3": 0.75}, weight="n", small=small)
    centre = side_by_side(centre, {("plain", "_q1"): "_q1", ("plain", "_m"): "_med", ("plain", "_q3"): "_q3", ("log", "_m"): "_lmed"})
    known = land(attach(size, centre, keys))
    x = attach(counts, known, keys)
    away = x.select(*keys, "n", both(F.abs(v - F.col("_med")), F.abs(F.log(F.when(v > 0, v)) - F.col("_lmed")), "_away"))
    spread = quantiles(away, [*keys, "_kind"], "_away", {"_m": 0.5}, weight="n", small=small)
    x = attach(x, side_by_side(spread, {("plain", "_m"): "_mad", ("log", "_m"): "_lmad"}), keys)
    v, iqr = F.col("value"), F.col("_q3") - F.col("_q1")
    tukey = (F.col("_n") >= 8) & (iqr > 0) & ((v < F.col("_q1") - 1.5 * iqr) | (v > F.col("_q3") + 1.5 * iqr))
    modz = (F.col("_n") >= 8) & (F.col("_mad") > 0) & (F.abs(0.6745 * (v - F.col("_med"))) > 3.5 * F.col("_mad"))
    lz = F.abs(0.6745 * (F.log(F.when(v > 0, v)) - F.col("_lmed"))) > 3.5 * F.col("_lmad")
    logmad = F.coalesce((F.col("_n_pos") >= 12) & (F.col("_lmad") > 0) & lz, F.lit(False))

    def hits(pred: Column) -> Column:
        return F.coalesce(F.sum(F.when(pred, F.col("n"))), F.lit(0))

    out = x.groupBy(*keys).agg(
        F.sum("n").alias("n_non_null"), hits(tukey).alias("n_tukey"), hits(modz).alias("n_modified_z"),
        hits(logmad).alias("n_log_mad"), hits(tukey & modz & logmad).alias("n_agree_all_three"),
    )
    three = [F.col("n_tukey"), F.col("n_modified_z"), F.col("n_log_mad")]
    return out.where(F.greatest(*three) > 0).select(
        *out.columns, (F.greatest(*three) - F.least(*three)).alias("method_disagreement"),
        F.round(F.col("n_log_mad") / F.greatest(F.col("n_non_null"), F.lit(1)), 4).alias("share_log_mad"),
    )


# ---- categorical profiles ----------------------------------------------------

def categorical_profile(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cardinality, top two values, singletons, rare share, entropy and Gini per column.

    Ties go to the smaller value. Gini needs ranks of the *counts*; equal counts
    are collapsed first, so a column with any number of values is a short list.
    """
    counts, _ = settled_counts(cells, keys)
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("_total"))
    order = F.struct((-F.col("n")).alias("a"), F.col("value").alias("b"))
    share = F.col("n") / F.col("_total")
    per = attach(counts, totals, keys).groupBy(*keys, "_total").agg(
        F.count(F.lit(1)).alias("n_unique"),
        F.min(F.struct(order.alias("o"), F.col("value").alias("v"), F.col("n").alias("n"))).alias("_top"),
        F.count_if(F.col("n") == 1).alias("singleton_value_count"),
        F.count_if(F.col("n") <= RARE_COUNT).alias("_rare"),
        stats.entropy_bits(share).alias("_entropy"),
    )
    # The runner-up is the smallest (count, value) that is not the top itself.
    rest = attach(counts, per.select(*keys, F.col("_top.v").alias("_first")), keys).where(F.col("value") != F.col("_first"))
    second = rest.groupBy(*keys).agg(F.min(F.struct(order.alias("o"), F.col("value").alias("v"), F.col("n").alias("n"))).alias("_second"))
    out = attach(attach(per, second, keys, "left"), gini_of_counts(counts, keys), keys)
    k, total = F.col("n_unique"), F.col("_total")
    return out.select(
        *keys, total.alias("n_non_null"), "n_unique", F.round(k / total, 4).alias("uniq_share"),
        F.col("_top.v").alias("top_value"), F.round(F.col("_top.n") / total, 4).alias("top_share"),
        F.coalesce(F.col("_second.v"), F.lit("")).alias("second_value"),
        F.round(F.coalesce(F.col("_second.n") / total, F.lit(0.0)), 4).alias("second_share"),
        "singleton_value_count", F.round(F.col("singleton_value_count") / k, 4).alias("singleton_share"),
        F.round("gini", 4).alias("gini_concentration"), F.round("_entropy", 4).alias("shannon_entropy_bits"),
        F.round(F.log2(k), 4).alias("max_entropy_bits"), F.round(F.col("_rare") / k, 4).alias("rare_share_le_3"),
        (k <= 1).alias("constant"),
    )


def gini_of_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, gini) of the value counts, from their frequency of frequencies.

    With counts c ascending, sum of running totals = sum over blocks of equal c.
    The list of different counts is at most sqrt(2 n) long.
    """
    freq = counts.groupBy(*keys, F.col("n").alias("_c")).agg(F.count(F.lit(1)).alias("_m"))
    upto = W.partitionBy(*keys).orderBy("_c").rowsBetween(W.unboundedPreceding, -1)
    block = freq.withColumn("_before", F.coalesce(F.sum(F.col("_c") * F.col("_m")).over(upto), F.lit(0)))
    m, c = F.col("_m").cast("double"), F.col("_c").cast("double")
    area = block.groupBy(*keys).agg(
        F.sum(m * F.col("_before") + c * m * (m + 1) / 2).alias("_area"), F.sum(c * m).alias("_all"), F.sum(m).alias("_k")
    )
    return area.select(*keys, ((F.col("_k") + 1 - 2 * F.col("_area") / F.col("_all")) / F.col("_k")).alias("gini"))


def lorenz_curve(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_values, n_rows, cum_share): running share of the value counts, largest first.

    One row per different count (``n_values`` values have it), so the curve of a
    huge column stays short.
    """
    freq = counts.groupBy(*keys, "n").agg(F.count(F.lit(1)).alias("n_values"))
    down = W.partitionBy(*keys).orderBy(F.col("n").desc()).rowsBetween(W.unboundedPreceding, 0)
    rows = F.col("n") * F.col("n_values")
    whole = F.sum(rows).over(W.partitionBy(*keys))
    return freq.select(*keys, F.col("n").alias("count_each"), "n_values", (F.sum(rows).over(down) / whole).alias("cum_share"))


# ---- correlation -------------------------------------------------------------

def correlation_columns(df: DataFrame, cols: list[str]) -> list[str]:
    """Columns with at least four values and some variance (a role vector)."""
    row = df.agg(*[F.struct(F.count(F.col(f"`{c}`")), F.coalesce(F.stddev_pop(F.col(f"`{c}`").cast("double")), F.lit(0.0))).alias(c) for c in cols]).first()
    return [c for c in cols if row[c][0] >= 4 and row[c][1] > 0]


def pearson_pairs(df: DataFrame, cols: list[str], min_pairs: int = 4) -> DataFrame:
    """(col_a, col_b, pearson): pairwise complete, every pair in one aggregate."""
    d = {c: F.col(f"`{c}`").cast("double") for c in cols}

    def measure(a: str, b: str) -> Column:
        both = F.count_if(d[a].isNotNull() & d[b].isNotNull())
        return F.when(both >= min_pairs, F.round(F.corr(d[a], d[b]), 4))

    return _pair_rows(df, [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]], measure, "pearson")


def correlation_matrix(pairs: DataFrame, cols: list[str], value: str) -> DataFrame:
    """Square form of a pair list, one row per column."""
    both = pairs.select("col_a", "col_b", value).unionAll(pairs.select(F.col("col_b"), F.col("col_a"), F.col(value)))
    return both.groupBy(F.col("col_a").alias("column")).pivot("col_b", cols).agg(F.first(value))


def collinear_pairs(pairs: DataFrame, at_least: float = 0.95) -> DataFrame:
    return pairs.where(F.abs("pearson") >= at_least)


def cross_products(rows: DataFrame, cols: list[str]) -> DataFrame:
    """(i, j, s): sums of products of all pairs of numeric columns, i <= j, without NULL or NaN in them.

    A task multiplies its rows as a block and gives out one square of sums, whatever the number of rows.
    """
    k = len(cols)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            block = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            total += block.T @ block
        i, j = np.triu_indices(k)
        yield pa.record_batch([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "s"])

    parts = rows.select(*[F.col(f"`{c}`").cast("double").alias(f"c{n}") for n, c in enumerate(cols)]).mapInArrow(products, "i int, j int, s double")
    return parts.groupBy("i", "j").agg(F.sum("s").alias("s"))


def rank_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """The columns (complete, numeric) replaced by their average ranks, less the mean rank.

    Each cell crosses the shuffle twice, to its value's rank and back to its row, however many pairs are looked at later.
    """
    wide = land(df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{n}") for n, c in enumerate(cols)]).withColumn("_row", F.monotonically_increasing_id()))
    cells = wide.unpivot(["_row"], [f"c{n}" for n in range(len(cols))], "column", "value")
    counts = land(value_counts(cells, ["column"], "value"))
    ranks = average_ranks(counts, ["column"], "value", "n", "rank")
    middle = (wide.count() + 1) / 2.0
    placed = cells.join(ranks.select("column", "value", (F.col("rank") - middle).alias("rank")), ["column", "value"])
    by_row = placed.groupBy("_row").agg(*[F.max(F.when(F.col("column") == f"c{n}", F.col("rank"))).alias(c) for n, c in enumerate(cols)])
    return by_row.select(*[f"`{c}`" for c in cols])


def spearman_pairs(df: DataFrame, cols: list[str], min_pairs: int = 4) -> DataFrame:
    """(col_a, col_b, spearman): Pearson of average ranks over the rows where both exist.

    Columns without NULL have the same ranks in every pair: they are ranked once, and one pass over the rows gives the
    products of all their pairs. Only a pair with a NULL somewhere is ranked by itself.
    """
    spark = df.sparkSession
    missing = {r["column"]: r["n_null"] for r in null_profile(df.select(*[F.col(f"`{c}`") for c in cols])).collect()}
    whole = [c for c in cols if not missing[c]]
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    apart = pairs if len(whole) < 2 else [(a, b) for a, b in pairs if missing[a] or missing[b]]
    found = _spearman_apart(df, apart, min_pairs) if apart else spark.createDataFrame([], "col_a string, col_b string, spearman double")
    if len(whole) < 2:
        return found
    sums = land(cross_products(rank_columns(df, whole), whole))
    square = sums.where("i = j")
    near = sums.where("i < j").join(square.select("i", F.col("s").alias("_xx")), "i").join(square.select("j", F.col("s").alias("_yy")), "j")
    rho = F.when((F.col("_xx") > 0) & (F.col("_yy") > 0), F.col("s") / F.sqrt(F.col("_xx") * F.col("_yy")))
    rho = F.when(F.lit(min_pairs) <= df.agg(F.count(F.lit(1)).alias("n")).scalar(), rho)
    named = F.array(*[F.lit(c) for c in whole])
    return near.select(F.get(named, F.col("i")).alias("col_a"), F.get(named, F.col("j")).alias("col_b"), F.round(rho, 4).alias("spearman")).unionByName(found)


def _spearman_apart(df: DataFrame, pairs: list[tuple[str, str]], min_pairs: int) -> DataFrame:
    """Each pair over its own complete rows. Equal (a, b) combinations collapse before anything is ranked."""
    cols = list(dict.fromkeys(c for pair in pairs for c in pair))
    wide = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in cols])
    rows = F.array(
        *[F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(a).alias("_x"), F.col(b).alias("_y")) for a, b in pairs]
    )
    keys = ["col_a", "col_b"]
    joint = wide.select(F.inline(rows)).where(F.col("_x").isNotNull() & F.col("_y").isNotNull())
    joint = land(joint.groupBy(*keys, "_x", "_y").agg(F.count(F.lit(1)).alias("n")))
    small = is_small(joint)

    def ranks(v: str, out: str) -> DataFrame:
        counts = joint.groupBy(*keys, v).agg(F.sum("n").alias("_m"))
        run = running_totals(counts, keys, [v], {"_cum": "_m"}, small=small)
        return run.select(*keys, v, (F.col("_cum") - F.col("_m") + (F.col("_m") + 1) / 2.0).alias(out))

    placed = joint.join(ranks("_x", "_rx"), [*keys, "_x"]).join(ranks("_y", "_ry"), [*keys, "_y"])
    n, x, y = F.col("n"), F.col("_rx"), F.col("_ry")
    # Ranks are centred on (N+1)/2, known per pair, which keeps the sums exact enough.
    size = joint.groupBy(*keys).agg(F.sum("n").alias("_N"))
    c = attach(placed, size, keys)
    dx, dy = x - (F.col("_N") + 1) / 2.0, y - (F.col("_N") + 1) / 2.0
    sums = c.groupBy(*keys, "_N").agg(
        F.sum(n * dx * dy).alias("_xy"), F.sum(n * dx * dx).alias("_xx"), F.sum(n * dy * dy).alias("_yy")
    )
    rho = F.when((F.col("_N") >= min_pairs) & (F.col("_xx") > 0) & (F.col("_yy") > 0), F.col("_xy") / F.sqrt(F.col("_xx") * F.col("_yy")))
    return sums.select(*keys, F.round(rho, 4).alias("spearman"))


def binned_dependency(df: DataFrame, target: str, features: list[str], bins: int = 10) -> DataFrame:
    """(feature, target_proxy, mutual_information) in nats from decile bins.

    Missing values take the median of their column.
    """
    cols = [target, *features]
    small = is_small(df)
    probs = {f"_e{i}": i / bins for i in range(1, bins)}
    cells = numeric_cells(df, cols)
    edges = quantiles(cells, ["column"], "value", {**probs, "_med": 0.5}, small=small)
    # One row with all edges, one struct per column: as wide as the schema, never longer.
    # Landed, because every column below is a scalar subquery on it.
    wide = land(edges.groupBy().pivot("column", cols).agg(F.first(F.struct(*probs, "_med"))))
    from_row = {c: wide.select(F.col(f"`{c}`")).scalar() for c in cols}

    def bucket(c: str) -> Column:
        e = from_row[c]
        x = F.coalesce(F.col(f"`{c}`").cast("double"), e["_med"])
        total = F.lit(0)
        for name in probs:
            total = total + F.when(x > e[name], 1).otherwise(0)
        return total

    binned = df.select(bucket(target).alias("_t"), *[bucket(c).alias(c) for c in features])
    long = binned.unpivot(["_t"], features, "feature", "_f")
    joint = long.groupBy("feature", "_f", "_t").agg(F.count(F.lit(1)).alias("n"))
    n, w = F.col("n"), lambda *c: W.partitionBy("feature", *c)
    p = joint.select(
        "feature", (n / F.sum(n).over(w())).alias("_p"),
        (F.sum(n).over(w("_f")) / F.sum(n).over(w())).alias("_pf"),
        (F.sum(n).over(w("_t")) / F.sum(n).over(w())).alias("_pt"),
    )
    mi = F.sum(F.col("_p") * F.log(F.col("_p") / (F.col("_pf") * F.col("_pt"))))
    return p.groupBy("feature").agg(F.round(mi, 4).alias("mutual_information")).select(
        "feature", F.lit(target).alias("target_proxy"), "mutual_information"
    )


# ---- temporal coverage -------------------------------------------------------

EARLIEST, LATEST = "1700-01-01", "2200-01-01"


def temporal_coverage(dates: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(summary, gaps) of (keys, date) rows.

    Steps and gaps are those of the dates between 1700 and 2200, at most 182,622 per key, so the window over them is bounded
    whatever the size of the table. Other dates are taken for errors of the workbook: ``n_dates_outside`` counts them.
    """
    inside = F.col("date").between(F.lit(EARLIEST).cast("date"), F.lit(LATEST).cast("date"))
    found = dates.where(F.col("date").isNotNull()).select(*keys, "date").distinct()
    outside = found.groupBy(*keys).agg(F.count_if(~inside).alias("n_dates_outside"))
    seen = found.where(inside)
    order = W.partitionBy(*keys).orderBy("date")
    steps = seen.withColumn("_prev", F.lag("date").over(order)).withColumn("_step", F.datediff("date", "_prev"))
    middle = steps.groupBy(*keys).agg(F.floor(F.median("_step")).cast("int").alias("_m"))
    step = F.coalesce("_m", F.lit(0))
    limited = attach(steps, middle, keys).withColumn("_limit", F.greatest(F.lit(1), F.floor(step * 1.5).cast("int")))
    summary = limited.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_unique_dates"), F.min("date").alias("min_date"), F.max("date").alias("max_date"),
        F.datediff(F.max("date"), F.min("date")).alias("span_days"), F.max(step).alias("median_step_days"),
        F.count_if(F.col("_step") > F.col("_limit")).alias("n_gaps_gt_1_5x_step"),
    )
    summary = attach(outside, summary, keys, "left").withColumns({"n_unique_dates": F.coalesce("n_unique_dates", F.lit(0)), "monotonic": F.lit(True)})
    gaps = limited.where(F.col("_step") > F.col("_limit")).select(
        *keys, F.col("_prev").alias("from_date"), F.col("date").alias("to_date"), F.col("_step").alias("gap_days")
    )
    return summary, gaps


# ---- duplicates and equality -------------------------------------------------

def composite_keys(df: DataFrame) -> list[str]:
    """Guess of the key columns: text columns with few values, plus year, month, quarter.

    Sketches decide the clear cases in one pass; only columns near the limit are
    counted exactly. The answer is a list of names.
    """
    numeric = {c for c, t in df.dtypes if t in ("int", "bigint", "double", "float", "smallint", "tinyint") or t.startswith("decimal")}
    cols = names.data_columns(df.columns)
    text = [c for c in cols if c not in numeric]
    row = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.approx_count_distinct(F.col(f"`{c}`")).alias(c) for c in text]).first()
    most = max(50, row["_rows"] // 10)
    counted = {c: row[c] for c in text}
    near = [c for c in text if counted[c] <= 3 or 0.7 * most <= counted[c] <= 1.3 * most]
    if near:
        cells = text_cells(df, near).where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        counted.update({c: 0 for c in near})
        counted.update({r["column"]: r["k"] for r in cells.groupBy("column").agg(F.count(F.lit(1)).alias("k")).collect()})
    picked = [
        c for c in cols
        if (c in numeric and c.lower() in ("year", "month", "quarter")) or (c not in numeric and 1 < counted.get(c, 0) <= most)
    ]
    return picked


def digest_blocks(hashed: DataFrame, sets: list[tuple[int, ...]], blocks: int, led: list[int] | None = None) -> DataFrame:
    """(set, block, digests): 64-bit digests of the rows' values in each set of columns, as sorted runs of one block each.

    ``hashed`` has a digest per column, ``sets`` name them by place. Rows do not travel one by one: a task sorts the digests
    it holds, cuts them at block borders, which are those of all tasks, and gives each piece out as one value. A digest found
    often goes out twice, which tells as much. ``led``: a column per set, whose digest is a multiple of 64 in the rows to look at.
    """
    turn, most = TURN, max(DIGESTS_HELD // max(len(sets), 1), 1)

    def cut(i: int, held: list[np.ndarray]) -> pa.RecordBatch:
        d = np.sort(np.concatenate(held))
        keep = np.ones(len(d), bool)
        keep[2:] = d[2:] != d[:-2]
        d = d[keep]
        block = ((d >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
        starts = np.r_[0, np.flatnonzero(block[1:] != block[:-1]) + 1]
        pieces = [d[x:y].tobytes() for x, y in zip(starts, [*starts[1:], len(d)])]
        return pa.record_batch([pa.array(np.full(len(starts), i, np.int32)), pa.array(block[starts].astype(np.int32)), pa.array(pieces, pa.binary())], names=["set", "block", "digests"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sizes = [[] for _ in sets], [0] * len(sets)
        for batch in batches:
            h = [c.to_numpy().view(np.uint64) for c in batch.columns]
            for i, s in enumerate(sets):
                d = h[s[0]]
                for k, c in enumerate(s[1:], 1):
                    d = d ^ (h[c] << np.uint64(turn * k % 64) | h[c] >> np.uint64(-turn * k % 64))
                if led is not None:
                    d = d[h[led[i]] & np.uint64(63) == 0]
                if len(d):
                    held[i].append(d)
                    sizes[i] += len(d)
                if sizes[i] >= most:
                    yield cut(i, held[i])
                    held[i], sizes[i] = [], 0
        yield from (cut(i, held[i]) for i in range(len(sets)) if held[i])

    return hashed.mapInArrow(pieces, "set int, block int, digests binary")


def repeated_digests(pieces: DataFrame, tasks: int) -> DataFrame:
    """(set, n_distinct, again) of ``digest_blocks``: a row per block with its number of different digests, then one per digest found again."""

    def compare(table: pa.Table) -> pa.Table:
        d = np.sort(np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for chunk in table["digests"].chunks for x in chunk]))
        new = d[1:] != d[:-1]
        again = np.unique(d[1:][~new]).view(np.int64)
        none = pa.nulls(1, pa.int64())
        return pa.table({
            "set": pa.array(np.full(len(again) + 1, table["set"][0].as_py(), np.int32)),
            "n_distinct": pa.array(np.r_[int(new.sum()) + 1, np.zeros(len(again), np.int64)].astype(np.int64)),
            "again": pa.concat_arrays([none, pa.array(again)])})

    return pieces.repartition(tasks, "set", "block").groupBy("set", "block").applyInArrow(compare, "set int, n_distinct bigint, again bigint")


def minimal_keys(df: DataFrame, cols: list[str] | None = None, most_columns: int = 3, at_once: int = 64) -> DataFrame:
    """(key_columns, n_columns): the smallest sets of columns, up to ``most_columns`` wide, whose values tell all rows apart.

    Level by level: a set is looked at only if none of its subsets is a key, none of its columns is constant and the product
    of the columns' distinct counts reaches the number of rows. Sets of a level are tested together, ``at_once`` in a job.
    First the rows with a 64th of the values of a set's most varied column are looked at, where equal rows settle that it is no
    key, then all rows for the sets that are left. Rows travel as one 64-bit digest per set, in sorted blocks: no digest twice
    means no row twice. One that comes twice is looked up, and only rows with equal digests of 128 bits a value count as equal.
    NULL equals NULL. Only names, counts per column and one digest per set come to the driver.
    """
    cols = names.data_columns(df.columns) if cols is None else list(cols)
    slim = df.select(*[F.col(f"`{c}`") for c in cols])
    n = slim.count()
    found: list[tuple[str, ...]] = []
    blocks = n // DIGESTS_OF_A_BLOCK + 1

    def parts(s: tuple[str, ...]) -> list[Column]:
        # a digest passes over NULL, so each value says whether it is one
        return [x for c in s for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]

    def digest(s: tuple[str, ...]) -> Column:
        """As ``digest_blocks`` makes it."""
        turned = [(F.xxhash64(*parts((c,))), TURN * k % 64) for k, c in enumerate(s)]
        return reduce(Column.bitwiseXOR, [F.shiftleft(h, k).bitwiseOR(F.shiftrightunsigned(h, 64 - k)) if k else h for h, k in turned])

    def rows_with(wanted: dict[tuple[str, ...], int]) -> Column:
        return F.explode(F.array_compact(F.array(*[
            F.when(digest(s) == d, F.struct(F.lit(i).alias("set"), F.xxhash64(*parts(s)).alias("p"), F.xxhash64(F.lit("second"), *parts(s[::-1])).alias("q")))
            for i, (s, d) in enumerate(wanted.items())])))

    def compared(rows: DataFrame, used: list[str], sets: list[tuple[str, ...]], led: list[str] | None = None) -> DataFrame:
        hashed = rows.select(*[F.xxhash64(*parts((c,))).alias(c) for c in used])
        places = [tuple(used.index(c) for c in s) for s in sets]
        pieces = digest_blocks(hashed, places, blocks, led and [used.index(c) for c in led])
        return repeated_digests(pieces, min(len(sets) * blocks, MOST_TASKS))

    def with_repeats(sets: list[tuple[str, ...]], some: bool) -> set[tuple[str, ...]]:
        led = [max(s, key=distinct.get) for s in sets]
        rows = slim.where(reduce(or_, [F.xxhash64(*parts((c,))).bitwiseAND(F.lit(63)) == 0 for c in dict.fromkeys(led)])) if some else slim
        with unweighed(df.sparkSession):
            again = land(compared(rows, [c for c in cols if any(c in s for s in sets)], sets, led if some else None).where("again IS NOT NULL"))
        same: set[tuple[str, ...]] = set()
        while least := {sets[r["set"]]: r["again"] for r in again.groupBy("set").agg(F.min("again").alias("again")).collect()}:
            wanted = [*least]
            equal = rows.where(reduce(or_, [digest(s) == d for s, d in least.items()])).select(rows_with(least).alias("row"))
            equal = equal.groupBy("row.set", "row.p", "row.q").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("set").distinct()
            same |= {wanted[r["set"]] for r in equal.collect()}
            # rarely: a digest of rows that differ
            left = [(F.col("set") == sets.index(s)) & (F.col("again") > d) for s, d in least.items() if s not in same]
            again = again.where(reduce(or_, left, F.lit(False)))
        return same

    distinct: dict[str, int] = {}
    if n:
        with unweighed(df.sparkSession):
            each = compared(slim, cols, [(c,) for c in cols]).groupBy("set").agg(F.sum("n_distinct").alias("d")).collect()
        distinct = {cols[r["set"]]: r["d"] for r in each}
    # as digests may meet, a count may be a little too small
    reach = {c: d + d // 1_000_000 for c, d in distinct.items()}
    found += [(c,) for c in cols if n and distinct[c] == n]
    near = [(c,) for c in cols if n and distinct[c] < n <= reach[c]]
    repeated = with_repeats(near, False) if near else set()
    found += [s for s in near if s not in repeated]
    useful = [c for c in cols if n and distinct[c] > 1 and (c,) not in found]
    for width in range(2, most_columns + 1):
        sets = [
            s for s in combinations(useful, width)
            if math.prod(reach[c] for c in s) >= n and not any(set(k) <= set(s) for k in found)
        ]
        for at in range(0, len(sets), at_once):
            block = sets[at: at + at_once]
            for some in (True, False):
                repeated = with_repeats(block, some) if block else set()
                block = [s for s in block if s not in repeated]
            found += block
    return df.sparkSession.createDataFrame([(",".join(k), len(k)) for k in found], "key_columns string, n_columns int")


def duplicate_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    """n_rows, exact duplicates and key collisions (all members counted) with percentages.

    The key groups are built from the exact groups, so the rows shuffle once in full
    and then only as (keys, count).
    """
    cols = names.data_columns(df.columns)
    exact = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    if keys:
        by_key = exact.groupBy(*keys).agg(
            F.sum("_n").alias("_k"), F.sum(F.when(F.col("_n") > 1, F.col("_n")).otherwise(0)).alias("_e")
        )
    else:
        by_key = exact.select(F.lit(0).alias("_k"), F.col("_n"), F.when(F.col("_n") > 1, F.col("_n")).otherwise(0).alias("_e"))
    rows = F.sum("_k") if keys else F.sum("_n")
    one = by_key.agg(
        F.coalesce(rows, F.lit(0)).alias("n_rows"), F.coalesce(F.sum("_e"), F.lit(0)).alias("n_exact_duplicates"),
        F.coalesce(F.sum(F.when(F.col("_k") > 1, F.col("_k"))), F.lit(0)).alias("n_key_collisions"),
    )
    pct = lambda c: F.round(100.0 * F.col(c) / F.greatest(F.col("n_rows"), F.lit(1)), 2)
    return one.select(
        "n_rows", "n_exact_duplicates", pct("n_exact_duplicates").alias("exact_dup_pct"),
        F.lit(",".join(keys)).alias("composite_keys"), "n_key_collisions", pct("n_key_collisions").alias("key_collision_pct"),
    )


def duplicate_samples(df: DataFrame, keys: list[str], limit: int | None = None) -> DataFrame:
    """Key values of colliding groups with the group size; the ``limit`` largest for a report, else all."""
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_size")).where(F.col("group_size") > 1)
    return groups if limit is None else groups.orderBy(F.col("group_size").desc(), *keys).limit(limit)


def table_equality(left: DataFrame, right: DataFrame, prefix: str = "sum_of_") -> DataFrame:
    """Verdict on two copies of a table: row counts, column differences, rows on one side only.

    Columns of ``left`` may carry ``prefix``; housekeeping columns are left out.
    """
    from statloom.operators.relational import only_data, set_difference_counts

    l, r = only_data(left), only_data(right)
    l = l.withColumnsRenamed({c: c[len(prefix):] for c in l.columns if c.startswith(prefix)})
    common = sorted(set(l.columns) & set(r.columns))
    c = set_difference_counts(l, r, common)
    only_l, only_r = F.col("only_left"), F.col("only_right")
    verdict = (
        F.when((only_l == 0) & (only_r == 0), "identical_after_sort_dedup")
        .when((only_l > 0) & (only_r == 0), "near_identical_pivot_extra")
        .when((only_r > 0) & (only_l == 0), "near_identical_country_extra")
        .otherwise("non_equal")
    )
    return c.select(
        F.col("left_rows").alias("pivot_rows"), F.col("right_rows").alias("country_rows"),
        (F.col("left_rows") - F.col("right_rows")).alias("row_delta"), F.lit(len(common)).alias("n_common_cols"),
        F.lit(",".join(sorted(set(l.columns) - set(r.columns)))).alias("cols_only_in_pivot"),
        F.lit(",".join(sorted(set(r.columns) - set(l.columns)))).alias("cols_only_in_country"),
        only_l.alias("rows_only_in_pivot"), only_r.alias("rows_only_in_country"),
        F.col("left_distinct").alias("pivot_unique_after_dedup"), F.col("right_distinct").alias("country_unique_after_dedup"),
        verdict.alias("verdict"),
    )


# ---- units -------------------------------------------------------------------

def unit_register(df: DataFrame, cols: list[str], longest: bool = True) -> DataFrame:
    """Columns whose name promises a unit and whose values leave its plausible range."""
    hinted = {c: names.unit_hint(c, longest) for c in cols}
    hinted = {c: h for c, h in hinted.items() if h}
    if not hinted:
        return df.sparkSession.createDataFrame(
            [], "column string, unit_hint string, expected_range_label string, expected_min double, expected_max double, "
            "n_below_min bigint, n_above_max bigint, actual_min double, actual_max double, n_total bigint")
    def value(c: str) -> Column:
        return F.col(f"`{c}`").cast("double")

    one = df.agg(*[
        F.struct(
            F.lit(c).alias("column"), F.lit(h).alias("unit_hint"), F.lit(names.UNIT_RANGES[h][2]).alias("expected_range_label"),
            F.lit(names.UNIT_RANGES[h][0]).alias("expected_min"), F.lit(names.UNIT_RANGES[h][1]).alias("expected_max"),
            F.count_if(value(c) < names.UNIT_RANGES[h][0]).alias("n_below_min"),
            F.count_if(value(c) > names.UNIT_RANGES[h][1]).alias("n_above_max"),
            F.min(value(c)).alias("actual_min"), F.max(value(c)).alias("actual_max"), F.count(value(c)).alias("n_total"),
        ).alias(f"_{i}") for i, (c, h) in enumerate(hinted.items())
    ])
    rows = one.select(F.inline(F.array(*[F.col(f"_{i}") for i in range(len(hinted))])))
    return rows.where(F.col("n_below_min") + F.col("n_above_max") > 0)


def magnitude_alignment(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, min, p50, p99, max): the same logical metric across sources."""
    small = is_small(cells)
    v = F.col("value")
    basics = cells.where(v.isNotNull()).groupBy(*keys).agg(F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"))
    q = quantiles(cells, keys, "value", {"p50": 0.5, "p99": 0.99}, small=small)
    return attach(basics, q, keys)


# ---- scorecard and health ----------------------------------------------------

def feature_scorecard(df: DataFrame, roles: Roles, collinear: DataFrame) -> DataFrame:
    """drop / dangerous / weak / high per feature from nulls, cardinality, variance and redundancy."""
    cols = [*roles.numeric, *roles.categorical]
    base = schema_report(df.select(*[F.col(f"`{c}`") for c in cols])).select("column", "null_pct", "n_unique")
    spread = numeric_cells(df, roles.numeric).where(F.col("value").isNotNull()).groupBy("column").agg(
        F.count(F.lit(1)).alias("_n"), F.stddev_pop("value").alias("_sd"), F.avg("value").alias("_mean")
    )
    low = F.when(F.col("_sd") == 0, True).when(F.col("_mean") == 0, False).otherwise(
        (F.col("_sd") != 0) & (F.col("_sd") / F.abs("_mean") < 0.005)
    )
    # A raw shadow equal to its column tells nothing new.
    shadows = [c for c in roles.numeric if f"raw__{c}" in df.columns]
    leaks = (
        df.agg(*[F.min(F.coalesce(F.col(c).cast("string"), F.lit("")) == F.coalesce(F.col(f"raw__{c}").cast("string"), F.lit(""))).alias(c) for c in shadows])
        .select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("leakage_proxy")) for c in shadows])))
        if shadows else df.sparkSession.createDataFrame([], "column string, leakage_proxy boolean")
    )
    redundant = collinear.select(F.col("col_a").alias("column")).union(collinear.select("col_b")).distinct().withColumn("redundant", F.lit(True))
    joined = base.join(spread, "column", "left").join(redundant, "column", "left").join(leaks, "column", "left")
    flags = joined.select(
        "column", F.when(F.col("column").isin(roles.numeric or [""]), "numeric").otherwise("categorical").alias("kind"),
        "null_pct", "n_unique", (F.col("n_unique") <= 1).alias("constant"),
        F.coalesce((F.col("_n") > 1) & low, F.lit(False)).alias("variance_low"),
        F.coalesce("redundant", F.lit(False)).alias("redundant"), F.coalesce("leakage_proxy", F.lit(False)).alias("leakage_proxy"),
    )
    category = (
        F.when((F.col("null_pct") >= 90) | F.col("constant"), "drop")
        .when(F.col("redundant") | F.col("leakage_proxy"), "dangerous")
        .when((F.col("null_pct") >= 50) | F.col("variance_low"), "weak")
        .otherwise("high")
    )
    return flags.withColumn("category", category)


def health(catalog: DataFrame, nulls: DataFrame, schema: DataFrame, duplicates: DataFrame, keys: list[str]) -> DataFrame:
    """RED / AMBER / GREEN per table."""
    mixed = schema.groupBy(*keys).agg(F.count_if("mixed_type_residue").alias("n_mixed_cols"))
    d = duplicates.select(*keys, "n_exact_duplicates")
    x = catalog.join(nulls.select(*keys, "null_pct"), keys, "left").join(mixed, keys, "left").join(d, keys, "left")
    null_pct = F.coalesce("null_pct", F.lit(0.0))
    n_mixed, n_dup = F.coalesce("n_mixed_cols", F.lit(0)), F.coalesce("n_exact_duplicates", F.lit(0))
    rag = (
        F.when(F.col("tier") == "T3", "n/a (metadata)")
        .when(null_pct >= 50, "RED")
        .when((null_pct >= 25) | (n_mixed > 0) | (n_dup > 0), "AMBER")
        .otherwise("GREEN")
    )
    return x.select(
        *keys, "tier", rag.alias("rag"), "n_rows", F.round(null_pct, 1).alias("null_pct"),
        n_mixed.alias("n_mixed_cols"), n_dup.alias("n_exact_duplicates"),
    )
