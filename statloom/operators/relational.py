"""Projections, filters, joins, aggregates and reshapes used by the plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, WindowSpec, functions as F

from statloom.functions.names import data_columns
from statloom.functions.numbers import strict_number
from statloom.operators.ordered import LONG_SERIES, attach, is_small, quantiles, sliding


# ---- projections and filters -------------------------------------------------

def pick(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Select the wanted columns that exist, in the wanted order."""
    return df.select(*[c for c in wanted if c in df.columns])


def only_data(df: DataFrame) -> DataFrame:
    """Drop raw shadows, flags and ISO helper columns."""
    return df.select(*data_columns(df.columns))


def to_numbers(df: DataFrame, cols: list[str]) -> DataFrame:
    """Read the named columns as numbers; text that is none becomes NULL."""
    return df.withColumns({c: strict_number(F.col(c)) for c in cols if c in df.columns})


def matches(c: Column, pattern: str) -> Column:
    """Case-insensitive regex match; NULL is no match."""
    return F.coalesce(c.rlike("(?i)" + pattern), F.lit(False))


def any_keyword(c: Column, words: tuple[str, ...]) -> Column:
    return matches(c, "|".join(words))


def country_rows(
    df: DataFrame,
    names: tuple[str, ...] = ("gbr", "uk", "united kingdom"),
    candidates: tuple[str, ...] = ("iso3_code", "iso_code", "country"),
) -> DataFrame:
    """Rows of one country by the first candidate column that holds any such row.

    One aggregate, used as scalar subqueries, decides the column; no rows are collected.
    """
    present = [c for c in candidates if c in df.columns]
    if not present:
        return df.limit(0)

    def hit(c: str) -> Column:
        return F.coalesce(F.lower(F.trim(F.col(c).cast("string"))).isin(*names), F.lit(False))

    found = [df.agg(F.max(hit(c)).alias("hit")).scalar() for c in present]
    keep, taken = F.lit(False), F.lit(False)
    for c, any_hit in zip(present, found):
        keep = keep | (~taken & F.coalesce(any_hit, F.lit(False)) & hit(c))
        taken = taken | F.coalesce(any_hit, F.lit(False))
    return df.where(keep)


def first_by_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key, the first in ``order`` (a map-side combinable pick)."""
    rest = [c for c in df.columns if c != key]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(key).agg(best).select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])


# ---- joins -------------------------------------------------------------------

def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join in which NULL keys match each other; keys come out once."""
    r = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    on = [left[k].eqNullSafe(r[f"_r_{k}"]) for k in keys]
    joined = left.join(r, on, how)
    both = [F.coalesce(F.col(k), F.col(f"_r_{k}")).alias(k) for k in keys]
    rest = [c for c in joined.columns if c not in keys and not c.startswith("_r_")]
    return joined.select(*both, *rest)


def map_values(c: Column, table: dict[str, str]) -> Column:
    """Dictionary lookup as an expression; values without an entry stay."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), c)


# ---- aggregates --------------------------------------------------------------

def grouped_sums(df: DataFrame, keys: list[str], cols: list[str], keep_null_keys: bool = False) -> DataFrame:
    """Sums per group, 0 for an all-null group; rows with a NULL key are left out."""
    rows = df if keep_null_keys else df.dropna(subset=keys)
    return rows.groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in cols])


def group_summary(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """mean, std, min, max, n_obs and exact quantiles per group."""
    rows = df.dropna(subset=keys)
    v = F.col(value)
    basics = [
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"),
        F.max(v).alias("max"), F.count(v).alias("n_obs"),
    ]
    if is_small(rows):
        points = F.percentile(value, F.array(*[F.lit(p) for p in probs.values()])).alias("_q")
        one = rows.groupBy(*keys).agg(*basics, points)
        return one.withColumns({n: F.col("_q")[i] for i, n in enumerate(probs)}).drop("_q")
    return attach(rows.groupBy(*keys).agg(*basics), quantiles(rows, keys, value, probs, small=False), keys, "left")


def group_median(df: DataFrame, keys: list[str], value: str, out: str = "median") -> DataFrame:
    return quantiles(df.dropna(subset=keys), keys, value, {out: 0.5})


def weighted_mean(df: DataFrame, keys: list[str], value: str, weight: str, out: str) -> DataFrame:
    """sum(x*w)/sum(w) over rows where both exist; groups without weight drop out."""
    rows = df.dropna(subset=[*keys, value, weight])
    sums = rows.groupBy(*keys).agg(
        F.sum(F.col(value) * F.col(weight)).alias("_xw"), F.sum(weight).alias("_w")
    )
    return sums.where(F.col("_w") > 0).select(*keys, (F.col("_xw") / F.col("_w")).alias(out))


def last_per_year(df: DataFrame, keys: list[str], date: str, value: str) -> DataFrame:
    """Last non-null value in date order per (keys, year)."""
    rows = df.dropna(subset=[date, value]).withColumn("year", F.year(date))
    return rows.groupBy(*keys, "year").agg(F.max_by(value, date).alias(value))


def latest_rows(df: DataFrame, by: str) -> DataFrame:
    """Rows of the greatest ``by`` value (a scalar subquery, so one small aggregate)."""
    return df.where(F.col(by) == df.agg(F.max(by).alias("latest")).scalar())


# ---- windows on series -------------------------------------------------------

def difference_over(w: WindowSpec, value: str, k: int = 1) -> Column:
    """Value minus the value k rows before (rows, not years)."""
    return F.col(value) - F.lag(value, k).over(w)


def mean_over(w: WindowSpec, value: str, rows: int, min_rows: int = 1) -> Column:
    frame = w.rowsBetween(-(rows - 1), 0)
    return F.when(F.count(value).over(frame) >= min_rows, F.avg(value).over(frame))


def std_over(w: WindowSpec, value: str, rows: int, min_rows: int) -> Column:
    frame = w.rowsBetween(-(rows - 1), 0)
    return F.when(F.count(value).over(frame) >= min_rows, F.stddev_samp(value).over(frame))


def row_difference(value: str, keys: list[str], order: str, k: int = 1) -> Column:
    """As ``with_difference``, for series that are short by nature (one row a year): one group per key."""
    return difference_over(W.partitionBy(*keys).orderBy(order), value, k)


def rolling_mean(value: str, keys: list[str], order: str, rows: int = 3, min_rows: int = 1) -> Column:
    """As ``with_rolling_mean``, for series that are short by nature (one row a year): one group per key."""
    return mean_over(W.partitionBy(*keys).orderBy(order), value, rows, min_rows)


def with_difference(df: DataFrame, keys: list[str], order: str, value: str, out: str, k: int = 1, long_rows: int = LONG_SERIES) -> DataFrame:
    """Add the change since k rows before, for series of any length."""
    return sliding(df, keys, order, k, lambda w: {out: difference_over(w, value, k)}, long_rows)


def with_rolling_mean(df: DataFrame, keys: list[str], order: str, value: str, out: str, rows: int = 3, min_rows: int = 1, long_rows: int = LONG_SERIES) -> DataFrame:
    return sliding(df, keys, order, rows - 1, lambda w: {out: mean_over(w, value, rows, min_rows)}, long_rows)


def with_gaps(df: DataFrame, keys: list[str], date: str, out: str, long_rows: int = LONG_SERIES) -> DataFrame:
    """Add the days since the date before it in the series."""
    return sliding(df, keys, date, 1, lambda w: {out: F.datediff(F.col(date), F.lag(date).over(w))}, long_rows)


# ---- reshapes, top-k, sets ---------------------------------------------------

def melt(df: DataFrame, ids: list[str], values: list[str], name: str, value: str) -> DataFrame:
    """Wide to long as numbers; NULL cells stay rows."""
    typed = df.select(*ids, *[strict_number(F.col(c)).alias(c) for c in values])
    return typed.unpivot(ids, values, name, value)


def numbered_columns_to_years(df: DataFrame, ids: list[str], stem: str, first_year: int, n: int) -> DataFrame:
    """stem, stem_2, … stem_n hold consecutive years: one row per id and year."""
    years = {stem if i == 1 else f"{stem}_{i}": first_year + i - 1 for i in range(1, n + 1)}
    have = [c for c in years if c in df.columns]
    long = melt(df, ids, have, "_col", "value")
    number = F.regexp_extract("_col", r"_([0-9]+)$", 1).try_cast("int")
    return long.withColumn("year", F.lit(first_year) + F.coalesce(number, F.lit(1)) - 1).drop("_col")


def to_matrix(df: DataFrame, row: str, col: str, value: str, labels: list) -> DataFrame:
    """Long to wide with the mean per cell; the label list is part of the plan."""
    return df.groupBy(row).pivot(col, labels).agg(F.avg(value))


def top_k(df: DataFrame, by: str, k: int, tie: list[str]) -> DataFrame:
    """The k rows with the greatest ``by``; ``tie`` makes the choice definite."""
    return df.orderBy(F.col(by).desc_nulls_last(), *[F.col(t).asc() for t in tie]).limit(k)


def nth_from_last(df: DataFrame, keys: list[str], order: str, value: str, ns: list[int]) -> DataFrame:
    """Value 1st, 3rd, 5th … from the end of each series, one column each.

    Each partition sends on its last rows only, as many as are asked for: the rank limit with keys, the sorted limit without.
    """
    if not keys:
        last = df.select(order, value).orderBy(F.col(order).desc()).limit(max(ns))
        top = last.agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))), asc=False).alias("_top"))
        return top.select(*[F.get("_top", F.lit(n - 1))["v"].alias(f"{value}_last_{n}") for n in ns])
    w = W.partitionBy(*keys).orderBy(F.col(order).desc())
    ranked = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= max(ns))
    out = [F.max(F.when(F.col("_rn") == n, F.col(value))).alias(f"{value}_last_{n}") for n in ns]
    return ranked.groupBy(*keys).agg(*out)


def set_difference_counts(left: DataFrame, right: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct-row comparison of two tables in one shuffle.

    Both sides are cast to text, tagged and grouped by the whole row, so each
    distinct row is seen once with the sides it occurs on.
    """
    def tagged(df: DataFrame, a: int, b: int) -> DataFrame:
        cells = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in cols]
        return df.select(*cells, F.lit(a).alias("_l"), F.lit(b).alias("_r"))

    rows = tagged(left, 1, 0).unionByName(tagged(right, 0, 1)).groupBy(*cols).agg(
        F.sum("_l").alias("_l"), F.sum("_r").alias("_r")
    )
    return rows.agg(
        F.coalesce(F.sum("_l"), F.lit(0)).alias("left_rows"),
        F.coalesce(F.sum("_r"), F.lit(0)).alias("right_rows"),
        F.count_if(F.col("_l") > 0).alias("left_distinct"),
        F.count_if(F.col("_r") > 0).alias("right_distinct"),
        F.count_if((F.col("_l") > 0) & (F.col("_r") == 0)).alias("only_left"),
        F.count_if((F.col("_l") == 0) & (F.col("_r") > 0)).alias("only_right"),
    )


def shared_keys(left: DataFrame, right: DataFrame, key_left: str, key_right: str, out: str) -> DataFrame:
    """Distinct keys present on both sides."""
    a = left.select(F.col(key_left).alias(out)).where(F.col(out).isNotNull())
    b = right.select(F.col(key_right).alias(out)).where(F.col(out).isNotNull())
    return a.intersect(b)
