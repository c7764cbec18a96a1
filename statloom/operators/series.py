"""Operators on keyed time series: increments, growth, shifts, breaks, volatility."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from statloom.functions.dates import day_first_date
from statloom.functions.nulls import clip_low, safe_div
from statloom.functions.stats import cagr
from statloom.operators.ordered import LONG_SERIES, attach, is_small, running_totals, sliding
from statloom.operators.relational import last_per_year, mean_over, melt, std_over, to_matrix
from statloom.sources.landing import land


# ---- cumulative levels -------------------------------------------------------

def cumulative_long_to_annual(long: DataFrame, keys: list[str], date: str, value: str) -> DataFrame:
    """Year-end level and increment of a cumulative series.

    The first year counts from zero; falls (revisions) are clipped to zero last.
    """
    ends = last_per_year(long, keys, date, value)
    before = F.lag(value).over(W.partitionBy(*keys).orderBy("year"))
    step = F.when(before.isNull(), F.col(value)).otherwise(F.col(value) - before)
    return ends.withColumn(f"new_{value}", clip_low(step))


def cumulative_to_annual(df: DataFrame, series: list[str], date_col: str, value_name: str, key: str = "technology") -> DataFrame:
    """Wide cumulative table with text dates -> (key, year, level, increment)."""
    have = [c for c in series if c in df.columns]
    dated = df.withColumn("date", day_first_date(F.col(date_col))).dropna(subset=["date"])
    long = melt(dated, ["date"], have, key, value_name)
    return cumulative_long_to_annual(long, [key], "date", value_name)


# ---- growth ------------------------------------------------------------------

def end_to_end_growth(df: DataFrame, keys: list[str], year: str, value: str, out: str = "cagr") -> DataFrame:
    """CAGR between the first and last year that have a value."""
    rows = df.dropna(subset=[*keys, year, value])
    ends = rows.groupBy(*keys).agg(
        F.min(year).alias("year_start"), F.max(year).alias("year_end"),
        F.min_by(value, year).alias("value_start"), F.max_by(value, year).alias("value_end"),
    )
    span = (F.col("year_end") - F.col("year_start")).cast("double")
    return ends.withColumn(out, cagr(F.col("value_start"), F.col("value_end"), span))


def bootstrap_growth(df: DataFrame, keys: list[str], year: str, value: str, n_boot: int = 400, seed: int = 42) -> DataFrame:
    """(keys, cagr, cagr_low, cagr_high): 95 % interval from resampled annual growth ratios.

    Draw i of replicate b is the ratio at position md5(seed-b-i) mod m: no
    generator state, so any task can compute any replicate. The ratios of one
    series (at most one per year) travel as an array.
    """
    rows = df.dropna(subset=[*keys, year, value])
    prev = F.lag(value).over(W.partitionBy(*keys).orderBy(year))
    ratio = F.col(value) / F.greatest(prev, F.lit(1e-12))
    steps = rows.withColumn("_r", F.when(prev.isNotNull(), ratio))
    per = steps.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.when(F.col("_r").isNotNull(), F.struct(F.col(year), F.col("_r"))))).alias("_rs"),
        F.min(year).alias("_y0"), F.max(year).alias("_y1"),
        F.min_by(value, year).alias("_v0"), F.max_by(value, year).alias("_v1"),
    )
    span = (F.col("_y1") - F.col("_y0")).cast("double")
    logs = F.transform("_rs", lambda s: F.log(F.greatest(F.lit(1e-9), F.least(F.lit(1e9), s["_r"]))))
    boots = per.where(F.size("_rs") > 0).select(
        *keys, "_v0", "_v1", span.alias("_span"), logs.alias("_logs"), F.size("_rs").alias("_m"),
        F.explode(F.sequence(F.lit(1), F.lit(n_boot))).alias("_b"),
    )
    total = F.expr(
        f"aggregate(sequence(1, _m), 0D, (acc, i) -> acc + get(_logs, cast(conv(substring(md5(concat_ws('-', '{seed}', "
        f"cast(_b as string), cast(i as string))), 1, 8), 16, 10) as bigint) % _m))"
    )
    drawn = boots.withColumn("_grown", F.col("_v0") * F.exp(total))
    drawn = drawn.withColumn("_c", cagr(F.col("_v0"), F.col("_grown"), F.col("_span")))
    # n_boot rows per series: the percentile is over a fixed number of values.
    return drawn.groupBy(*keys).agg(
        F.max(cagr(F.col("_v0"), F.col("_v1"), F.col("_span"))).alias("cagr"),
        F.percentile("_c", F.array(F.lit(0.025), F.lit(0.975))).alias("_q"),
    ).select(*keys, "cagr", F.col("_q")[0].alias("cagr_low"), F.col("_q")[1].alias("cagr_high"))


# ---- mean shift --------------------------------------------------------------

def t_p_value():
    """Pandas UDF: two-sided p-value of Student's t from (t, degrees of freedom).

    Incomplete beta function by its continued fraction (modified Lentz), a whole
    batch at a time. The helpers are nested so that they travel with the UDF.
    """
    def fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
        tiny = 1e-300
        c = np.ones_like(x)
        d = 1.0 - (a + b) * x / (a + 1.0)
        d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        for m in range(1, 300):
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            for top in (even, odd):
                d = 1.0 + top * d
                d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1.0 + top / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                h = h * d * c
        return h

    def two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
        x = df / (df + t * t)
        a, b = df / 2.0, np.full_like(df, 0.5)
        log_front = np.array([math.lgamma(p + q) - math.lgamma(p) - math.lgamma(q) for p, q in zip(a, b)])
        with np.errstate(divide="ignore", invalid="ignore"):
            front = np.exp(log_front + a * np.log(x) + b * np.log1p(-x))
            direct = x < (a + 1.0) / (a + b + 2.0)
            p = np.where(direct, front * fraction(a, b, x) / a, 1.0 - front * fraction(b, a, 1.0 - x) / b)
        return np.where(t == 0, 1.0, np.clip(p, 0.0, 1.0))

    def p_values(t: pd.Series, df: pd.Series) -> pd.Series:
        ok = t.notna() & df.notna()
        out = pd.Series(np.nan, index=t.index)
        if ok.any():
            out[ok] = two_sided(t[ok].to_numpy(float), df[ok].to_numpy(float))
        return out.astype(object).where(ok, None)

    return F.pandas_udf(p_values, "double")


def mean_shift(df: DataFrame, keys: list[str], time: str, value: str, at: int | Column, with_p: bool = True) -> DataFrame:
    """Welch comparison of the means before and from ``at``, two values or more each side."""
    split = F.lit(at) if isinstance(at, int) else at
    before = F.when(F.col(time) < split, F.col(value))
    after = F.when(F.col(time) >= split, F.col(value))
    s = df.dropna(subset=[*keys, time, value]).groupBy(*keys).agg(
        F.avg(before).alias("mean_pre"), F.avg(after).alias("mean_post"),
        F.count(before).alias("n_pre"), F.count(after).alias("n_post"),
        F.var_samp(before).alias("_v0"), F.var_samp(after).alias("_v1"),
    ).where((F.col("n_pre") >= 2) & (F.col("n_post") >= 2))
    e0, e1 = F.col("_v0") / F.col("n_pre"), F.col("_v1") / F.col("n_post")
    t = F.when(e0 + e1 > 0, (F.col("mean_pre") - F.col("mean_post")) / F.sqrt(e0 + e1))
    dof = F.when(e0 + e1 > 0, (e0 + e1) * (e0 + e1) / (e0 * e0 / (F.col("n_pre") - 1) + e1 * e1 / (F.col("n_post") - 1)))
    out = s.select(*keys, "mean_pre", "mean_post", "n_pre", "n_post", t.alias("t_statistic"), dof.alias("welch_df"))
    return out.withColumn("p_value_welch", t_p_value()("t_statistic", "welch_df")) if with_p else out


# ---- change points -----------------------------------------------------------

def split_gains(df: DataFrame, keys: list[str], time: str, value: str, min_size: int = 2, small: bool | None = None) -> DataFrame:
    """Squared-error gain of cutting each series before each of its different times; rows of one time stay together."""
    points = df.groupBy(*keys, time).agg(F.count(F.lit(1)).alias("_one"), F.sum(value).alias("_sum"))
    return weighted_gains(points, keys, time, "_one", "_sum", min_size, small)


def weighted_gains(points: DataFrame, keys: list[str], time: str, size: str, total: str, min_size: int, small: bool | None = None) -> DataFrame:
    """``split_gains`` of points that stand for ``size`` rows with the sum ``total``; times of a key are different."""
    run = running_totals(points, keys, [time], {"_n": size, "_s": total}, small=small)
    n1, s1 = F.col("_n") - F.col(size), F.col("_s") - F.col(total)
    n2, s2 = F.col("_n_all") - n1, F.col("_s_all") - s1
    gap = s1 / F.when(n1 > 0, n1) - s2 / F.when(n2 > 0, n2)
    fits = (n1 >= min_size) & (n2 >= min_size)
    return run.where(fits).select(*keys, time, n1.alias("n_left"), n2.alias("n_right"), (gap * gap * n1 * n2 / (n1 + n2)).alias("gain"))


def best_split(df: DataFrame, keys: list[str], time: str, value: str, min_size: int = 2) -> DataFrame:
    """(keys, split_at, gain): the single cut with the largest gain, the earliest on a tie."""
    rows = df.dropna(subset=[*keys, time, value])
    gains = split_gains(rows, keys, time, value, min_size)
    earliest = -F.unix_date(time) if dict(df.dtypes)[time] == "date" else -F.col(time)
    pick = F.max_by(F.struct(time, "gain"), F.struct("gain", earliest))
    return gains.groupBy(*keys).agg(pick.alias("_b")).select(*keys, F.col(f"_b.{time}").alias("split_at"), F.col("_b.gain").alias("gain"))


def change_points(df: DataFrame, keys: list[str], time: str, value: str, penalty: float = 10.0, min_size: int = 2) -> DataFrame:
    """(keys, segment_start, position): repeated best splits while the gain pays the penalty.

    Values are scaled to unit variance per series, so one penalty fits all. All
    segments of all series are cut in the same round; a round is one job and there
    are as many rounds as nested cuts. Rows of one time are one point, so every cut
    parts its segment and the rounds end. ``position`` counts rows from 0.
    """
    rows = df.dropna(subset=[*keys, time, value]).select(*keys, F.col(time).cast("double").alias("_t"), F.col(value).cast("double").alias("_v"))
    scale = rows.groupBy(*keys).agg(F.stddev_samp("_v").alias("_sd"), F.count(F.lit(1)).alias("_len"), F.min("_t").alias("_seg"))
    start = attach(rows, scale, keys).where((F.col("_len") >= 3 * min_size) & (F.col("_sd") > 0))
    points = start.groupBy(*keys, "_t").agg(F.count(F.lit(1)).alias("_k"), F.sum(F.col("_v") / F.col("_sd")).alias("_v"), F.first("_seg").alias("_seg"))
    state = land(points.select(*keys, "_t", "_k", "_v", "_seg"))
    small = is_small(state)
    segment = [*keys, "_seg"]
    while True:
        gains = weighted_gains(state, segment, "_t", "_k", "_v", min_size, small)
        best = gains.groupBy(*segment).agg(F.max_by("_t", F.struct("gain", -F.col("_t"))).alias("_cut"), F.max("gain").alias("_g"))
        cuts = best.where(F.col("_g") > penalty).drop("_g")
        moved = attach(state, cuts, segment, "left")
        fresh = F.when(F.col("_t") >= F.col("_cut"), F.col("_cut")).otherwise(F.col("_seg"))
        after = land(moved.select(*keys, "_t", "_k", "_v", fresh.alias("_seg"), F.col("_cut").isNotNull().alias("_moved")))
        changed = after.where("_moved").limit(1).count() > 0
        state = after.drop("_moved")
        if not changed:
            break
    sizes = state.groupBy(*segment).agg(F.sum("_k").alias("_m"))
    upto = W.partitionBy(*keys).orderBy("_seg").rowsBetween(W.unboundedPreceding, -1)
    placed = sizes.withColumn("position", F.sum("_m").over(upto))
    return placed.where(F.col("position").isNotNull()).select(*keys, F.col("_seg").alias("segment_start"), "position")


# ---- volatility --------------------------------------------------------------

def rolling_volatility(df: DataFrame, keys: list[str], time: str, value: str, window: int = 12, long_rows: int = LONG_SERIES) -> DataFrame:
    """Rolling mean, std and cv over ``window`` rows, from half a window on, for series of any length."""
    least = max(2, window // 2)
    out = sliding(df.dropna(subset=[time, value]), keys, time, window - 1, lambda w: {
        "rolling_mean": mean_over(w, value, window, least), "rolling_std": std_over(w, value, window, least)}, long_rows)
    return out.withColumn("rolling_cv", safe_div(F.col("rolling_std"), F.col("rolling_mean")))


def latest_volatility(df: DataFrame, time: str, value: str, window: int = 12) -> DataFrame:
    """(cv) of the last ``window`` rows of one series: each partition sends on as many rows at most."""
    last = df.dropna(subset=[time, value]).select(time, value).orderBy(F.col(time).desc()).limit(window)
    found = last.agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.stddev_samp(value).alias("sd"))
    return found.select(F.when(F.col("n") >= max(2, window // 2), safe_div(F.col("sd"), F.col("m"))).alias("cv"))


def volatility_matrix(annual: DataFrame, labels: list[str], metric: str = "cv") -> DataFrame:
    """year x series matrix of one annual measure."""
    return to_matrix(annual.dropna(subset=["year"]), "year", "series", metric, labels)
