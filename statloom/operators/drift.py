"""Drift between two vintages of a measure, for any number of scopes in one job.

The working frame is (keys, value, n_e, n_a): how often each value occurs in the
expected and in the actual vintage. PSI, Jensen-Shannon, Kolmogorov-Smirnov and
the medians all come from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from statloom.functions.stats import kolmogorov_p
from statloom.operators.ordered import attach, is_small, quantiles, running_totals
from statloom.operators.profile import bin_index
from statloom.sources.landing import land

MIN_ROWS = 30
PSI_BINS, JS_BINS = 10, 50
SHARE_FLOOR = 1e-6
HIGH_PSI, HIGH_MEDIAN_PCT, HIGH_KS = 0.25, 30.0, 0.2


def vintage_counts(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, value, n_e, n_a) from two (keys, value) frames; map-side combined."""
    e = expected.select(*keys, "value", F.lit(1).alias("_e"), F.lit(0).alias("_a"))
    a = actual.select(*keys, "value", F.lit(0).alias("_e"), F.lit(1).alias("_a"))
    both = e.unionByName(a).where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    return both.groupBy(*keys, "value").agg(F.sum("_e").alias("n_e"), F.sum("_a").alias("n_a"))


def _binned(counts: DataFrame, bounds: DataFrame, keys: list[str]) -> DataFrame:
    x = attach(counts, bounds, keys)
    v, lo, hi = F.col("value"), F.col("lo"), F.col("hi")
    return x.groupBy(
        *keys, "total_e", "total_a",
        bin_index(v, lo, hi, F.lit(PSI_BINS)).alias("_b10"), bin_index(v, lo, hi, F.lit(JS_BINS)).alias("_b50"),
    ).agg(F.sum("n_e").alias("n_e"), F.sum("n_a").alias("n_a"))


def _psi(bins: DataFrame, keys: list[str]) -> DataFrame:
    per = bins.groupBy(*keys, "total_e", "total_a", "_b10").agg(F.sum("n_e").alias("n_e"), F.sum("n_a").alias("n_a"))
    e = F.greatest(F.col("n_e") / F.col("total_e"), F.lit(SHARE_FLOOR))
    a = F.greatest(F.col("n_a") / F.col("total_a"), F.lit(SHARE_FLOOR))
    return per.groupBy(*keys).agg(F.sum((a - e) * F.log(a / e)).alias("psi"))


def _js(bins: DataFrame, keys: list[str]) -> DataFrame:
    per = bins.groupBy(*keys, "total_e", "total_a", "_b50").agg(F.sum("n_e").alias("n_e"), F.sum("n_a").alias("n_a"))
    p, q = F.col("n_e") / F.col("total_e"), F.col("n_a") / F.col("total_a")
    m = (p + q) / 2.0

    def part(x: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    half = per.groupBy(*keys).agg((F.sum(part(p)) / 2.0 + F.sum(part(q)) / 2.0).alias("_js"))
    return half.select(*keys, F.sqrt(F.greatest("_js", F.lit(0.0))).alias("jensen_shannon"))


def _ks(counts: DataFrame, keys: list[str], small: bool) -> DataFrame:
    run = running_totals(counts, keys, ["value"], {"_ce": "n_e", "_ca": "n_a"}, small=small)
    gap = F.abs(F.col("_ce") / F.col("_ce_all") - F.col("_ca") / F.col("_ca_all"))
    return run.groupBy(*keys).agg(F.max(gap).alias("ks_stat"))


def drift_measures(
    expected: DataFrame, actual: DataFrame, keys: list[str], labels: tuple[str, str] = ("expected", "actual"), small: bool | None = None
) -> DataFrame:
    """One row per key with at least 30 values on each side."""
    # Six measures read the counts; written once, their size is known exactly.
    counts = land(vintage_counts(expected, actual, keys))
    small = is_small(counts) if small is None else small
    bounds = counts.groupBy(*keys).agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("n_e").alias("total_e"), F.sum("n_a").alias("total_a")
    ).where((F.col("total_e") >= MIN_ROWS) & (F.col("total_a") >= MIN_ROWS))
    usable = attach(counts, bounds.select(*keys), keys)
    bins = _binned(usable, bounds, keys)
    medians = attach(
        quantiles(usable, keys, "value", {"_me": 0.5}, weight="n_e", small=small),
        quantiles(usable, keys, "value", {"_ma": 0.5}, weight="n_a", small=small), keys,
    )
    x = bounds
    for part in (_psi(bins, keys), _js(bins, keys), _ks(usable, keys, small), medians):
        x = attach(x, part, keys)
    flat = F.col("lo") == F.col("hi")
    psi = F.when(flat, 0.0).otherwise(F.col("psi"))
    js = F.when(flat, 0.0).otherwise(F.col("jensen_shannon"))
    pct = F.round(100.0 * (F.col("_ma") - F.col("_me")) / F.greatest(F.abs("_me"), F.lit(1e-9)), 2)
    # In a step of its own: inside the select, its lambda would see the rounded ks_stat.
    p = kolmogorov_p(F.col("ks_stat"), F.col("total_e").cast("double"), F.col("total_a").cast("double"))
    x = x.withColumn("_p", p)
    high_psi, high_median = psi > HIGH_PSI, F.abs(pct) > HIGH_MEDIAN_PCT
    e, a = labels
    return x.select(
        *keys, F.col("total_e").alias(f"n_{e}"), F.col("total_a").alias(f"n_{a}"),
        F.col("_me").alias(f"median_{e}"), F.col("_ma").alias(f"median_{a}"), pct.alias("median_pct_change"),
        F.round("ks_stat", 4).alias("ks_stat"), F.round("_p", 6).alias("ks_p_value"),
        F.round(js, 4).alias("jensen_shannon"), F.round(psi, 4).alias("psi"),
        high_psi.alias("high_drift_psi_gt_0_25"), high_median.alias("high_median_drift_gt_30pct"),
        (high_psi | high_median).alias("high_drift_any"),
    )


def long_vintage(df: DataFrame, data_type: str, unit: str) -> DataFrame:
    """Rows of one (data_type, unit) of a long vintage as (technology, year, value)."""
    hit = (F.col("data_type") == data_type) & (F.col("unit") == unit)
    return df.where(hit).select(F.col("product_name").alias("technology"), "year", F.col("value").cast("double").alias("value"))


def with_scopes(df: DataFrame, shared_technology: DataFrame, last_years: DataFrame) -> DataFrame:
    """Repeat each (technology, year, value) row for the scopes it belongs to."""
    base = df.join(shared_technology.withColumn("_t", F.lit(True)), "technology", "left").join(
        last_years.withColumn("_y", F.lit(True)), "year", "left"
    )
    scopes = F.filter(
        F.array(
            F.lit("overall"),
            F.when(F.col("_t"), F.concat(F.lit("technology="), "technology")),
            F.when(F.col("_y"), F.concat(F.lit("year="), F.col("year").cast("int").cast("string"))),
        ),
        lambda s: s.isNotNull(),
    )
    return base.select(F.explode(scopes).alias("scope"), "value")


def drift_report(expected: DataFrame, actual: DataFrame, metric: str, labels: tuple[str, str] = ("expected", "actual")) -> DataFrame:
    """Overall, per shared technology and per shared year, plus the year column itself.

    Inputs are (technology, year, value). All scopes are one grouped job.
    """
    from statloom.operators.relational import shared_keys

    techs = shared_keys(expected, actual, "technology", "technology", "technology")
    years = shared_keys(expected, actual, "year", "year", "year")

    def rows(df: DataFrame) -> DataFrame:
        measured = with_scopes(df, techs, years).withColumn("metric", F.lit(metric))
        itself = df.select(F.lit("overall").alias("scope"), F.col("year").cast("double").alias("value"), F.lit("year").alias("metric"))
        return measured.unionByName(itself)

    return drift_measures(rows(expected), rows(actual), ["metric", "scope"], labels)


def quantile_comparison(expected: DataFrame, actual: DataFrame, probs: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95, 0.99)) -> DataFrame:
    """(quantile, expected, actual, pct_change) of the positive values."""
    named = {f"p{int(p * 100)}": p for p in probs}

    def side(df: DataFrame, out: str) -> DataFrame:
        q = quantiles(df.where(F.col("value") > 0).select("value"), [], "value", named, small=is_small(df))
        return q.unpivot([], list(named), "quantile", out)

    both = side(expected, "expected").join(side(actual, "actual"), "quantile")
    change = F.when(F.col("expected") != 0, (F.col("actual") - F.col("expected")) / F.col("expected") * 100)
    return both.withColumn("pct_change", change)


def ecdf(values: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, value, ecdf): share of rows at or below each value."""
    counts = values.where(F.col("value").isNotNull()).groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("_n"))
    run = running_totals(counts, keys, ["value"], {"_cum": "_n"}, small=is_small(values))
    return run.select(*keys, "value", (F.col("_cum") / F.col("_cum_all")).alias("ecdf"))


def drift_counters(report: DataFrame) -> DataFrame:
    """How many rows of a drift report raise each signal."""
    return report.agg(
        F.count(F.lit(1)).alias("metrics_tested"), F.count_if(F.col("psi") > HIGH_PSI).alias("psi_high"),
        F.count_if(F.abs("median_pct_change") > HIGH_MEDIAN_PCT).alias("median_high"),
        F.count_if(F.col("ks_stat") > HIGH_KS).alias("ks_high"),
    )
