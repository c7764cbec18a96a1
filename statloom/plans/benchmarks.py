"""Benchmark and brief queries over the fact tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from statloom.functions.dates import financial_year_start, hours_in_year, month_year_date
from statloom.functions.numbers import strict_number
from statloom.functions.nulls import div_nonzero, row_sum, safe_div
from statloom.functions.stats import cagr
from statloom.operators.fit import learning_fit
from statloom.operators.ordered import quantiles
from statloom.operators.relational import (
    any_keyword, group_median, grouped_sums, latest_rows, matches, melt, nth_from_last, rolling_mean, to_matrix,
    to_numbers, top_k, weighted_mean,
)
from statloom.operators.series import change_points, latest_volatility, mean_shift
from statloom.plans.facts import CAPACITY, GENERATION, capacity_factor_of

# ISO codes of the peer group.
PEER_GROUP = (
    "AUS", "AUT", "BEL", "CAN", "CHL", "COL", "CRI", "CZE", "DNK", "EST", "FIN", "FRA", "DEU", "GRC", "HUN", "ISL",
    "IRL", "ISR", "ITA", "JPN", "KOR", "LVA", "LTU", "LUX", "MEX", "NLD", "NZL", "NOR", "POL", "PRT", "SVK", "SVN",
    "ESP", "SWE", "CHE", "TUR", "GBR", "USA",
)
INDICATOR = "sdg_7b1_re_capacity_per_capita_w_inhabitant"
MIN_FLEET_MW = 50.0
OUTLIER_FACTOR = 1.5


# ---- capacity factors --------------------------------------------------------

def group_weighted_factor(df: DataFrame, keys: list[str]) -> DataFrame:
    """sum(GWh) / (sum(MW) * hours / 1000) per group; NULL keys are a group."""
    sums = df.groupBy(*keys).agg(
        F.coalesce(F.sum(GENERATION), F.lit(0.0)).alias(GENERATION), F.coalesce(F.sum(CAPACITY), F.lit(0.0)).alias(CAPACITY),
        *([] if "year" in keys else [F.min("year").alias("year")]),
    )
    return sums.withColumn("capacity_factor_weighted", capacity_factor_of(F.col(GENERATION), F.col(CAPACITY), F.col("year")))


def concentration(df: DataFrame, part: str = "technology", value: str = CAPACITY) -> DataFrame:
    """(year, hhi): sum of squared shares; years without a positive total drop out."""
    per = df.dropna(subset=["year", part]).groupBy("year", part).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("_v"))
    total = per.groupBy("year").agg(F.sum("_v").alias("_t"), F.sum(F.col("_v") * F.col("_v")).alias("_q"))
    return total.where(F.col("_t") > 0).select("year", (F.col("_q") / (F.col("_t") * F.col("_t"))).alias("hhi"))


def top_countries(factors: DataFrame, technology: str, year: int | Column, n: int = 5, min_fleet: float = MIN_FLEET_MW) -> DataFrame:
    rows = factors.where(
        (F.col("technology") == technology) & (F.col("year") == year) & (F.col(CAPACITY) >= min_fleet) & F.col("capacity_factor").isNotNull()
    )
    return top_k(rows.select("country", "iso3_code", "capacity_factor", CAPACITY), "capacity_factor", n, ["country"])


def capacity_by_year_technology(df: DataFrame) -> DataFrame:
    return grouped_sums(df.dropna(subset=[CAPACITY]), ["year", "technology"], [CAPACITY])


def top_countries_latest_year(df: DataFrame, n: int = 20) -> DataFrame:
    """Countries with the most capacity in the last year."""
    now = latest_rows(df, "year").dropna(subset=[CAPACITY])
    return top_k(grouped_sums(now, ["country"], [CAPACITY]), CAPACITY, n, ["country"])


def five_numbers(factors: DataFrame, keys: list[str]) -> DataFrame:
    """min, quartiles and max of the plausible factors per group."""
    rows = factors.where(F.abs("capacity_factor") <= OUTLIER_FACTOR).dropna(subset=keys)
    return quantiles(rows, keys, "capacity_factor", {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0})


def median_factor_matrix(factors: DataFrame, technologies: list[str]) -> DataFrame:
    """year x technology medians of the plausible factors."""
    rows = factors.where(F.abs("capacity_factor") <= OUTLIER_FACTOR)
    med = group_median(rows, ["year", "technology"], "capacity_factor").withColumn("median", F.round("median", 3))
    return to_matrix(med, "year", "technology", "median", technologies)


def factor_matrix(factors: DataFrame, technology: str, peers: list[str], years: list[int], n: int = 5) -> DataFrame:
    """country x year factors for the peers and the top countries of the last year."""
    last = factors.agg(F.max("year").alias("y")).scalar()
    best = top_countries(factors, technology, last, n).select("country")
    wanted = factors.where(F.col("technology") == technology).join(
        best.union(factors.where(F.col("country").isin(*peers)).select("country")).distinct(), "country"
    )
    return to_matrix(wanted, "country", "year", "capacity_factor", years)


def country_against_world(factors: DataFrame, iso3: str = "GBR") -> DataFrame:
    """Last year: a country's mean factor beside the median of all countries, by technology."""
    now = latest_rows(factors, "year").dropna(subset=["capacity_factor"])
    world = group_median(now, ["technology"], "capacity_factor", "global_median")
    own = now.where(F.col("iso3_code") == iso3).groupBy("technology").agg(F.avg("capacity_factor").alias("country_mean"))
    return own.join(world, "technology")


def yearly_technology_factors(fact: DataFrame) -> DataFrame:
    """Generation, capacity, hours and factor per (year, technology)."""
    sums = grouped_sums(fact, ["year", "technology"], [GENERATION, CAPACITY])
    return sums.withColumns({
        "hours": hours_in_year(F.col("year")), "cf": capacity_factor_of(F.col(GENERATION), F.col(CAPACITY), F.col("year"))
    })


def capacity_before_after(fact: DataFrame, cut: int = 2015) -> DataFrame:
    """Total capacity per year, marked as before or from ``cut``."""
    total = grouped_sums(fact.dropna(subset=[CAPACITY]), ["year"], [CAPACITY])
    return total.withColumn("period", F.when(F.col("year") < cut, "before").otherwise("from"))


def growth_ladder(yearly: DataFrame, periods: dict[str, tuple[int, int]]) -> DataFrame:
    """CAGR of capacity, generation and factor per technology and period."""
    periods_col = F.filter(
        F.array(*[F.when(F.col("year").between(a, b), F.lit(label)) for label, (a, b) in periods.items()]), lambda p: p.isNotNull()
    )
    rows = yearly.withColumn("period", F.explode(periods_col))
    ends = rows.groupBy("technology", "period").agg(
        F.count(F.lit(1)).alias("_n"), (F.max("year") - F.min("year")).cast("double").alias("_span"),
        *[f(c, "year").alias(f"_{c}_{tag}") for c in (CAPACITY, GENERATION, "cf") for f, tag in ((F.min_by, "s"), (F.max_by, "e"))],
    ).where((F.col("_n") >= 2) & (F.col("_span") > 0))

    def growth(c: str) -> Column:
        return F.round(cagr(F.col(f"_{c}_s"), F.col(f"_{c}_e"), F.col("_span")), 4)

    return ends.select(
        "technology", "period", growth(CAPACITY).alias("cagr_capacity"), growth(GENERATION).alias("cagr_generation"),
        growth("cf").alias("cagr_cf"),
    )


def technology_sheet(own: DataFrame, world: DataFrame, year_lo: int, year_hi: int) -> DataFrame:
    """Per technology: growth of capacity and generation, the factor's last 3-year mean, the world factor."""
    rows = own.where(F.col("year").between(year_lo, year_hi)).dropna(subset=["technology"])
    span = F.lit(float(year_hi - year_lo))

    def ends(c: str) -> list[Column]:
        when = F.when(F.col(c).isNotNull(), F.col("year"))
        return [F.min_by(c, when).alias(f"_{c}_s"), F.max_by(c, when).alias(f"_{c}_e"), F.count(c).alias(f"_{c}_n")]

    grown = rows.groupBy("technology").agg(*ends(CAPACITY), *ends(GENERATION))

    def growth(c: str) -> Column:
        return F.when(F.col(f"_{c}_n") >= 2, cagr(F.col(f"_{c}_s"), F.col(f"_{c}_e"), span))

    factor = rows.withColumn("_cf", capacity_factor_of(F.col(GENERATION), F.col(CAPACITY), F.col("year")))
    smooth = factor.withColumn("_roll", rolling_mean("_cf", ["technology"], "year", 3, 1))
    last = smooth.groupBy("technology").agg(F.max_by("_roll", "year").alias("rolling_cf_3y_end"))
    end = group_weighted_factor(world.where(F.col("year") == year_hi), ["technology"]).select(
        "technology", F.col("capacity_factor_weighted").alias("global_weighted_cf_end")
    )
    return grown.select("technology", growth(CAPACITY).alias("cagr_capacity"), growth(GENERATION).alias("cagr_generation")).join(
        last, "technology", "left"
    ).join(end, "technology", "left")


# ---- indicators and peers ----------------------------------------------------

def indicator_series(country: DataFrame, iso3: str, column: str = INDICATOR, out: str = "sdg_7b1_w_per_capita") -> DataFrame:
    """National indicator per year; it repeats per technology, so the maximum stands."""
    return country.where(F.col("iso3_code") == iso3).dropna(subset=["year"]).groupBy("year").agg(F.max(column).alias(out))


def peer_benchmark(country: DataFrame, population: DataFrame | None, peers: tuple[str, ...] = PEER_GROUP, column: str = INDICATOR) -> DataFrame:
    """(year, oecd_benchmark): median of the peers, or their population-weighted mean."""
    rows = country.where(F.col("iso3_code").isin(*peers)).dropna(subset=["year"])
    best = rows.groupBy("iso3_code", "year").agg(F.max(column).alias("_x"))
    if population is None:
        return group_median(best, ["year"], "_x", "oecd_benchmark")
    people = population.select(F.col("iso3").alias("iso3_code"), "year", "population")
    return weighted_mean(best.join(people, ["iso3_code", "year"], "left"), ["year"], "_x", "population", "oecd_benchmark")


def global_generation(world: DataFrame) -> DataFrame:
    rows = world.where(matches(F.col("re_or_non_re"), "Total Renewable"))
    return grouped_sums(rows, ["year"], [GENERATION]).withColumnRenamed(GENERATION, "global_generation_gwh")


def capacity_per_fte(lcree: DataFrame, capacity: DataFrame, keywords: tuple[str, ...] = ("Electricity", "Energy from waste", "Water supply")) -> DataFrame:
    """Turnover per FTE and MW per FTE of the matching sectors; ``capacity`` is (year, mw_total)."""
    sums = grouped_sums(lcree.where(any_keyword(F.col("sector"), keywords)), ["year"], ["turnover_thousand_gbp", "fte"])
    return sums.join(capacity, "year").withColumns({
        "turnover_per_fte_thousand_gbp": div_nonzero(F.col("turnover_thousand_gbp"), F.col("fte")),
        "mw_per_fte": div_nonzero(F.col("mw_total"), F.col("fte")),
    })


# ---- scheme and heat ---------------------------------------------------------

def application_queue(df: DataFrame, label: str = "unnamed_0", cols: tuple[str, ...] = ("received", "processed", "queue")) -> DataFrame:
    """Dated application counts."""
    have = [c for c in cols if c in df.columns]
    return to_numbers(df, have).withColumn("date", month_year_date(F.col(label))).dropna(subset=["date"]).select("date", *have)


def scheme_actuals(df: DataFrame, label: str = "unnamed_0", cols: tuple[str, ...] = ("target", "domestic_rhi", "non_domestic_rhi")) -> DataFrame:
    """(date, series, pct) of targets and actuals."""
    have = [c for c in cols if c in df.columns]
    dated = df.withColumn("date", month_year_date(F.col(label))).dropna(subset=["date"])
    return melt(dated, ["date"], have, "series", "pct").dropna(subset=["pct"])


# ---- productivity ------------------------------------------------------------

def productivity_counters(view: DataFrame) -> DataFrame:
    """Sectors, years and the median turnover per FTE of a selection."""
    counts = view.agg(F.count_distinct("sector").alias("n_sectors"), F.count_distinct("year").alias("n_years"))
    mid = quantiles(view, [], "turnover_per_fte_thousand_gbp", {"m": 0.5}).scalar()
    return counts.withColumn("median_turnover_per_fte", mid)


def yearly_productivity(view: DataFrame) -> DataFrame:
    sums = grouped_sums(view, ["year"], ["turnover_thousand_gbp", "fte"])
    return sums.withColumn("turnover_per_fte_thousand_gbp", div_nonzero(F.col("turnover_thousand_gbp"), F.col("fte")))


def latest_snapshot(view: DataFrame) -> DataFrame:
    """Rows of the last year, most productive first, rounded for display."""
    cols = ["turnover_thousand_gbp", "fte", "turnover_per_fte_thousand_gbp", "turnover_per_fte_3y_delta"]
    rows = latest_rows(view, "year").orderBy(F.col("turnover_per_fte_thousand_gbp").desc_nulls_last(), "sector")
    return rows.select("sector", *[F.round(c, 1).alias(c) for c in cols])


def reconciliation_verdict(recon: DataFrame) -> DataFrame:
    biggest = F.max("abs_diff")
    return recon.agg(
        F.count(F.lit(1)).alias("rows_compared"), biggest.alias("max_abs_diff"),
        F.when(biggest.isNull() | (biggest == 0), True).otherwise(False).alias("all_identical"),
    )


def worst_differences(recon: DataFrame, n: int = 50) -> DataFrame:
    return top_k(recon.where(F.col("abs_diff") > 0), "abs_diff", n, ["metric", "year"])


def headline(generation: DataFrame, fact: DataFrame, integrated: DataFrame, fte_share: float = 0.4) -> DataFrame:
    """One row: last renewable share, weighted factor of the last year with data, and the
    productivity of the last year whose FTE is at least 0.4 of the median."""
    share = generation.dropna(subset=["renewable_share_pct"]).agg(F.max_by("renewable_share_pct", "year").alias("v"))
    factors = group_weighted_factor(fact.dropna(subset=["year"]), ["year"]).where(F.col(GENERATION) > 0)
    last_cf = factors.agg(F.max_by("capacity_factor_weighted", "year").alias("v"))
    middle = quantiles(integrated, [], "renewable_fte", {"m": 0.5}).scalar()
    full = integrated.where(F.col("renewable_fte") >= fte_share * middle)
    return full.agg(
        F.max("year").alias("productivity_year"),
        F.max_by("turnover_per_gwh_thousand_gbp", "year").alias("turnover_per_gwh_thousand_gbp"),
        F.max_by("fte_per_twh", "year").alias("fte_per_twh"),
    ).withColumns({"renewable_share_pct": share.scalar(), "weighted_capacity_factor": last_cf.scalar()})


def top_industries(shares: DataFrame, n: int = 12) -> DataFrame:
    """The yearly series of the industries with the highest mean share."""
    mean = shares.dropna(subset=["industry"]).groupBy("industry").agg(F.avg("renewable_share_pct").alias("mean_share"))
    best = top_k(mean, "mean_share", n, ["industry"]).select("industry")
    return shares.join(best, "industry").select("industry", "year", "renewable_share_pct")


# ---- prices ------------------------------------------------------------------

def deflate(df: DataFrame, value: str, year: str, cpi: DataFrame, out: str) -> DataFrame:
    """Value in base-year prices: times 100 / index; a year without an index keeps its value."""
    factor = cpi.select(F.col("year").alias("_cy"), (100.0 / F.col("cpi_index_2024_base")).alias("_factor"))
    joined = df.join(factor, F.col(year) == F.col("_cy"), "left")
    return joined.withColumn(out, F.col(value) * F.coalesce("_factor", F.lit(1.0))).drop("_cy", "_factor")


def real_cost_fits(points: DataFrame, cpi: DataFrame) -> DataFrame:
    """Experience curves on deflated costs."""
    real = deflate(points, "median_cost_gbp_per_kw", "calendar_year", cpi, "cost_real")
    return learning_fit(real, ["band"], "cum_capacity_mw", "cost_real")


def real_unit_costs(unit: DataFrame, cpi: DataFrame) -> DataFrame:
    return deflate(unit, "cost_per_install_gbp", "year", cpi, "cost_real")


def acquisitions_against_prices(country_long: DataFrame, volatility: DataFrame, series: str = "gas") -> DataFrame:
    """(year, acquisitions_thousand_gbp, gas_cv)."""
    acq = country_long.where((F.col("country") == "United Kingdom") & matches(F.col("indicator"), "Acquisitions"))
    acq = acq.select("year", F.col("value").alias("acquisitions_thousand_gbp"))
    gas = volatility.where(F.col("series") == series).select("year", F.col("cv").alias("gas_cv"))
    return acq.join(gas, "year")


# ---- breaks and flags --------------------------------------------------------

def load_factor_series(load_factors: DataFrame) -> DataFrame:
    """(technology, fy_start, weighted_mean) of the load-factor table."""
    return load_factors.select(
        "technology", financial_year_start(F.col("financial_year")).alias("fy_start"), F.col("weighted_mean").cast("double").alias("weighted_mean")
    ).dropna(subset=["fy_start", "weighted_mean"])


def load_factor_shifts(series: DataFrame, at: int = 2016, min_points: int = 8) -> DataFrame:
    """Mean shift at a financial year per technology with enough points."""
    long_enough = series.groupBy("technology").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_points)
    return mean_shift(series.join(long_enough.select("technology"), "technology"), ["technology"], "fy_start", "weighted_mean", at)


def load_factor_breaks(series: DataFrame, penalty: float = 12.0, min_points: int = 8) -> DataFrame:
    long_enough = series.groupBy("technology").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_points)
    return change_points(series.join(long_enough.select("technology"), "technology"), ["technology"], "fy_start", "weighted_mean", penalty)


def fell_more_than(series: DataFrame, order: str, value: str, flag: str, back: int = 5, drop: float = 1.0, min_rows: int = 6) -> DataFrame:
    """One flag row if the value fell by more than ``drop`` since ``back`` rows ago (inclusive)."""
    last = nth_from_last(series.dropna(subset=[value]), [], order, value, [1, back, min_rows])
    fired = (F.col(f"{value}_last_{back}") - F.col(f"{value}_last_1") > drop) & F.col(f"{value}_last_{min_rows}").isNotNull()
    return last.where(fired).select(F.lit(flag).alias("flag"))


def shrank_below(series: DataFrame, order: str, value: str, flag: str, back: int = 3, factor: float = 0.9) -> DataFrame:
    last = nth_from_last(series, [], order, value, [1, back])
    return last.where(F.col(f"{value}_last_1") < factor * F.col(f"{value}_last_{back}")).select(F.lit(flag).alias("flag"))


def volatile_lately(series: DataFrame, order: str, value: str, flag: str, window: int = 12, above: float = 0.5) -> DataFrame:
    return latest_volatility(series, order, value, window).where(F.col("cv") > above).select(F.lit(flag).alias("flag"))


def budget_and_queue(actuals: DataFrame, queue: DataFrame, flag: str, series: str = "non_domestic_rhi", budget: float = 99.0, waiting: float = 120.0) -> DataFrame:
    last_queue = queue.agg(F.max_by("queue", "date").alias("q")).scalar()
    last = actuals.where(F.col("series") == series).agg(F.max_by("pct", "date").alias("pct"))
    return last.where((F.col("pct") >= budget) & (last_queue > waiting)).select(F.lit(flag).alias("flag"))


# ---- fact views --------------------------------------------------------------

def installs_long(fact: DataFrame) -> DataFrame:
    """(year, rhi_technology, installs): the install columns repeat per technology, one row per year counts."""
    cols = [c for c in fact.columns if c.startswith("rhi_")]
    one = fact.dropna(subset=["year"]).groupBy("year").agg(*[F.max(c).alias(c) for c in cols])
    return one.unpivot(["year"], cols, "rhi_technology", "installs").dropna(subset=["installs"])


def factor_trend(fact: DataFrame) -> DataFrame:
    """Plausible factors with their rolling mean over three rows per technology."""
    rows = fact.where(F.abs("capacity_factor_calc") <= OUTLIER_FACTOR).dropna(subset=["technology", "year"])
    mean = rolling_mean("capacity_factor_calc", ["technology"], "year", 3, 1)
    return rows.select("technology", "year", "capacity_factor_calc").withColumn("rolling_3", mean)


def indicator_by_prefix(country_long: DataFrame, prefix: str) -> DataFrame:
    return country_long.where(F.col("indicator").startswith(prefix)).select("country", "year", "value")


def biomass_by_year(renewables: DataFrame, cols: tuple[str, ...] = ("plant_biomass", "animal_biomass"), year_col: str = "industry") -> DataFrame:
    have = [c for c in cols if c in renewables.columns]
    return renewables.select(
        strict_number(F.col(year_col)).cast("int").alias("year"), row_sum([strict_number(F.col(c)) for c in have]).alias("bio_mtoe")
    ).dropna(subset=["year"])


def sector_series(lcree: DataFrame, word: str) -> DataFrame:
    return lcree.where(matches(F.col("sector"), word)).select("sector", "year", "fte")


# ---- browsers and counters ---------------------------------------------------

def browse_issues(issues: DataFrame, codes: list[str] | None = None, workbooks: list[str] | None = None) -> DataFrame:
    rows = issues
    if codes:
        rows = rows.where(F.col("issue_code").isin(*codes))
    if workbooks:
        rows = rows.where(F.col("workbook").isin(*workbooks))
    return rows.orderBy(F.col("rows_affected").desc(), "workbook", "sheet", "column", "issue_code")


def contract_violations(issues: DataFrame) -> DataFrame:
    return issues.where(F.col("issue_code") == "schema_contract_violation")


def browse_catalog(catalog: DataFrame, publishers: list[str] | None = None, tiers: list[str] | None = None) -> DataFrame:
    rows = catalog
    if publishers:
        rows = rows.where(F.col("publisher").isin(*publishers))
    if tiers:
        rows = rows.where(F.col("tier").isin(*tiers))
    return rows.orderBy("publisher", "sheet_id")


def drift_view(report: DataFrame, n_cols: tuple[str, str], high_only: bool = False) -> DataFrame:
    rows = report.where((F.col(n_cols[0]) >= 30) & (F.col(n_cols[1]) >= 30))
    if high_only:
        rows = rows.where("high_drift_any")
    return rows.orderBy(F.col("psi").desc(), F.col("median_pct_change").desc(), "metric", "scope")


def issue_counters(issues: DataFrame) -> DataFrame:
    """Issues in all and by confidence."""
    return issues.groupBy("confidence").agg(F.count(F.lit(1)).alias("n_issues"), F.sum("rows_affected").alias("rows_affected"))


def catalog_counters(catalog: DataFrame) -> DataFrame:
    return catalog.agg(F.count(F.lit(1)).alias("n_sheets"), F.sum(F.greatest("n_rows", F.lit(0))).alias("n_rows"), F.count_distinct("publisher").alias("n_publishers"))


def highest_drift(report: DataFrame, n: int = 15) -> DataFrame:
    return top_k(report.where("high_drift_any"), "psi", n, ["metric", "scope"])



def share_and_employment(generation: DataFrame, sectors: DataFrame) -> DataFrame:
    """Renewable share beside the FTE of the renewable sectors."""
    return generation.select("year", "renewable_share_pct").join(sectors.select("year", "renewable_fte"), "year")
