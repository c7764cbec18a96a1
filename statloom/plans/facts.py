"""Derived fact tables. Every builder is DataFrame -> DataFrame and lazy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from statloom.functions.dates import day_first_date, financial_year_start, hours_in_year, quarter_and_year
from statloom.functions.names import data_columns, is_flag, is_shadow
from statloom.functions.nulls import clip_low, div_nonzero, row_sum, safe_div
from statloom.functions.numbers import strict_number
from statloom.functions.units import mtoe_to_pj
from statloom.operators.fit import learning_fit
from statloom.operators.ordered import attach, fill_forward
from statloom.operators.relational import (
    any_keyword, country_rows, group_summary, grouped_sums, join_null_safe, last_per_year, map_values, matches, melt,
    numbered_columns_to_years, pick, row_difference, to_numbers,
)
from statloom.operators.series import cumulative_to_annual

DIMENSIONS = ["region", "sub_region", "country", "iso3_code", "year", "group_technology", "technology", "sub_technology"]
GENERATION, CAPACITY = "electricity_generation_gwh", "electricity_installed_capacity_mw"

# Load-factor column -> technology name of the country table.
TECHNOLOGY_NAMES = {
    "photovoltaics": "Solar photovoltaic",
    "pv": "Solar photovoltaic",
    "solar_photovoltaics": "Solar photovoltaic",
    "wind_onshore": "Onshore wind energy",
    "onshore_wind": "Onshore wind energy",
    "wind_offshore": "Offshore wind energy",
    "offshore_wind": "Offshore wind energy",
    "hydro": "Renewable hydropower",
    "hydropower": "Renewable hydropower",
}

# Fuels of the quarterly generation table.
RENEWABLE_FUELS = ("wind_and_solar", "hydro_natural_flow", "bioenergy")
FOSSIL_FUELS = ("coal", "oil", "gas")
FUELS = (
    "coal", "oil", "gas", "nuclear", "hydro_natural_flow", "wind_and_solar", "bioenergy",
    "pumped_storage_net_supply", "other_fuels", "net_imports_interconnectors",
)

# Industries of the energy-by-industry tables.
INDUSTRIES = (
    "agriculture_forestry_and_fishing", "mining_and_quarrying", "manufacturing",
    "electricity_gas_steam_and_air_conditioning_supply",
    "water_supply_sewerage_waste_management_and_remediation_activities", "construction",
    "wholesale_and_retail_trade_repair_of_motor_vehicles_and_motorcycles", "transport_and_storage",
    "accommodation_and_food_services", "information_and_communication", "financial_and_insurance_activities",
    "real_estate_activities", "professional_scientific_and_technical_activities",
    "administrative_and_support_service_activities", "public_administration_and_defence_compulsory_social_security",
    "education", "human_health_and_social_work_activities", "arts_entertainment_and_recreation",
    "other_service_activities", "consumer_expenditure",
)
HEAT_TECHNOLOGIES = ("air_source_heat_pump", "biomass", "ground_source_heat_pump", "solar_thermal")
COST_BANDS = {"0_4_kw": "0_4_kw_median_kw", "4_10_kw": "4_10_kw_median_kw", "10_50_kw": "10_50_kw_median_kw"}
PRICE_SERIES = ("electricity_baseload", "electricity_peakload", "gas")
UK_NATIONS = ("United Kingdom", "England", "Scotland", "Wales", "Northern Ireland")
RENEWABLE_SECTORS = ("electricity", "water supply", "energy from waste", "renewable")


def capacity_factor_of(generation: Column, capacity: Column, year: Column) -> Column:
    """GWh / (MW * hours / 1000); NULL without capacity."""
    return safe_div(generation, capacity * hours_in_year(year) / 1000.0)


def capacity_factor(country: DataFrame) -> DataFrame:
    """Capacity factor per country row, with plausibility flags (negative wins)."""
    kept = to_numbers(pick(country, [*DIMENSIONS, GENERATION, CAPACITY]), [GENERATION, CAPACITY, "year"])
    kept = kept.where(F.col(GENERATION).isNotNull() & (F.col(CAPACITY) > 0))
    hours = kept.withColumn("hours_per_calendar_year", hours_in_year(F.col("year")))
    factor = hours.withColumn("capacity_factor", F.col(GENERATION) / (F.col(CAPACITY) * F.col("hours_per_calendar_year") / 1000.0))
    flag = F.when(F.col("capacity_factor") < 0, "negative_generation").when(
        F.abs("capacity_factor") > 1.5, "implausible_factor_gt_1_5"
    )
    return factor.withColumn("capacity_factor_flag", flag)


def load_factors_long(load_factors: DataFrame) -> DataFrame:
    """Wide load factors -> (year, technology, load_factor) with the country table's names."""
    values = [c for c in load_factors.columns if c != "year"]
    long = melt(to_numbers(load_factors, ["year"]), ["year"], values, "_col", "load_factor").dropna(subset=["load_factor"])
    name = F.regexp_replace(F.lower("_col"), "[^a-z0-9_]", "_")
    return long.select("year", map_values(name, TECHNOLOGY_NAMES).alias("technology"), "load_factor")


def installs_by_year(installs: DataFrame, date_col: str, series: list[str], cumulative: bool = True) -> DataFrame:
    """Wide install counts -> one ``rhi_`` column per technology and year.

    The counts are cumulative, so the last one of a year stands; ``cumulative=False``
    adds them up instead.
    """
    dated = installs.withColumn("_date", day_first_date(F.col(date_col))).dropna(subset=["_date"])
    dated = to_numbers(dated, series).withColumn("year", F.year("_date"))
    pick_one = (lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_date")))) if cumulative else (
        lambda c: F.coalesce(F.sum(c), F.lit(0.0)))
    return dated.groupBy("year").agg(*[pick_one(c).alias(f"rhi_{c}") for c in series])


def renewables_fact(
    country: DataFrame, load_factors: DataFrame | None = None, installs: DataFrame | None = None, iso3: str = "GBR"
) -> DataFrame:
    """One country's capacity and generation with load factors and installs attached.

    ``load_factors`` is (year, technology, load_factor), ``installs`` one row per
    year. Both joins let a NULL year match a NULL year.
    """
    base = country.where(F.col("iso3_code") == iso3)
    base = pick(base, ["year", "group_technology", "technology", "sub_technology", CAPACITY, GENERATION])
    base = to_numbers(base, ["year", CAPACITY, GENERATION])
    if load_factors is not None:
        base = join_null_safe(base, load_factors, ["year", "technology"])
    else:
        base = base.withColumn("load_factor", F.lit(None).cast("double"))
    if installs is not None:
        base = join_null_safe(base, installs, ["year"])
    return base.withColumn("capacity_factor_calc", capacity_factor_of(F.col(GENERATION), F.col(CAPACITY), F.col("year")))


def productivity(turnover: DataFrame, fte: DataFrame) -> DataFrame:
    """Turnover per full-time equivalent by sector and year, with the change over three rows."""
    both = turnover.join(fte, ["sector", "year"])
    ratio = both.withColumn(
        "turnover_per_fte_thousand_gbp", div_nonzero(F.col("turnover_thousand_gbp"), F.col("fte"))
    )
    return ratio.withColumn(
        "turnover_per_fte_3y_delta", row_difference("turnover_per_fte_thousand_gbp", ["sector"], "year", 3)
    )


def generation_annual(quarterly: DataFrame, label: str = "unnamed_0", fuels: tuple[str, ...] = FUELS) -> DataFrame:
    """Annual generation by fuel, renewable and fossil totals and the renewable share."""
    quarter, year = quarter_and_year(F.col(label))
    have = [c for c in fuels if c in quarterly.columns]
    rows = to_numbers(quarterly, have).select(year.alias("year"), quarter.alias("quarter"), *have).dropna(subset=["year", "quarter"])
    return generation_shares(grouped_sums(rows, ["year"], have), have)


def generation_shares(annual: DataFrame, have: list[str], renewable=RENEWABLE_FUELS, fossil=FOSSIL_FUELS) -> DataFrame:
    sums = annual.withColumns({
        "renewable_twh": row_sum([F.col(c) for c in renewable if c in have]),
        "fossil_twh": row_sum([F.col(c) for c in fossil if c in have]),
        "total_gen_twh": row_sum([F.col(c) for c in have]),
    })
    return sums.withColumn("renewable_share_pct", safe_div(F.col("renewable_twh"), F.col("total_gen_twh")) * 100.0)


def renewable_share_by_industry(
    renewables: DataFrame, totals: DataFrame, industries: tuple[str, ...] = INDUSTRIES,
    year_left: str = "industry", year_right: str = "industry_name",
) -> DataFrame:
    """Renewable share of an industry's energy per year: one unpivot per side and one full join."""
    have = [c for c in industries if c in renewables.columns and c in totals.columns]

    def long(df: DataFrame, year_col: str, out: str) -> DataFrame:
        rows = df.withColumn("year", strict_number(F.col(year_col)).cast("int")).dropna(subset=["year"])
        return melt(rows, ["year"], have, "industry", out)

    both = long(renewables, year_left, "renewable_mtoe").join(long(totals, year_right, "total_pj"), ["year", "industry"], "full")
    return industry_share(both)


def industry_share(both: DataFrame) -> DataFrame:
    pj = both.withColumn("renewable_pj", mtoe_to_pj(F.col("renewable_mtoe")))
    share = safe_div(F.col("renewable_pj"), F.col("total_pj")) * 100.0
    return pj.select("year", "industry", "renewable_mtoe", "renewable_pj", "total_pj", share.alias("renewable_share_pct"))


def reconciliation(left: DataFrame, right: DataFrame, id_col: str = "industry_name", names: tuple[str, str] = ("desnz", "ons")) -> DataFrame:
    """Cell-level comparison of one table from two publishers.

    Both sides are unpivoted and joined once on (id, metric); text ids match as
    text, NULL with NULL.
    """
    metrics = sorted(c for c in data_columns(left.columns) if c in right.columns and c != id_col)
    a, b = f"{names[0]}_pj", f"{names[1]}_pj"
    l = melt(left, [id_col], metrics, "metric", a)
    r = melt(right, [id_col], metrics, "metric", b)
    both = join_null_safe(l, r, [id_col, "metric"], "full")
    return both.select(
        strict_number(F.col(id_col)).cast("int").alias("year"), "metric", a, b, F.abs(F.col(a) - F.col(b)).alias("abs_diff")
    )


def renewable_heat_annual(heat: DataFrame) -> DataFrame:
    """(year, component, value_mtoe) of the renewable-heat table."""
    values = [c for c in heat.columns if c != "year" and not is_shadow(c) and not is_flag(c)]
    return melt(to_numbers(heat, ["year"]), ["year"], values, "component", "value_mtoe").withColumn("year", F.col("year").cast("int"))


def unit_economics(payments: DataFrame, installs: DataFrame, date_col: str = "unnamed_0", technologies: tuple[str, ...] = HEAT_TECHNOLOGIES) -> DataFrame:
    """New installs and payments per technology and year, and the cost per install."""
    techs = list(technologies)
    paid = cumulative_to_annual(payments, techs, date_col, "cumulative_payments_gbpm")
    built = cumulative_to_annual(installs, techs, date_col, "cumulative_installs")
    return cost_per_install(built.join(paid, ["technology", "year"], "full"))


def cost_per_install(both: DataFrame) -> DataFrame:
    cost = F.when(F.col("new_cumulative_installs") > 0, F.col("new_cumulative_payments_gbpm") * 1e6 / F.col("new_cumulative_installs"))
    return both.withColumn("cost_per_install_gbp", cost)


def solar_learning(costs: DataFrame, fact: DataFrame, technology: str = "Solar photovoltaic", bands: dict[str, str] = COST_BANDS) -> DataFrame:
    """Median cost per band against cumulative capacity, with the fit of each band joined back."""
    have = {b: c for b, c in bands.items() if c in costs.columns}
    capacity = grouped_sums(
        fact.where(F.col("technology") == technology).dropna(subset=["year", CAPACITY]), ["year"], [CAPACITY]
    ).select(F.col("year").cast("int").alias("calendar_year"), F.col(CAPACITY).alias("cum_capacity_mw"))
    rows = costs.select(
        "financial_year", financial_year_start(F.col("financial_year")).alias("calendar_year"),
        *[strict_number(F.col(c)).alias(b) for b, c in have.items()],
    )
    long = rows.unpivot(["financial_year", "calendar_year"], list(have), "band", "median_cost_gbp_per_kw")
    return with_learning_fit(long.join(capacity, "calendar_year", "left"))


def with_learning_fit(points: DataFrame) -> DataFrame:
    fit = learning_fit(points, ["band"], "cum_capacity_mw", "median_cost_gbp_per_kw").select(
        "band", F.col("slope").alias("learning_slope"), "lr_per_doubling", "r_squared", F.col("n_obs").alias("n_obs_band")
    )
    return attach(points, fit, ["band"], "left")


def price_volatility_annual(prices: DataFrame, label: str = "unnamed_0", series: tuple[str, ...] = PRICE_SERIES) -> DataFrame:
    """Calendar-year statistics of every price series in one grouped job."""
    have = [c for c in series if c in prices.columns]
    dated = prices.withColumn("year", F.year(day_first_date(F.col(label)))).dropna(subset=["year"])
    return annual_volatility(melt(dated, ["year"], have, "series", "value"))


def annual_volatility(long: DataFrame) -> DataFrame:
    """(series, year) statistics of (series, year, value) rows."""
    stats = group_summary(long, ["series", "year"], "value", {"p5": 0.05, "p95": 0.95})
    return stats.withColumns({
        "cv": safe_div(F.col("std"), F.col("mean")), "range_p95_p5": F.col("p95") - F.col("p5"),
    })


BATTERY_INSTALLS, BATTERY_SAMPLE = "number_of_installations", "number_in_sample_note_2"
BATTERY_KWH = "total_capacity_of_sample_kwh_note_3_note_6"


def battery_monthly(df: DataFrame) -> DataFrame:
    """Storage per install by month: sample capacity over sample size."""
    rows = to_numbers(df, [BATTERY_INSTALLS, BATTERY_SAMPLE, BATTERY_KWH, "calendar_year"])
    rows = rows.withColumn("kwh_per_install", safe_div(F.col(BATTERY_KWH), F.col(BATTERY_SAMPLE)))
    return pick(rows, ["financial_year", "calendar_year", "month_of_installation_note_5", BATTERY_INSTALLS, BATTERY_SAMPLE, BATTERY_KWH, "kwh_per_install"])


def battery_annual(monthly: DataFrame) -> DataFrame:
    sums = grouped_sums(monthly, ["financial_year"], [BATTERY_INSTALLS, BATTERY_SAMPLE, BATTERY_KWH]).withColumnsRenamed(
        {BATTERY_INSTALLS: "n_installations", BATTERY_SAMPLE: "n_in_sample", BATTERY_KWH: "total_capacity_sample_kwh"}
    )
    return sums.withColumn("kwh_per_install", safe_div(F.col("total_capacity_sample_kwh"), F.col("n_in_sample")))


def by_country(sheet: DataFrame, position: str = "row_idx", keys: list[str] | None = None, first_year: int = 2014, n_years: int = 11) -> DataFrame:
    """(indicator, country, value, year): sparse indicator labels filled down, estimate columns to years."""
    label = F.trim("column")
    rows = sheet.withColumn("indicator", F.when(~F.coalesce(label, F.lit("")).isin("", "nan", "None"), label))
    filled = fill_forward(rows, keys or [], position, "indicator")
    named = filled.withColumn("country", F.trim("column_2")).where(F.col("country").isin(*UK_NATIONS))
    long = numbered_columns_to_years(named, ["indicator", "country"], "estimate", first_year, n_years)
    return long.dropna(subset=["indicator", "country"]).select("indicator", "country", "value", "year")


def renewable_sectors(lcree: DataFrame, keywords: tuple[str, ...] = RENEWABLE_SECTORS) -> DataFrame:
    """Turnover and FTE of the sectors that match a keyword, per year."""
    hit = lcree.where(any_keyword(F.col("sector"), keywords))
    return grouped_sums(hit, ["year"], ["turnover_thousand_gbp", "fte"]).select(
        "year", F.col("turnover_thousand_gbp").alias("renewable_turnover_thousand_gbp"), F.col("fte").alias("renewable_fte")
    )


def capacity_additions(fact: DataFrame) -> DataFrame:
    """Installed capacity per year and the rise on the year before, falls clipped."""
    total = grouped_sums(fact.dropna(subset=["year", CAPACITY]), ["year"], [CAPACITY])
    # One row per year is left, so the unpartitioned order is over a few dozen rows.
    return total.withColumn("new_capacity_mw", clip_low(row_difference(CAPACITY, [], "year", 1)))


def integrated_productivity(generation: DataFrame, lcree: DataFrame, country_long: DataFrame | None = None, fact: DataFrame | None = None) -> DataFrame:
    """Turnover per GWh, FTE per TWh and acquisitions per new MW of the renewable sectors."""
    gen = generation.select("year", "renewable_twh", (F.col("renewable_twh") * 1000.0).alias("renewable_gwh"))
    out = renewable_sectors(lcree).join(gen, "year")
    out = out.withColumns({
        "turnover_per_gwh_thousand_gbp": safe_div(F.col("renewable_turnover_thousand_gbp"), F.col("renewable_gwh")),
        "fte_per_twh": safe_div(F.col("renewable_fte"), F.col("renewable_twh")),
    })
    if fact is not None:
        out = out.join(capacity_additions(fact), "year", "left")
    if country_long is not None:
        uk = country_long.where(F.col("country") == "United Kingdom")

        def series(word: str, name: str) -> DataFrame:
            return uk.where(matches(F.col("indicator"), word)).select("year", F.col("value").alias(name))

        out = out.join(series("Acquisitions", "acquisitions_thousand_gbp"), "year", "left")
        out = out.join(series("Disposals", "disposals_thousand_gbp"), "year", "left")
        if fact is not None:
            out = out.withColumn("acquisitions_per_new_mw_thousand_gbp", safe_div(F.col("acquisitions_thousand_gbp"), F.col("new_capacity_mw")))
    return out


# ---- cross-source tables -----------------------------------------------------

def crosswalk(parts: list[DataFrame]) -> DataFrame:
    """Union of (year, metric, source, value, value_unit) series from several sources."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def capacity_series(table: DataFrame, source: str, column: str = CAPACITY) -> DataFrame:
    """One country's yearly capacity of a source, in crosswalk form."""
    rows = to_numbers(country_rows(table), [column]).dropna(subset=[column])
    return grouped_sums(rows, ["year"], [column]).select(
        F.col("year").cast("int").alias("year"), F.lit(column).alias("metric"), F.lit(source).alias("source"),
        F.col(column).alias("value"), F.lit("MW").alias("value_unit"),
    )


def installs_series(installs: DataFrame, date_col: str, series: list[str], source: str, cumulative: bool = True) -> DataFrame:
    wide = installs_by_year(installs, date_col, series, cumulative)
    long = wide.unpivot(["year"], [f"rhi_{c}" for c in series], "_m", "value")
    return long.select(
        "year", F.concat(F.lit("ofgem_"), "_m", F.lit("_installs")).alias("metric"), F.lit(source).alias("source"),
        F.col("value").cast("double").alias("value"), F.lit("count").alias("value_unit"),
    )


def load_factor_series(load_factors: DataFrame, source: str, year_col: str = "year") -> DataFrame:
    """Mean of every numeric column per year."""
    numeric = [c for c, t in load_factors.dtypes if c != year_col and t in ("double", "float", "int", "bigint")]
    rows = load_factors.withColumn("year", strict_number(F.col(year_col)).cast("int")).dropna(subset=["year"])
    long = melt(rows, ["year"], numeric, "_m", "_v").groupBy("year", "_m").agg(F.avg("_v").alias("value")).dropna(subset=["value"])
    return long.select(
        "year", F.concat(F.lit("desnz_load_factor_"), "_m").alias("metric"), F.lit(source).alias("source"), "value",
        F.lit("fraction").alias("value_unit"),
    )


def find_year_column(df: DataFrame) -> str | None:
    """A column called year, or one whose numbers are mostly between 1990 and 2100."""
    for c in df.columns:
        if c.lower() in ("year", "reference_year", "period"):
            return c
    x = {c: strict_number(F.col(f"`{c}`")) for c in df.columns}
    row = df.agg(*[
        F.struct(F.avg(F.when(v.isNotNull(), 1.0).otherwise(0.0)), F.avg(F.when(v.isNotNull(), F.when(v.between(1990, 2100), 1.0).otherwise(0.0)))).alias(c)
        for c, v in x.items()
    ]).first()
    return next((c for c in df.columns if (row[c][0] or 0) > 0.8 and (row[c][1] or 0) > 0.9), None)


def find_sector_column(df: DataFrame) -> str | None:
    text = [c for c, t in df.dtypes if t == "string"]
    named = next((c for c in text if "sector" in c.lower()), None)
    if named or not text:
        return named
    row = df.agg(*[F.approx_count_distinct(f"`{c}`").alias(c) for c in text]).first()
    return next((c for c in text if row[c] > 3), None)


def find_uk_column(df: DataFrame) -> str | None:
    exact = next((c for c in df.columns if c.lower() == "uk" or "united_kingdom" in c.lower() or c.lower().endswith("_uk")), None)
    numeric = {c for c, t in df.dtypes if t in ("double", "float", "int", "bigint")}
    return exact or next((c for c in df.columns if "uk" in c.lower() and c in numeric), None)


def turnover_against_fte(turnover: DataFrame, fte: DataFrame) -> DataFrame | None:
    """Turnover per FTE where year, sector and country columns first have to be found."""
    sides = []
    for df, out in ((turnover, "to_value"), (fte, "fte_value")):
        cols = (find_year_column(df), find_sector_column(df), find_uk_column(df))
        if None in cols:
            return None
        sides.append(df.select(strict_number(F.col(cols[0])).alias("year"), F.col(cols[1]).alias("sector"), strict_number(F.col(cols[2])).alias(out)))
    both = sides[0].join(sides[1], ["year", "sector"]).dropna(subset=["to_value", "fte_value"])
    return both.withColumn("turnover_per_fte", div_nonzero(F.col("to_value"), F.col("fte_value")))


def heat_per_install(heat: DataFrame, approved: DataFrame, date_col: str, count_col: str) -> DataFrame:
    """Renewable heat per cumulative install; the last count of each year stands."""
    dated = to_numbers(approved.withColumn("_date", day_first_date(F.col(date_col))), [count_col])
    ends = last_per_year(dated.select("_date", F.col(count_col).alias("cumulative_total")), [], "_date", "cumulative_total")
    warm = heat.select(strict_number(F.col("year")).cast("int").alias("year"), strict_number(F.col("heat_energy_from_renewable_sources")).alias("heat_mtoe"))
    both = warm.dropna().join(ends, "year")
    return both.select("year", "heat_mtoe", "cumulative_total", safe_div(F.col("heat_mtoe"), F.col("cumulative_total")).alias("heat_mtoe_per_install"))
