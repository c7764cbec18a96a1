"""Fact builders on the given tables in domain shape."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from statloom.operators import fit, grid
from statloom.operators.series import cumulative_long_to_annual
from statloom.plans import facts as f
from workload import shapes as s
from workload.base import query, table

FIRST_YEAR, N_YEARS = s.FIRST_YEAR, s.N_YEARS
MW, GWH = "electricity_installed_capacity_mw", "electricity_generation_gwh"


@query("yearly_shares_flagship", "year:i A:2 N:2 R:2 total:2 share_r_pct:4", """SELECT year(o_orderdate) AS year, sum(CASE WHEN l_returnflag = 'A' THEN rev ELSE 0 END) AS "A",
sum(CASE WHEN l_returnflag = 'N' THEN rev ELSE 0 END) AS "N", sum(CASE WHEN l_returnflag = 'R' THEN rev ELSE 0 END) AS "R", sum(rev) AS total,
sum(CASE WHEN l_returnflag = 'R' THEN rev ELSE 0 END) / sum(rev) * 100 AS share_r_pct
FROM (SELECT l_orderkey, l_returnflag, l_extendedprice * (1 - l_discount) AS rev FROM lineitem) JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def _(spark, d):
    from statloom.functions.nulls import row_sum, safe_div

    # Revenue is summed per order and flag before the join, so the join moves fewer rows.
    line = table(spark, d, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("rev"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").alias("year"))
    wide = line.join(orders, "l_orderkey").groupBy("year").pivot("l_returnflag", ["A", "N", "R"]).agg(F.coalesce(F.sum("rev"), F.lit(0.0)))
    total = wide.withColumn("total", row_sum([F.col("A"), F.col("N"), F.col("R")]))
    return total.withColumn("share_r_pct", safe_div(F.col("R"), F.col("total")) * 100)


@query("capacity_factor_b1", "country:s iso3_code:s year:i technology:s hours_per_calendar_year:i capacity_factor:6 capacity_factor_flag:s", f"""WITH {s.COUNTRY_SQL}
SELECT country, iso3_code, year, technology, hours AS hours_per_calendar_year, cf AS capacity_factor,
CASE WHEN cf < 0 THEN 'negative_generation' WHEN abs(cf) > 1.5 THEN 'implausible_factor_gt_1_5' END AS capacity_factor_flag FROM factors""")
def _(spark, d):
    return f.capacity_factor(s.country(spark, d))


RENAMED = {"pv": "ECONOMY", "hydro": "SMALL"}


def _load_factors(spark, d):
    """Wide load factors by year; two columns carry the source's own technology names."""
    o = table(spark, d, "orders").select(F.year("o_orderdate").alias("year"), "o_orderstatus", "o_totalprice")
    return o.groupBy("year").agg(
        F.avg(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("pv"),
        F.avg(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice"))).alias("hydro"))


def _installs(spark, d):
    """Wide cumulative installs with dd-MM-yyyy labels."""
    c = s.cumulative_orders(spark, d)
    names = {"1-URGENT": "air_source_heat_pump", "2-HIGH": "biomass"}
    return c.groupBy(F.date_format("date", "dd-MM-yyyy").alias("unnamed_0")).agg(
        *[F.max(F.when(F.col("technology") == t, F.col("cumulative_installs"))).alias(n) for t, n in names.items()])


def _fact(spark, d):
    country = s.country(spark, d).withColumn("technology", F.when(F.col("technology") == "ECONOMY", "Solar photovoltaic").when(
        F.col("technology") == "SMALL", "Renewable hydropower").otherwise(F.col("technology")))
    installs = f.installs_by_year(_installs(spark, d), "unnamed_0", ["air_source_heat_pump", "biomass"])
    return f.renewables_fact(country, f.load_factors_long(_load_factors(spark, d)), installs, iso3="N05")


FACT_SQL = f"""{s.COUNTRY_SQL}, {s.YEARLY_ORDERS_SQL},
lf AS (SELECT year(o_orderdate) AS year, CASE o_orderstatus WHEN 'F' THEN 'Solar photovoltaic' ELSE 'Renewable hydropower' END AS technology, avg(o_totalprice) AS load_factor
  FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY ALL),
inst AS (SELECT year, max(CASE WHEN technology = '1-URGENT' THEN cum_installs END) AS rhi_a, max(CASE WHEN technology = '2-HIGH' THEN cum_installs END) AS rhi_b FROM levels GROUP BY 1),
named AS (SELECT * REPLACE (CASE technology WHEN 'ECONOMY' THEN 'Solar photovoltaic' WHEN 'SMALL' THEN 'Renewable hydropower' ELSE technology END AS technology) FROM factors WHERE iso3_code = 'N05'),
fact AS (SELECT n.year, n.technology, mw, gwh, load_factor, rhi_a AS rhi_air_source_heat_pump, rhi_b AS rhi_biomass, cf AS capacity_factor_calc
  FROM named n LEFT JOIN lf ON n.year = lf.year AND n.technology = lf.technology LEFT JOIN inst ON n.year = inst.year)"""


@query("renewables_fact_b2", "year:i technology:s load_factor:4 rhi_air_source_heat_pump:i rhi_biomass:i capacity_factor_calc:6", f"WITH {FACT_SQL} SELECT * FROM fact")
def _(spark, d):
    return _fact(spark, d)


@query("section_block_b3", "sheet:s sector:s year:i value:2", f"""WITH {s.SECTORS_SQL}
SELECT 'TO' AS sheet, sector, year, round(turnover, 2) AS value FROM sectors
UNION ALL SELECT 'FTE', sector, year, fte FROM sectors""")
def _(spark, d):
    """The sector table printed as a sheet (title, year row, label row, data, next table) and read back."""
    x = s.sectors(spark, d).withColumn("place", F.rank().over(W.partitionBy("year").orderBy("sector")))
    sheets = F.explode(F.array(F.struct(F.lit("TO").alias("sheet"), F.format_string("%.2f", "turnover_thousand_gbp").alias("v")),
                               F.struct(F.lit("FTE").alias("sheet"), F.format_string("%.0f", "fte").alias("v"))))
    rows = x.select("sector", "year", "place", sheets.alias("z")).select("sector", "year", "place", "z.*")
    col = 2 + (F.col("year") - FIRST_YEAR) * 2

    def cell(row, col_idx, value):
        return F.struct(F.lit(row).cast("int").alias("row_idx") if isinstance(row, int) else row.cast("int").alias("row_idx"),
                        F.lit(col_idx).cast("int").alias("col_idx") if isinstance(col_idx, int) else col_idx.cast("int").alias("col_idx"), value.cast("string").alias("value"))

    cells = F.array(
        cell(0, 0, F.lit("Notes first")), cell(3, 0, F.lit("Table 1: sectors")), cell(5, col + 1, F.col("year")),
        cell(6, col, F.lit("estimate")), cell(6, col + 1, F.lit("lower CI")),
        cell(F.col("place") + 7, 1, F.col("sector")), cell(F.col("place") + 7, col, F.col("v")), cell(F.col("place") + 7, col + 1, F.lit("0")),
        cell(40, 0, F.lit("Table 2: other")), cell(44, 1, F.lit("Elsewhere")), cell(44, 2, F.lit("1")))
    g = rows.select("sheet", F.inline(cells)).distinct()
    return grid.section_block(g, ["sheet"])


@query("productivity_b4", "sector:s year:i turnover_thousand_gbp:2 fte:2 turnover_per_fte_thousand_gbp:4 turnover_per_fte_3y_delta:4", f"""WITH {s.SECTORS_SQL}
SELECT sector, year, turnover AS turnover_thousand_gbp, fte, turnover / fte AS turnover_per_fte_thousand_gbp,
turnover / fte - lag(turnover / fte, 3) OVER (PARTITION BY sector ORDER BY year) AS turnover_per_fte_3y_delta FROM sectors""")
def _(spark, d):
    x = s.sectors(spark, d)
    return f.productivity(x.drop("fte"), x.drop("turnover_thousand_gbp"))


@query("generation_annual_b5", "year:i coal:4 wind_and_solar:4 renewable_twh:4 fossil_twh:4 total_gen_twh:4 renewable_share_pct:4", f"WITH {s.FUELS_SQL} SELECT * FROM generation")
def _(spark, d):
    return f.generation_annual(s.quarterly(spark, d))


INDUSTRY_SQL = """r AS (SELECT year(l_shipdate) AS year, p_type AS industry, sum(l_quantity) / 1000 AS mtoe FROM lineitem JOIN part ON l_partkey = p_partkey WHERE year(l_shipdate) >= 1996 GROUP BY ALL),
t AS (SELECT year(l_shipdate) AS year, p_type AS industry, sum(l_extendedprice) / 1e5 AS pj FROM lineitem JOIN part ON l_partkey = p_partkey WHERE year(l_shipdate) <= 2000 GROUP BY ALL),
shares AS (SELECT coalesce(r.year, t.year) AS year, coalesce(r.industry, t.industry) AS industry, mtoe AS renewable_mtoe, mtoe * 41.868 AS renewable_pj, pj AS total_pj,
  CASE WHEN pj > 0 THEN mtoe * 41.868 / pj * 100 END AS renewable_share_pct FROM r FULL JOIN t ON r.year = t.year AND r.industry = t.industry)"""


def _industry_tables(spark, d):
    """Two wide tables, year as text in the first column, one column per part type."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    line = table(spark, d, "lineitem").select("l_partkey", F.year("l_shipdate").alias("y"), "l_quantity", "l_extendedprice").join(part, "l_partkey")

    def wide(rows, label, value):
        return rows.groupBy(F.col("y").cast("string").alias(label)).pivot("p_type", list(s.PART_TYPES)).agg(value)

    return (wide(line.where(F.col("y") >= 1996), "industry", F.sum("l_quantity") / 1000),
            wide(line.where(F.col("y") <= 2000), "industry_name", F.sum("l_extendedprice") / 1e5))


def _industry_shares(spark, d):
    r, t = _industry_tables(spark, d)
    return f.renewable_share_by_industry(r, t, s.PART_TYPES)


@query("renewable_share_by_industry_b6", "year:i industry:s renewable_mtoe:4 renewable_pj:4 total_pj:4 renewable_share_pct:4", f"WITH {INDUSTRY_SQL} SELECT * FROM shares")
def _(spark, d):
    return _industry_shares(spark, d)


RECON_SQL = """o AS (SELECT year(o_orderdate) AS year, o_orderpriority AS metric, sum(o_totalprice) AS a FROM orders WHERE year(o_orderdate) < 2001 GROUP BY ALL),
l AS (SELECT year(o_orderdate) AS year, o_orderpriority AS metric, sum(o_totalprice + CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS b FROM orders WHERE year(o_orderdate) > 1995 GROUP BY ALL),
recon AS (SELECT coalesce(o.year, l.year) AS year, coalesce(o.metric, l.metric) AS metric, a AS desnz_pj, b AS ons_pj, abs(a - b) AS abs_diff FROM o FULL JOIN l ON o.year = l.year AND o.metric = l.metric)"""


def _recon(spark, d):
    o = table(spark, d, "orders").select(F.year("o_orderdate").alias("y"), "o_orderpriority", "o_totalprice", "o_orderstatus")
    bumped = o.withColumn("o_totalprice", F.col("o_totalprice") + F.when(F.col("o_orderstatus") == "P", 1.0).otherwise(0.0))

    def wide(rows):
        return rows.groupBy(F.col("y").cast("string").alias("industry_name")).pivot("o_orderpriority", list(s.PRIORITIES)).agg(F.sum("o_totalprice"))

    return f.reconciliation(wide(o.where(F.col("y") < 2001)), wide(bumped.where(F.col("y") > 1995)))


@query("reconciliation_b7_j5", "year:i metric:s desnz_pj:2 ons_pj:2 abs_diff:2", f"WITH {RECON_SQL} SELECT * FROM recon")
def _(spark, d):
    return _recon(spark, d)


@query("renewable_heat_annual_b8", "year:i component:s value_mtoe:4", f"""WITH {s.FUELS_SQL} SELECT year, 'coal' AS component, coal AS value_mtoe FROM fuels UNION ALL SELECT year, 'gas', gas FROM fuels
UNION ALL SELECT year, 'oil', oil FROM fuels""")
def _(spark, d):
    g = f.generation_annual(s.quarterly(spark, d)).select("year", "coal", "gas", "oil")
    return f.renewable_heat_annual(g.withColumn("raw__coal", F.lit("x")))


@query("cumulative_to_annual_b9", "technology:s year:i cumulative_payments_gbpm:4 new_cumulative_payments_gbpm:4", f"""WITH {s.YEARLY_ORDERS_SQL}
SELECT technology, year, cum_amount AS cumulative_payments_gbpm, amount AS new_cumulative_payments_gbpm FROM levels""")
def _(spark, d):
    return cumulative_long_to_annual(s.cumulative_orders(spark, d), ["technology"], "date", "cumulative_payments_gbpm")


def _wide_cumulative(spark, d, value, drop_technology=None):
    """Wide cumulative table with text labels: one column per technology."""
    names = dict(zip(s.PRIORITIES, ("air_source_heat_pump", "biomass", "ground_source_heat_pump", "solar_thermal")))
    c = s.cumulative_orders(spark, d)
    keep = {t: n for t, n in names.items() if t != drop_technology}
    return c.groupBy(F.date_format("date", "dd-MM-yyyy").alias("unnamed_0")).agg(*[F.max(F.when(F.col("technology") == t, F.col(value))).alias(n) for t, n in keep.items()])


UNIT_SQL = f"""{s.YEARLY_ORDERS_SQL}, unit AS (SELECT CASE technology WHEN '1-URGENT' THEN 'air_source_heat_pump' WHEN '2-HIGH' THEN 'biomass' WHEN '3-MEDIUM' THEN 'ground_source_heat_pump' ELSE 'solar_thermal' END AS technology,
year, cum_installs AS cumulative_installs, installs AS new_cumulative_installs, CASE WHEN technology <> '2-HIGH' THEN cum_amount END AS cumulative_payments_gbpm,
CASE WHEN technology <> '2-HIGH' THEN amount END AS new_cumulative_payments_gbpm, CASE WHEN technology <> '2-HIGH' THEN amount * 1e6 / installs END AS cost_per_install_gbp
FROM levels WHERE technology <> '5-LOW')"""


def _unit(spark, d):
    return f.unit_economics(_wide_cumulative(spark, d, "cumulative_payments_gbpm", "2-HIGH"), _wide_cumulative(spark, d, "cumulative_installs"))


@query("unit_economics_b10_j6", "technology:s year:i cumulative_installs:i new_cumulative_installs:i cumulative_payments_gbpm:4 new_cumulative_payments_gbpm:4 cost_per_install_gbp:2", f"WITH {UNIT_SQL} SELECT * FROM unit")
def _(spark, d):
    return _unit(spark, d)


LEARNING_SQL = f"""{s.COUNTRY_SQL}, cap AS (SELECT year, sum(mw) AS mw FROM country WHERE technology = 'ECONOMY' AND iso3_code <> 'N05' GROUP BY 1),
price AS (SELECT year(o_orderdate) AS y, avg(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END) AS a, avg(CASE WHEN o_orderpriority = '2-HIGH' THEN o_totalprice END) AS b FROM orders GROUP BY 1),
pts AS (SELECT y AS calendar_year, y || '/x' AS financial_year, '0_4_kw' AS band, a AS cost, mw FROM price LEFT JOIN cap ON y = year UNION ALL SELECT y, y || '/x', '4_10_kw', b, mw FROM price LEFT JOIN cap ON y = year),
fits AS (SELECT band, regr_slope(ln(cost), ln(mw)) AS slope, regr_intercept(ln(cost), ln(mw)) AS intercept, regr_r2(ln(cost), ln(mw)) AS r2, regr_count(ln(cost), ln(mw)) AS n FROM pts GROUP BY 1)"""


def _learning_points(spark, d):
    country = s.country(spark, d).where(F.col("iso3_code") != "N05")
    o = table(spark, d, "orders").select(F.year("o_orderdate").alias("y"), "o_orderpriority", "o_totalprice")
    costs = o.groupBy(F.concat(F.col("y").cast("string"), F.lit("/x")).alias("financial_year")).agg(
        F.avg(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice"))).alias("0_4_kw_median_kw"),
        F.avg(F.when(F.col("o_orderpriority") == "2-HIGH", F.col("o_totalprice"))).alias("4_10_kw_median_kw"))
    return f.solar_learning(costs, country, technology="ECONOMY")


@query("solar_learning_b11_j7", "financial_year:s calendar_year:i band:s median_cost_gbp_per_kw:4 cum_capacity_mw:2 learning_slope:6 lr_per_doubling:6 r_squared:6 n_obs_band:i", f"""WITH {LEARNING_SQL}
SELECT financial_year, calendar_year, pts.band, cost AS median_cost_gbp_per_kw, mw AS cum_capacity_mw, slope AS learning_slope, 1 - power(2, slope) AS lr_per_doubling, r2 AS r_squared, n AS n_obs_band FROM pts JOIN fits ON pts.band = fits.band""")
def _(spark, d):
    return _learning_points(spark, d)


@query("learning_fit_b12", "p_brand:s slope:6 intercept:6 lr_per_doubling:6 r_squared:6 n_obs:i", """SELECT p_brand, regr_slope(ln(p_retailprice), ln(p_size)) AS slope, regr_intercept(ln(p_retailprice), ln(p_size)) AS intercept,
1 - power(2, regr_slope(ln(p_retailprice), ln(p_size))) AS lr_per_doubling, regr_r2(ln(p_retailprice), ln(p_size)) AS r_squared, count(*) AS n_obs FROM part GROUP BY 1""")
def _(spark, d):
    return fit.learning_fit(table(spark, d, "part").select("p_brand", "p_size", "p_retailprice"), ["p_brand"], "p_size", "p_retailprice")


@query("fitted_curve_b13", "p_brand:s cum_capacity:6 cost_fit:4", """WITH f AS (SELECT p_brand, regr_slope(ln(p_retailprice), ln(p_size)) AS b, regr_intercept(ln(p_retailprice), ln(p_size)) AS a, min(p_size) AS lo, max(p_size) AS hi FROM part GROUP BY 1)
SELECT p_brand, x AS cum_capacity, exp(b * ln(x) + a) AS cost_fit FROM (SELECT *, lo + (hi - lo) * i / CAST(99 AS DOUBLE) AS x FROM f, range(100) t(i))""")
def _(spark, d):
    return fit.fitted_curve(table(spark, d, "part").select("p_brand", "p_size", "p_retailprice"), ["p_brand"], "p_size", "p_retailprice")


VOLATILITY_SQL = """vol AS (SELECT series, year, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max, quantile_cont(value, 0.05) AS p5, quantile_cont(value, 0.95) AS p95, count(*) AS n_obs,
stddev_samp(value) / avg(value) AS cv, quantile_cont(value, 0.95) - quantile_cont(value, 0.05) AS range_p95_p5 FROM (SELECT o_orderpriority AS series, year(o_orderdate) AS year, o_totalprice AS value FROM orders) GROUP BY ALL)"""


def _volatility(spark, d):
    return f.annual_volatility(table(spark, d, "orders").select(F.col("o_orderpriority").alias("series"), F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("value")))


@query("price_volatility_annual_b14", "series:s year:i mean:4 std:4 min:2 max:2 p5:4 p95:4 n_obs:i cv:6 range_p95_p5:4", f"WITH {VOLATILITY_SQL} SELECT * FROM vol")
def _(spark, d):
    return _volatility(spark, d)


@query("price_volatility_wide_b14", "series:s year:i mean:4 cv:6 n_obs:i", """WITH m AS (SELECT date_trunc('month', o_orderdate) AS month, avg(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END) AS electricity_baseload,
avg(CASE WHEN o_orderpriority = '5-LOW' THEN o_totalprice END) AS gas FROM orders GROUP BY 1),
l AS (SELECT 'electricity_baseload' AS series, year(month) AS year, electricity_baseload AS value FROM m UNION ALL SELECT 'gas', year(month), gas FROM m)
SELECT series, year, avg(value) AS mean, stddev_samp(value) / avg(value) AS cv, count(value) AS n_obs FROM l GROUP BY ALL""")
def _(spark, d):
    o = table(spark, d, "orders").select(F.date_format(F.trunc(F.to_date("o_orderdate"), "month"), "yyyy-MM-dd 00:00:00").alias("unnamed_0"), "o_orderpriority", "o_totalprice")
    wide = o.groupBy("unnamed_0").agg(F.avg(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice"))).alias("electricity_baseload"),
                                      F.avg(F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_totalprice"))).alias("gas"))
    return f.price_volatility_annual(wide)


BATTERY_SQL = """m AS (SELECT year(o_orderdate) || '/fy' AS financial_year, month(o_orderdate) AS month, count(*) AS installs, count(*) FILTER (WHERE o_orderstatus = 'P') AS sample,
coalesce(sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END), 0) AS kwh FROM orders GROUP BY ALL)"""


def _battery(spark, d):
    o = table(spark, d, "orders").select(F.concat(F.year("o_orderdate").cast("string"), F.lit("/fy")).alias("financial_year"), F.year("o_orderdate").alias("calendar_year"),
                                         F.month("o_orderdate").alias("month_of_installation_note_5"), "o_orderstatus", "o_totalprice")
    hit = F.col("o_orderstatus") == "P"
    return o.groupBy("financial_year", "calendar_year", "month_of_installation_note_5").agg(
        F.count(F.lit(1)).alias(f.BATTERY_INSTALLS), F.count_if(hit).alias(f.BATTERY_SAMPLE), F.coalesce(F.sum(F.when(hit, F.col("o_totalprice"))), F.lit(0.0)).alias(f.BATTERY_KWH))


@query("battery_monthly_b15", "financial_year:s month_of_installation_note_5:i number_of_installations:i kwh_per_install:4", f"""WITH {BATTERY_SQL}
SELECT financial_year, month AS month_of_installation_note_5, installs AS number_of_installations, CASE WHEN sample > 0 THEN kwh / sample END AS kwh_per_install FROM m""")
def _(spark, d):
    return f.battery_monthly(_battery(spark, d))


@query("battery_annual_b15", "financial_year:s n_installations:i n_in_sample:i total_capacity_sample_kwh:2 kwh_per_install:4", f"""WITH {BATTERY_SQL}
SELECT financial_year, sum(installs) AS n_installations, sum(sample) AS n_in_sample, sum(kwh) AS total_capacity_sample_kwh, sum(kwh) / nullif(sum(sample), 0) AS kwh_per_install FROM m GROUP BY 1""")
def _(spark, d):
    return f.battery_annual(f.battery_monthly(_battery(spark, d)))


INDICATORS = {"1-URGENT": "Acquisitions", "2-HIGH": "Disposals", "3-MEDIUM": "Turnover", "4-NOT SPECIFIED": "Exports", "5-LOW": "Imports"}
COUNTRIES = {"F": "United Kingdom", "O": "Scotland", "P": "Wales"}


def _case(column: str, names: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"


BY_COUNTRY_SQL = f"""bc AS (SELECT {_case('o_orderpriority', INDICATORS)} AS indicator, {_case('o_orderstatus', COUNTRIES)} AS country, sum(o_totalprice) AS value, year(o_orderdate) AS year
FROM orders GROUP BY ALL)"""


def _by_country(spark, d):
    """A sparse sheet: the indicator stands on the first row of its block only, estimates sit in numbered columns."""
    o = table(spark, d, "orders").select(
        F.expr(_case("o_orderpriority", INDICATORS)).alias("ind"), F.expr(_case("o_orderstatus", COUNTRIES)).alias("column_2"), F.year("o_orderdate").alias("y"), "o_totalprice")
    wide = o.groupBy("ind", "column_2").agg(*[
        F.sum(F.when(F.col("y") == FIRST_YEAR + i, F.col("o_totalprice"))).alias("estimate" if i == 0 else f"estimate_{i + 1}") for i in range(N_YEARS)])
    block = F.array_position(F.array(*[F.lit(x) for x in INDICATORS.values()]), F.col("ind")) * 10
    row = F.row_number().over(W.partitionBy("ind").orderBy("column_2"))
    sheet = wide.withColumn("_row", row).withColumn("row_idx", block + F.col("_row")).withColumn("column", F.when(F.col("_row") == 1, F.col("ind")))
    return f.by_country(sheet.drop("ind", "_row"), first_year=FIRST_YEAR, n_years=N_YEARS)


@query("by_country_b16_w6_r2", "indicator:s country:s year:i value:2", f"WITH {BY_COUNTRY_SQL} SELECT * FROM bc")
def _(spark, d):
    return _by_country(spark, d)


INTEGRATED_SQL = f"""{s.SECTORS_SQL}, {s.FUELS_SQL}, {s.COUNTRY_SQL}, {BY_COUNTRY_SQL},
re AS (SELECT year, sum(turnover) AS t, sum(fte) AS f FROM sectors WHERE regexp_matches(sector, 'auto|mach', 'i') GROUP BY 1),
cap AS (SELECT year, mw, CASE WHEN lag(mw) OVER (ORDER BY year) IS NOT NULL THEN greatest(mw - lag(mw) OVER (ORDER BY year), 0) END AS new_mw FROM (SELECT year, sum(mw) AS mw FROM country WHERE iso3_code = 'N05' GROUP BY 1)),
acq AS (SELECT year, value FROM bc WHERE country = 'United Kingdom' AND indicator = 'Acquisitions'), dis AS (SELECT year, value FROM bc WHERE country = 'United Kingdom' AND indicator = 'Disposals'),
integrated AS (SELECT re.year, t AS renewable_turnover_thousand_gbp, f AS renewable_fte, renewable_twh, renewable_twh * 1000 AS renewable_gwh, t / (renewable_twh * 1000) AS turnover_per_gwh_thousand_gbp,
f / renewable_twh AS fte_per_twh, mw AS electricity_installed_capacity_mw, new_mw AS new_capacity_mw, acq.value AS acquisitions_thousand_gbp, dis.value AS disposals_thousand_gbp,
CASE WHEN new_mw > 0 THEN acq.value / new_mw END AS acquisitions_per_new_mw_thousand_gbp
FROM re JOIN generation g ON re.year = g.year LEFT JOIN cap ON re.year = cap.year LEFT JOIN acq ON re.year = acq.year LEFT JOIN dis ON re.year = dis.year)"""


def integrated(spark, d):
    x = s.sectors(spark, d)
    renamed = x.withColumn("sector", F.when(F.col("sector").rlike("(?i)auto|mach"), F.concat(F.col("sector"), F.lit(" renewable"))).otherwise(F.col("sector")))
    return f.integrated_productivity(f.generation_annual(s.quarterly(spark, d)), renamed, _by_country(spark, d), s.country(spark, d).where(F.col("iso3_code") == "N05"))


@query("integrated_productivity_b17_j8", "year:i renewable_turnover_thousand_gbp:2 renewable_fte:2 renewable_twh:4 turnover_per_gwh_thousand_gbp:4 fte_per_twh:4 electricity_installed_capacity_mw:2 new_capacity_mw:2 acquisitions_thousand_gbp:2 disposals_thousand_gbp:2 acquisitions_per_new_mw_thousand_gbp:4",
       f"WITH {INTEGRATED_SQL} SELECT * FROM integrated")
def _(spark, d):
    return integrated(spark, d)


@query("crosswalk_p30", "year:i metric:s source:s value:2 value_unit:s", f"""WITH {s.COUNTRY_SQL}, {s.YEARLY_ORDERS_SQL}
SELECT year, 'electricity_installed_capacity_mw' AS metric, 'statistics' AS source, sum(mw) AS value, 'MW' AS value_unit FROM country WHERE country = 'NATION_7' GROUP BY 1
UNION ALL SELECT year, 'ofgem_rhi_biomass_installs', 'scheme', cum_installs, 'count' FROM levels WHERE technology = '2-HIGH'
UNION ALL SELECT year(o_orderdate), 'desnz_load_factor_pv', 'tariff', avg(o_totalprice), 'fraction' FROM orders WHERE o_orderstatus = 'F' GROUP BY 1""")
def _(spark, d):
    c = s.country(spark, d).withColumn("country", F.when(F.col("country") == "NATION_7", "United Kingdom").otherwise(F.col("country")))
    return f.crosswalk([
        f.capacity_series(c, "statistics"),
        f.installs_series(_installs(spark, d), "unnamed_0", ["biomass"], "scheme"),
        f.load_factor_series(_load_factors(spark, d).select("year", "pv"), "tariff")])


@query("turnover_against_fte_p31_j13", "year:i sector:s turnover_per_fte:4", f"""WITH {s.SECTORS_SQL} SELECT year, sector, turnover / fte AS turnover_per_fte FROM sectors""")
def _(spark, d):
    x = s.sectors(spark, d)
    a = x.select(F.col("year").alias("reference_year"), F.col("sector").alias("sector_name"), F.col("turnover_thousand_gbp").alias("value_uk"))
    return f.turnover_against_fte(a, x.select("year", "sector", F.col("fte").alias("uk")))
