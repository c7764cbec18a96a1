"""Benchmark and brief queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.operators import cleaning
from statloom.operators.series import best_split, bootstrap_growth, change_points, mean_shift, rolling_volatility, volatility_matrix
from statloom.plans import benchmarks as b
from statloom.plans import facts as f
from workload import cells, facts, profiles
from workload import shapes as s
from workload.base import query, table

MW, GWH = facts.MW, facts.GWH


def _factors(spark, d):
    return f.capacity_factor(s.country(spark, d))


@query("group_weighted_factor_q1", "technology:s year:i gwh:2 mw:2 capacity_factor_weighted:6", f"""WITH {s.COUNTRY_SQL}
SELECT technology, year, sum(gwh) AS gwh, sum(mw) AS mw, sum(gwh) / (sum(mw) * {s.hours_sql()} / 1000.0) AS capacity_factor_weighted FROM country GROUP BY 1, 2""")
def _(spark, d):
    return b.group_weighted_factor(s.country(spark, d), ["technology", "year"]).withColumnsRenamed({GWH: "gwh", MW: "mw"})


@query("bootstrap_growth_q2", "technology:s cagr:6 cagr_low:6 cagr_high:6", f"""WITH {s.YEARLY_ORDERS_SQL},
st AS (SELECT technology, year, amount, amount / lag(amount) OVER (PARTITION BY technology ORDER BY year) AS r FROM yearly),
per AS (SELECT technology, list(ln(r) ORDER BY year) FILTER (WHERE r IS NOT NULL) AS logs, min(year) AS y0, max(year) AS y1, min_by(amount, year) AS v0, max_by(amount, year) AS v1 FROM st GROUP BY 1),
d AS (SELECT technology, v0, v1, y1 - y0 AS span, rep, (SELECT sum(logs[CAST(('0x' || substr(md5('42-' || rep || '-' || i), 1, 8))::BIGINT % len(logs) AS BIGINT) + 1]) FROM range(1, len(logs) + 1) t(i)) AS total FROM per, range(1, 401) z(rep)),
c AS (SELECT technology, power(v1 / v0, 1.0 / span) - 1 AS cagr, power(v0 * exp(total) / v0, 1.0 / span) - 1 AS boot FROM d)
SELECT technology, max(cagr) AS cagr, quantile_cont(boot, 0.025) AS cagr_low, quantile_cont(boot, 0.975) AS cagr_high FROM c GROUP BY 1""")
def _(spark, d):
    y = s.monthly_orders(spark, d).groupBy("technology", F.year("date").alias("year")).agg(F.sum("amount").alias("amount"))
    return bootstrap_growth(y, ["technology"], "year", "amount")


@query("concentration_q3", "year:i hhi:6", f"""WITH {s.COUNTRY_SQL}, v AS (SELECT year, technology, sum(mw) AS v FROM country GROUP BY ALL)
SELECT year, sum(v * v) / (sum(v) * sum(v)) AS hhi FROM v GROUP BY 1""")
def _(spark, d):
    return b.concentration(s.country(spark, d))


@query("top_countries_q4", "country:s iso3_code:s capacity_factor:6", f"""WITH {s.COUNTRY_SQL}
SELECT country, iso3_code, cf AS capacity_factor FROM factors WHERE technology = 'ECONOMY' AND year = 1998 AND mw >= 50 ORDER BY cf DESC, country LIMIT 5""")
def _(spark, d):
    return b.top_countries(_factors(spark, d), "ECONOMY", 1998)


@query("indicator_series_q5", "year:i sdg_7b1_w_per_capita:4", f"WITH {s.COUNTRY_SQL} SELECT year, max(sdg) AS sdg_7b1_w_per_capita FROM country WHERE iso3_code = 'N05' GROUP BY 1")
def _(spark, d):
    return b.indicator_series(s.country(spark, d), "N05")


PEER_SQL = f"""{s.COUNTRY_SQL}, agg AS (SELECT iso3_code, year, max(mw) AS x FROM country WHERE iso3_code IN {s.PEERS} GROUP BY ALL)"""


@query("peer_median_q6", "year:i oecd_benchmark:4", f"WITH {PEER_SQL} SELECT year, median(x) AS oecd_benchmark FROM agg GROUP BY 1")
def _(spark, d):
    return b.peer_benchmark(s.country(spark, d), None, s.PEERS, MW)


@query("peer_weighted_mean_q6_j10", "year:i oecd_benchmark:4", f"""WITH {PEER_SQL}, pop AS (SELECT 'N' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS iso3, count(*) AS population FROM customer GROUP BY 1)
SELECT year, sum(x * population) / sum(population) AS oecd_benchmark FROM agg JOIN pop ON iso3 = iso3_code GROUP BY 1""")
def _(spark, d):
    c = s.country(spark, d)
    pop = table(spark, d, "customer").groupBy(F.concat(F.lit("N"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0")).alias("iso3")).agg(F.count(F.lit(1)).alias("population"))
    return b.peer_benchmark(c, c.select("year").distinct().join(pop.withColumn("year", F.explode(F.sequence(F.lit(1990), F.lit(2010)))), "year"), s.PEERS, MW)


@query("capacity_per_fte_q7_j11", "year:i turnover_per_fte_thousand_gbp:4 mw_per_fte:6", f"""WITH {s.SECTORS_SQL}, {s.COUNTRY_SQL},
x AS (SELECT year, sum(turnover) AS t, sum(fte) AS f FROM sectors WHERE regexp_matches(sector, 'build|mach', 'i') GROUP BY 1), c AS (SELECT year, sum(mw) AS mw FROM country WHERE iso3_code = 'N05' GROUP BY 1)
SELECT x.year, t / f AS turnover_per_fte_thousand_gbp, mw / f AS mw_per_fte FROM x JOIN c ON x.year = c.year""")
def _(spark, d):
    cap = s.country(spark, d).where(F.col("iso3_code") == "N05").groupBy("year").agg(F.sum(MW).alias("mw_total"))
    return b.capacity_per_fte(s.sectors(spark, d), cap, ("build", "mach"))


@query("global_generation_q8", "year:i global_generation_gwh:2", f"WITH {s.COUNTRY_SQL} SELECT year, sum(gwh) AS global_generation_gwh FROM country WHERE group_technology = 'Budget' GROUP BY 1")
def _(spark, d):
    world = s.country(spark, d).withColumn("re_or_non_re", F.when(F.col("group_technology") == "Budget", "Total Renewable").otherwise("Other"))
    return b.global_generation(world)


@query("technology_sheet_q9", "technology:s cagr_capacity:6 cagr_generation:6 rolling_cf_3y_end:6 global_weighted_cf_end:6", f"""WITH {s.COUNTRY_SQL},
own AS (SELECT * FROM factors WHERE iso3_code = 'N05' AND year BETWEEN 1996 AND 2000),
e AS (SELECT technology, power(max_by(mw, year) / min_by(mw, year), 1.0 / 4) - 1 AS cagr_capacity, power(max_by(gwh, year) / min_by(gwh, year), 1.0 / 4) - 1 AS cagr_generation FROM own GROUP BY 1),
r AS (SELECT technology, max_by(roll, year) AS roll FROM (SELECT technology, year, avg(cf) OVER (PARTITION BY technology ORDER BY year ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS roll FROM own) GROUP BY 1),
g AS (SELECT technology, sum(gwh) / (sum(mw) * 8784 / 1000.0) AS cf FROM country WHERE year = 2000 GROUP BY 1)
SELECT e.*, roll AS rolling_cf_3y_end, g.cf AS global_weighted_cf_end FROM e JOIN r ON e.technology = r.technology JOIN g ON e.technology = g.technology""")
def _(spark, d):
    c = s.country(spark, d)
    return b.technology_sheet(c.where(F.col("iso3_code") == "N05"), c, 1996, 2000)


@query("renewable_sectors_q10", "year:i renewable_turnover_thousand_gbp:2 renewable_fte:2", f"""WITH {s.SECTORS_SQL}
SELECT year, sum(turnover) AS renewable_turnover_thousand_gbp, sum(fte) AS renewable_fte FROM sectors WHERE regexp_matches(sector, 'build|furn', 'i') GROUP BY 1""")
def _(spark, d):
    return f.renewable_sectors(s.sectors(spark, d), ("build", "furn"))


QUEUE_SQL = """q AS (SELECT date_trunc('month', o_orderdate) AS date, count(*) AS received, count(*) FILTER (WHERE o_orderstatus = 'F') AS processed,
count(*) FILTER (WHERE o_orderstatus = 'P') AS queue FROM orders WHERE year(o_orderdate) >= 2000 GROUP BY 1)"""


def _queue_table(spark, d):
    o = table(spark, d, "orders").where(F.year("o_orderdate") >= 2000)
    return o.groupBy(F.date_format("o_orderdate", "MMM-yy").alias("unnamed_0")).agg(
        F.count(F.lit(1)).alias("received"), F.count_if(F.col("o_orderstatus") == "F").alias("processed"), F.count_if(F.col("o_orderstatus") == "P").alias("queue"))


@query("application_queue_q11", "date:d received:i processed:i queue:i", f"WITH {QUEUE_SQL} SELECT * FROM q")
def _(spark, d):
    return b.application_queue(_queue_table(spark, d))


def _actuals(spark, d):
    x = _queue_table(spark, d).select("unnamed_0", (F.col("processed") * 100.0 / F.col("received")).alias("domestic_rhi"), (F.col("queue") * 100.0 / F.col("received")).alias("non_domestic_rhi"))
    return b.scheme_actuals(x)


@query("scheme_actuals_q11", "date:d series:s pct:4", f"""WITH {QUEUE_SQL} SELECT date, 'domestic_rhi' AS series, processed * 100.0 / received AS pct FROM q
UNION ALL SELECT date, 'non_domestic_rhi', queue * 100.0 / received FROM q""")
def _(spark, d):
    return _actuals(spark, d)


@query("heat_per_install_q12_j12", "year:i heat_mtoe:4 cumulative_total:i heat_mtoe_per_install:8", f"""WITH {s.FUELS_SQL}, {s.YEARLY_ORDERS_SQL}
SELECT fuels.year, coal AS heat_mtoe, cum_installs AS cumulative_total, coal / cum_installs AS heat_mtoe_per_install FROM fuels JOIN levels ON fuels.year = levels.year WHERE technology = '2-HIGH'""")
def _(spark, d):
    heat = f.generation_annual(s.quarterly(spark, d)).select("year", F.col("coal").alias("heat_energy_from_renewable_sources"))
    return f.heat_per_install(heat, facts._installs(spark, d), "unnamed_0", "biomass")


SHIFT_SQL = f"""{s.DAILY_SQL}, sh AS (SELECT event_type, avg(value) FILTER (WHERE day(day) < 16) AS m0, avg(value) FILTER (WHERE day(day) >= 16) AS m1, count(*) FILTER (WHERE day(day) < 16) AS n0,
count(*) FILTER (WHERE day(day) >= 16) AS n1, var_samp(value) FILTER (WHERE day(day) < 16) AS v0, var_samp(value) FILTER (WHERE day(day) >= 16) AS v1 FROM daily GROUP BY 1)"""


@query("mean_shift_q13", "event_type:s mean_pre:6 mean_post:6 n_pre:i n_post:i t_statistic:5 welch_df:5", f"""WITH {SHIFT_SQL}
SELECT event_type, m0 AS mean_pre, m1 AS mean_post, n0 AS n_pre, n1 AS n_post, (m0 - m1) / sqrt(v0 / n0 + v1 / n1) AS t_statistic,
(v0 / n0 + v1 / n1) * (v0 / n0 + v1 / n1) / ((v0 / n0) * (v0 / n0) / (n0 - 1) + (v1 / n1) * (v1 / n1) / (n1 - 1)) AS welch_df FROM sh""")
def _(spark, d):
    x = s.daily_events(spark, d).withColumn("t", F.dayofmonth("day"))
    return mean_shift(x, ["event_type"], "t", "value", 16, with_p=False)


@query("mean_shift_p_value_q13", "event_type:s p_value_welch:6")
def _(spark, d):
    return mean_shift(s.daily_events(spark, d).withColumn("t", F.dayofmonth("day")), ["event_type"], "t", "value", 16)


@query("best_split_q14", "event_type:s split_at:d gain:5", f"""WITH {s.DAILY_SQL}, r AS (SELECT *, row_number() OVER w - 1 AS n1, sum(value) OVER w - value AS s1, count(*) OVER (PARTITION BY event_type) AS n, sum(value) OVER (PARTITION BY event_type) AS t
FROM daily WINDOW w AS (PARTITION BY event_type ORDER BY day)),
g AS (SELECT event_type, day, power(s1 / n1 - (t - s1) / (n - n1), 2) * n1 * (n - n1) / n AS gain FROM r WHERE n1 >= 2 AND n - n1 >= 2)
SELECT event_type, max_by(day, gain) AS split_at, max(gain) AS gain FROM g GROUP BY 1""")
def _(spark, d):
    return best_split(s.daily_events(spark, d), ["event_type"], "day", "value")


def _stepped(spark, d):
    """Monthly order counts per priority, with steps put in by the month."""
    m = s.monthly_orders(spark, d).withColumn("t", F.floor(F.months_between("date", F.lit("1995-01-01").cast("date"))).cast("int"))
    return m.withColumn("value", F.col("installs") + F.when(F.col("t") >= 40, 5.0 * F.col("installs")).otherwise(0.0) + F.when(F.col("t") >= 60, 9.0 * F.col("installs")).otherwise(0.0))


@query("change_points_q14", "technology:s segment_start:i position:i")
def _(spark, d):
    return change_points(_stepped(spark, d), ["technology"], "t", "value", penalty=6.0)


@query("coerce_and_roll_q15", "event_type:s day:d rolling_cv:6", f"""WITH {s.DAILY_SQL}
SELECT event_type, day, CASE WHEN n >= 3 AND m > 0 THEN sd / m END AS rolling_cv FROM (SELECT event_type, day, avg(value) OVER w AS m, stddev_samp(value) OVER w AS sd, count(value) OVER w AS n FROM daily
WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))""")
def _(spark, d):
    return rolling_volatility(s.daily_events(spark, d), ["event_type"], "day", "value", 7)


LABELS = {label: label.replace(" ", "_") for label in s.PRIORITIES}


@query("volatility_matrix_q15_r3", "year:i " + " ".join(f"{name}:6" for name in LABELS.values()), f"WITH {facts.VOLATILITY_SQL} SELECT year, "
       + ", ".join(f"""max(CASE WHEN series = '{label}' THEN cv END) AS "{name}" """ for label, name in LABELS.items()) + " FROM vol GROUP BY 1")
def _(spark, d):
    return volatility_matrix(facts._volatility(spark, d), list(s.PRIORITIES)).withColumnsRenamed(LABELS)


@query("capacity_by_year_technology_q16", "year:i technology:s mw:2", f"WITH {s.COUNTRY_SQL} SELECT year, technology, sum(mw) AS mw FROM country GROUP BY 1, 2")
def _(spark, d):
    return b.capacity_by_year_technology(s.country(spark, d)).withColumnRenamed(MW, "mw")


@query("top_countries_latest_year_q16", "country:s mw:2", f"""WITH {s.COUNTRY_SQL} SELECT country, sum(mw) AS mw FROM country WHERE year = (SELECT max(year) FROM country) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def _(spark, d):
    return b.top_countries_latest_year(s.country(spark, d)).withColumnRenamed(MW, "mw")


@query("five_numbers_q16", "technology:s min:6 q1:6 median:6 q3:6 max:6", f"""WITH {s.COUNTRY_SQL} SELECT technology, min(cf) AS min, quantile_cont(cf, 0.25) AS q1, median(cf) AS median, quantile_cont(cf, 0.75) AS q3, max(cf) AS max
FROM factors WHERE abs(cf) <= 1.5 GROUP BY 1""")
def _(spark, d):
    return b.five_numbers(_factors(spark, d), ["technology"])


@query("median_factor_matrix_q16", "year:i ECONOMY:3 SMALL:3", f"""WITH {s.COUNTRY_SQL} SELECT year, median(CASE WHEN technology = 'ECONOMY' THEN cf END) AS "ECONOMY", median(CASE WHEN technology = 'SMALL' THEN cf END) AS "SMALL"
FROM factors WHERE abs(cf) <= 1.5 GROUP BY 1""")
def _(spark, d):
    return b.median_factor_matrix(_factors(spark, d), ["ECONOMY", "SMALL"])


@query("factor_trend_q17_w4", "technology:s year:i rolling_3:6", f"""WITH {facts.FACT_SQL} SELECT technology, year, avg(capacity_factor_calc) OVER (PARTITION BY technology ORDER BY year ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS rolling_3
FROM fact WHERE abs(capacity_factor_calc) <= 1.5""")
def _(spark, d):
    return b.factor_trend(facts._fact(spark, d))


@query("installs_long_q17_f11", "year:i rhi_technology:s installs:i", f"""WITH {facts.FACT_SQL}, u AS (SELECT DISTINCT year, rhi_air_source_heat_pump AS a, rhi_biomass AS b FROM fact)
SELECT year, 'rhi_air_source_heat_pump' AS rhi_technology, a AS installs FROM u WHERE a IS NOT NULL UNION ALL SELECT year, 'rhi_biomass', b FROM u WHERE b IS NOT NULL""")
def _(spark, d):
    return b.installs_long(facts._fact(spark, d))


PROD_SQL = f"""{s.SECTORS_SQL}, prod AS (SELECT sector, year, turnover, fte, turnover / fte AS ratio, turnover / fte - lag(turnover / fte, 3) OVER (PARTITION BY sector ORDER BY year) AS delta FROM sectors)"""


def _prod(spark, d):
    x = s.sectors(spark, d)
    return f.productivity(x.drop("fte"), x.drop("turnover_thousand_gbp"))


@query("productivity_counters_q18", "n_sectors:i n_years:i median_turnover_per_fte:4", f"WITH {PROD_SQL} SELECT count(DISTINCT sector) AS n_sectors, count(DISTINCT year) AS n_years, median(ratio) AS median_turnover_per_fte FROM prod")
def _(spark, d):
    return b.productivity_counters(_prod(spark, d))


@query("yearly_productivity_q18", "year:i turnover_thousand_gbp:2 fte:2 turnover_per_fte_thousand_gbp:4", f"""WITH {PROD_SQL} SELECT year, sum(turnover) AS turnover_thousand_gbp, sum(fte) AS fte, sum(turnover) / sum(fte) AS turnover_per_fte_thousand_gbp FROM prod GROUP BY 1""")
def _(spark, d):
    return b.yearly_productivity(_prod(spark, d))


@query("latest_snapshot_q18_t3", "sector:s turnover_thousand_gbp:1 fte:1 turnover_per_fte_thousand_gbp:1 turnover_per_fte_3y_delta:1", f"""WITH {PROD_SQL} SELECT sector, turnover AS turnover_thousand_gbp, fte, ratio AS turnover_per_fte_thousand_gbp, delta AS turnover_per_fte_3y_delta
FROM prod WHERE year = (SELECT max(year) FROM prod)""")
def _(spark, d):
    return b.latest_snapshot(_prod(spark, d))


@query("reconciliation_verdict_q19", "rows_compared:i max_abs_diff:2 all_identical:b", f"WITH {facts.RECON_SQL} SELECT count(*) AS rows_compared, max(abs_diff) AS max_abs_diff, coalesce(max(abs_diff), 0) = 0 AS all_identical FROM recon")
def _(spark, d):
    return b.reconciliation_verdict(facts._recon(spark, d))


@query("worst_differences_q19", "year:i metric:s abs_diff:2", f"WITH {facts.RECON_SQL} SELECT year, metric, abs_diff FROM recon WHERE abs_diff > 0")
def _(spark, d):
    return b.worst_differences(facts._recon(spark, d))


@query("headline_q20", "renewable_share_pct:4 weighted_capacity_factor:6 productivity_year:i turnover_per_gwh_thousand_gbp:4 fte_per_twh:4", f"""WITH {facts.INTEGRATED_SQL},
w AS (SELECT year, sum(gwh) / (sum(mw) * {s.hours_sql()} / 1000.0) AS cf FROM country WHERE iso3_code = 'N05' GROUP BY 1),
ok AS (SELECT * FROM integrated WHERE renewable_fte >= 0.4 * (SELECT median(renewable_fte) FROM integrated))
SELECT (SELECT max_by(renewable_share_pct, year) FROM generation) AS renewable_share_pct, (SELECT max_by(cf, year) FROM w) AS weighted_capacity_factor, max(year) AS productivity_year,
max_by(turnover_per_gwh_thousand_gbp, year) AS turnover_per_gwh_thousand_gbp, max_by(fte_per_twh, year) AS fte_per_twh FROM ok""")
def _(spark, d):
    own = s.country(spark, d).where(F.col("iso3_code") == "N05")
    return b.headline(f.generation_annual(s.quarterly(spark, d)), own, facts.integrated(spark, d))


@query("top_industries_q21", "industry:s year:i renewable_share_pct:4", f"""WITH {facts.INDUSTRY_SQL}, top AS (SELECT industry, avg(renewable_share_pct) AS m FROM shares GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3)
SELECT industry, year, renewable_share_pct FROM shares WHERE industry IN (SELECT industry FROM top)""")
def _(spark, d):
    return b.top_industries(facts._industry_shares(spark, d), 3)


CPI_SQL = "cpi AS (SELECT year(o_orderdate) AS cy, 60 + count(DISTINCT o_orderpriority) + year(o_orderdate) - 1995 AS i FROM orders WHERE year(o_orderdate) <= 2000 GROUP BY 1)"


def _cpi(spark, d):
    o = table(spark, d, "orders").where(F.year("o_orderdate") <= 2000).groupBy(F.year("o_orderdate").alias("year"))
    return o.agg(F.count_distinct("o_orderpriority").alias("k")).select("year", (F.lit(60.0) + F.col("k") + F.col("year") - 1995).alias("cpi_index_2024_base"))


@query("real_cost_fits_q22", "band:s slope:6 intercept:6 r_squared:6 n_obs:i", f"""WITH {facts.LEARNING_SQL}, {CPI_SQL}, real AS (SELECT band, mw, cost * coalesce(100.0 / i, 1) AS cost FROM pts LEFT JOIN cpi ON calendar_year = cy)
SELECT band, regr_slope(ln(cost), ln(mw)) AS slope, regr_intercept(ln(cost), ln(mw)) AS intercept, regr_r2(ln(cost), ln(mw)) AS r_squared, regr_count(ln(cost), ln(mw)) AS n_obs FROM real GROUP BY 1""")
def _(spark, d):
    return b.real_cost_fits(facts._learning_points(spark, d), _cpi(spark, d))


@query("real_unit_costs_q22", "technology:s year:i cost_real:2", f"WITH {facts.UNIT_SQL}, {CPI_SQL} SELECT technology, year, cost_per_install_gbp * coalesce(100.0 / i, 1) AS cost_real FROM unit LEFT JOIN cpi ON year = cy")
def _(spark, d):
    return b.real_unit_costs(facts._unit(spark, d), _cpi(spark, d))


@query("acquisitions_against_prices_q23_j14", "year:i acquisitions_thousand_gbp:2 gas_cv:6", f"""WITH {facts.BY_COUNTRY_SQL}, {facts.VOLATILITY_SQL}
SELECT bc.year, value AS acquisitions_thousand_gbp, cv AS gas_cv FROM bc JOIN vol ON bc.year = vol.year WHERE country = 'United Kingdom' AND indicator = 'Acquisitions' AND series = '5-LOW'""")
def _(spark, d):
    return b.acquisitions_against_prices(facts._by_country(spark, d), facts._volatility(spark, d), "5-LOW")


@query("risk_flags_q24", "flag:s", f"""WITH {s.DAILY_SQL}, {s.SECTORS_SQL}, {QUEUE_SQL},
one AS (SELECT value, row_number() OVER (ORDER BY day DESC) AS rn FROM daily WHERE event_type = 'click'),
sec AS (SELECT fte, row_number() OVER (ORDER BY year DESC) AS rn FROM sectors WHERE sector = 'BUILDING'),
roll AS (SELECT day, stddev_samp(value) OVER w / avg(value) OVER w AS cv FROM daily WHERE event_type = 'view' WINDOW w AS (ORDER BY day ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
lastq AS (SELECT max_by(queue, date) AS q, max_by(queue * 100.0 / received, date) AS pct FROM q)
SELECT 'performance' AS flag WHERE (SELECT max(CASE WHEN rn = 5 THEN value END) - max(CASE WHEN rn = 1 THEN value END) FROM one) > -100
UNION ALL SELECT 'employment' WHERE (SELECT max(CASE WHEN rn = 1 THEN fte END) < 0.9 * max(CASE WHEN rn = 3 THEN fte END) FROM sec)
UNION ALL SELECT 'price' WHERE (SELECT max_by(cv, day) FROM roll) > 0.01
UNION ALL SELECT 'regulation' WHERE (SELECT pct >= 1 AND q > 1 FROM lastq)""")
def _(spark, d):
    daily = s.daily_events(spark, d)
    sectors = s.sectors(spark, d).where(F.col("sector") == "BUILDING")
    flags = b.fell_more_than(daily.where(F.col("event_type") == "click"), "day", "value", "performance", drop=-100.0)
    flags = flags.union(b.shrank_below(sectors, "year", "fte", "employment"))
    flags = flags.union(b.volatile_lately(daily.where(F.col("event_type") == "view"), "day", "value", "price", above=0.01))
    return flags.union(b.budget_and_queue(_actuals(spark, d), b.application_queue(_queue_table(spark, d)), "regulation", budget=1.0, waiting=1.0))


@query("factor_matrix_q25", "country:s 1998:6 1999:6", f"""WITH {s.COUNTRY_SQL}, top AS (SELECT country FROM factors WHERE technology = 'ECONOMY' AND year = (SELECT max(year) FROM factors) AND mw >= 50 ORDER BY cf DESC, country LIMIT 5)
SELECT country, max(CASE WHEN year = 1998 THEN cf END) AS "1998", max(CASE WHEN year = 1999 THEN cf END) AS "1999" FROM factors WHERE technology = 'ECONOMY' AND (country IN ('NATION_1', 'NATION_3') OR country IN (FROM top)) GROUP BY 1""")
def _(spark, d):
    return b.factor_matrix(_factors(spark, d), "ECONOMY", ["NATION_1", "NATION_3"], [1998, 1999])


@query("country_against_world_q25", "technology:s country_mean:6 global_median:6", f"""WITH {s.COUNTRY_SQL} SELECT technology, avg(CASE WHEN iso3_code = 'N05' THEN cf END) AS country_mean, median(cf) AS global_median FROM factors
WHERE year = (SELECT max(year) FROM factors) GROUP BY 1 HAVING count(*) FILTER (WHERE iso3_code = 'N05') > 0""")
def _(spark, d):
    return b.country_against_world(_factors(spark, d), "N05")


@query("growth_ladder_q25", "technology:s period:s cagr_capacity:4 cagr_generation:4 cagr_cf:4", f"""WITH {s.COUNTRY_SQL}, y AS (SELECT *, CASE WHEN year <= 1997 THEN '1995-1997' ELSE '1998-2001' END AS period FROM factors WHERE iso3_code = 'N05'),
e AS (SELECT technology, period, max(year) - min(year) AS span, max_by(mw, year) / min_by(mw, year) AS a, max_by(gwh, year) / min_by(gwh, year) AS g, max_by(cf, year) / min_by(cf, year) AS c FROM y GROUP BY ALL HAVING count(*) >= 2)
SELECT technology, period, power(a, 1.0 / span) - 1 AS cagr_capacity, power(g, 1.0 / span) - 1 AS cagr_generation, power(c, 1.0 / span) - 1 AS cagr_cf FROM e""")
def _(spark, d):
    yearly = b.yearly_technology_factors(s.country(spark, d).where(F.col("iso3_code") == "N05"))
    return b.growth_ladder(yearly, {"1995-1997": (1995, 1997), "1998-2001": (1998, 2001)})


@query("indicator_by_prefix_q26", "country:s year:i value:2", f"WITH {facts.BY_COUNTRY_SQL} SELECT country, year, value FROM bc WHERE starts_with(indicator, 'Turn')")
def _(spark, d):
    return b.indicator_by_prefix(facts._by_country(spark, d), "Turn")


@query("biomass_by_year_q26", "year:i bio_mtoe:4", "WITH m AS (SELECT year(l_shipdate) AS year, sum(CASE WHEN p_type = 'SMALL' THEN l_quantity END) / 1000 AS a, sum(CASE WHEN p_type = 'LARGE' THEN l_quantity END) / 1000 AS b FROM lineitem JOIN part ON l_partkey = p_partkey WHERE year(l_shipdate) >= 1996 GROUP BY 1) SELECT year, coalesce(a, 0) + coalesce(b, 0) AS bio_mtoe FROM m")
def _(spark, d):
    return b.biomass_by_year(facts._industry_tables(spark, d)[0], ("SMALL", "LARGE"))


@query("sector_series_q26", "sector:s year:i fte:2", f"WITH {s.SECTORS_SQL} SELECT sector, year, fte FROM sectors WHERE regexp_matches(sector, 'mach', 'i')")
def _(spark, d):
    return b.sector_series(s.sectors(spark, d), "mach")


def _issues(spark, d):
    return cleaning.clean_table(cells._dirty_customers(spark, d), "customers.xls", "Sheet 1").issues


@query("issue_browser_q27", "column:s issue_code:s rows_affected:i", f"SELECT * FROM ({cells.ISSUES_SQL}) WHERE issue_code IN ('placeholder_to_na', 'numeric_sentinel')")
def _(spark, d):
    return b.browse_issues(_issues(spark, d), ["placeholder_to_na", "numeric_sentinel"], ["customers.xls"])


@query("contract_violations_q27", "issue_code:s n:i", "SELECT 'schema_contract_violation' AS issue_code, count(*) FILTER (WHERE o_totalprice > 400000) AS n FROM orders")
def _(spark, d):
    from statloom.operators.contract import check_table

    spec = {"workbook": "o.xlsx", "sheet": "m", "numeric_columns": {"o_totalprice": {"max": 400000}}}
    rows = b.contract_violations(check_table(table(spark, d, "orders").select("o_totalprice"), spec, spark))
    return rows.groupBy("issue_code").agg(F.sum("rows_affected").alias("n"))


@query("catalog_browser_q27", "sheet_id:s tier:s", f"WITH {profiles.CATALOG_SQL} SELECT sheet_id, tier FROM tiered WHERE publisher = 'sales' AND tier = 'T1'")
def _(spark, d):
    return b.browse_catalog(profiles._catalog(spark, d), ["sales"], ["T1"])


@query("yearly_technology_factors_q28", "year:i technology:s hours:i cf:6", f"""WITH {s.COUNTRY_SQL} SELECT year, technology, {s.hours_sql()} AS hours, sum(gwh) / (sum(mw) * {s.hours_sql()} / 1000.0) AS cf FROM country GROUP BY 1, 2""")
def _(spark, d):
    return b.yearly_technology_factors(s.country(spark, d))


@query("capacity_before_after_q28", "year:i mw:2 period:s", f"WITH {s.COUNTRY_SQL} SELECT year, sum(mw) AS mw, CASE WHEN year < 1998 THEN 'before' ELSE 'from' END AS period FROM country GROUP BY 1")
def _(spark, d):
    return b.capacity_before_after(s.country(spark, d), 1998).withColumnRenamed(MW, "mw")


def _load(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("technology"), F.concat(F.year("o_orderdate").cast("string"), F.lit("/fy")).alias("financial_year"), "o_totalprice")
    return b.load_factor_series(o.groupBy("technology", "financial_year").agg(F.avg("o_totalprice").alias("weighted_mean")))


@query("load_factor_shift_q29", "technology:s mean_pre:4 mean_post:4 n_pre:i n_post:i t_statistic:5", """WITH lf AS (SELECT o_orderpriority AS technology, year(o_orderdate) AS y, avg(o_totalprice) AS v FROM orders GROUP BY ALL),
g AS (SELECT technology, avg(v) FILTER (WHERE y < 1998) AS m0, avg(v) FILTER (WHERE y >= 1998) AS m1, count(*) FILTER (WHERE y < 1998) AS n0, count(*) FILTER (WHERE y >= 1998) AS n1,
var_samp(v) FILTER (WHERE y < 1998) AS v0, var_samp(v) FILTER (WHERE y >= 1998) AS v1 FROM lf GROUP BY 1)
SELECT technology, m0 AS mean_pre, m1 AS mean_post, n0 AS n_pre, n1 AS n_post, (m0 - m1) / sqrt(v0 / n0 + v1 / n1) AS t_statistic FROM g""")
def _(spark, d):
    return b.load_factor_shifts(_load(spark, d), 1998, 7)


@query("load_factor_breaks_q29", "technology:s segment_start:i position:i")
def _(spark, d):
    return b.load_factor_breaks(_load(spark, d), penalty=1.5, min_points=7)


@query("issue_counters_q30", "confidence:s n_issues:i rows_affected:i", f"""SELECT CASE WHEN issue_code IN ('footnote_marker_stripped', 'placeholder_to_na', 'numeric_sentinel', 'unit_embedded_normalized', 'duplicate_row') THEN 'high' WHEN issue_code = 'outlier_robust_log_mad' THEN 'low' ELSE 'medium' END AS confidence,
count(*) AS n_issues, sum(rows_affected) AS rows_affected FROM ({cells.ISSUES_SQL}) WHERE rows_affected > 0 GROUP BY 1""")
def _(spark, d):
    return b.issue_counters(_issues(spark, d))


@query("catalog_counters_q30", "n_sheets:i n_rows:i n_publishers:i", "SELECT 7 AS n_sheets, " + " + ".join(f"(SELECT count(*) FROM {t})" for t in ("customer", "orders", "lineitem", "part", "supplier", "nation", "region")) + " AS n_rows, 3 AS n_publishers")
def _(spark, d):
    return b.catalog_counters(profiles._catalog(spark, d))


@query("share_and_employment_j14", "year:i renewable_share_pct:4 renewable_fte:2", f"""WITH {s.FUELS_SQL}, {s.SECTORS_SQL} SELECT g.year, renewable_share_pct, sum(fte) AS renewable_fte FROM generation g JOIN sectors x ON g.year = x.year WHERE regexp_matches(sector, 'build', 'i') GROUP BY 1, 2""")
def _(spark, d):
    return b.share_and_employment(f.generation_annual(s.quarterly(spark, d)), f.renewable_sectors(s.sectors(spark, d), ("build",)))
