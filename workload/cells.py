"""Cell rules and table cleaning on dirty text made from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from statloom.functions import dates, numbers, stats, text, units
from statloom.functions.nulls import finite
from statloom.operators import cleaning, contract, ordered
from statloom.operators.profile import text_cells
from statloom.plans import landing_run
from statloom.plans.benchmarks import deflate
from statloom.sources import html
from statloom.sources.landing import land
from workload import shapes as s
from workload.base import query, table

KEYS = "l_orderkey:i l_linenumber:i "


def _cells(spark, d) -> DataFrame:
    return s.text_cells_frame(spark, d)


# ---- scalar functions --------------------------------------------------------

@query("clean_text_x1", "c_custkey:i cleaned:s", "SELECT c_custkey, c_mktsegment || ' 12 x' AS cleaned FROM customer")
def _(spark, d):
    dirty = F.concat(F.lit(" <b>"), F.col("c_mktsegment"), F.lit("</b>\u0007 １２ <i>x</i>\t"))
    return table(spark, d, "customer").select("c_custkey", text.clean_text(dirty).alias("cleaned"))


@query("full_nfkc_x1", "c_custkey:i cleaned:s", "SELECT c_custkey, c_mktsegment || ' fi 12 TEL' AS cleaned FROM customer")
def _(spark, d):
    dirty = F.concat(F.lit(" "), F.col("c_mktsegment"), F.lit(" ﬁ １２ ℡"))
    return table(spark, d, "customer").select("c_custkey", text.clean_text(dirty, full_nfkc=True).alias("cleaned"))


@query("placeholder_x2", "is_missing:b n:i", f"WITH {s.CELLS_SQL} SELECT k = 3 AS is_missing, count(*) AS n FROM cells GROUP BY 1")
def _(spark, d):
    return _cells(spark, d).groupBy(text.is_placeholder(F.col("cell")).alias("is_missing")).agg(F.count(F.lit(1)).alias("n"))


@query("numeric_sentinel_x3", "kept:i nulled:i", f"""WITH {s.CELLS_SQL} SELECT count(*) FILTER (WHERE k = 11) AS kept,
count(*) FILTER (WHERE k = 4) AS nulled FROM cells WHERE k IN (4, 11)""")
def _(spark, d):
    x = _cells(spark, d).select(numbers.strict_number(F.col("cell")).alias("x")).where(F.col("x").isNotNull())
    return x.agg(F.count(numbers.drop_sentinel(F.col("x"))).alias("kept"), F.count_if(numbers.drop_sentinel(F.col("x")).isNull()).alias("nulled"))


@query("loose_number_x4", KEYS + "x:4", f"""WITH {s.CELLS_SQL} SELECT l_orderkey, l_linenumber,
CASE k WHEN 10 THEN 1000 + l_quantity WHEN 11 THEN l_quantity END AS x FROM cells""")
def _(spark, d):
    return _cells(spark, d).select("l_orderkey", "l_linenumber", numbers.loose_number(F.col("cell")).alias("x"))


@query("strict_number_x5", KEYS + "x:4", f"""WITH {s.CELLS_SQL} SELECT l_orderkey, l_linenumber,
CASE WHEN regexp_full_match(trim(cell), '[+-]?[0-9]+([.][0-9]*)?') THEN TRY_CAST(cell AS DOUBLE) END AS x FROM cells""")
def _(spark, d):
    return _cells(spark, d).select("l_orderkey", "l_linenumber", numbers.strict_number(F.col("cell")).alias("x"))


@query("footnote_split_x6", KEYS + "flag:s value:s", f"""WITH {s.CELLS_SQL} SELECT l_orderkey, l_linenumber,
CASE WHEN regexp_matches(cell, '\\[\\s*c\\s*\\]', 'i') THEN 'suppressed_confidential' WHEN regexp_matches(cell, '\\[\\s*low\\s*\\]', 'i') THEN 'suppressed_low'
WHEN regexp_matches(cell, '\\[\\s*note\\s*[1-9]\\s*\\]', 'i') THEN 'footnote_' || regexp_extract(cell, 'note\\s*([1-9])', 1) END AS flag,
CASE WHEN regexp_matches(cell, '\\[') THEN trim(regexp_replace(cell, '\\[[^\\]]*\\]', ' ', 'g')) ELSE cell END AS value FROM cells""")
def _(spark, d):
    c = F.col("cell")
    return _cells(spark, d).select("l_orderkey", "l_linenumber", text.footnote_code(c).alias("flag"), text.strip_footnotes(c).alias("value"))


@query("date_reading_x7", KEYS + "status:s date:d", f"""WITH {s.CELLS_SQL} SELECT l_orderkey, l_linenumber,
CASE WHEN k = 3 THEN 'empty' WHEN k = 8 THEN 'ok' WHEN k = 7 AND day(l_shipdate) <= 12 THEN 'ambiguous' WHEN k = 7 THEN 'ok' ELSE 'failed' END AS status,
CASE WHEN k = 8 OR (k = 7 AND day(l_shipdate) > 12) THEN CAST(l_shipdate AS DATE) END AS date FROM cells""")
def _(spark, d):
    return dates.read_dates(_cells(spark, d), "cell").withColumnRenamed("date_status", "status")


@query("best_date_format_x8", "format:s share:6", """SELECT format, share FROM (VALUES ('dd/MM/yyyy'), ('dd-MM-yyyy'), ('yyyy-MM-dd'), ('yyyy/MM/dd'), ('MMM-yy'), ('MMM-yyyy'), ('MMMM yyyy'), ('yyyy'), ('yyyyMM')) AS v(format),
LATERAL (SELECT avg(CASE WHEN v.format = (CASE o_orderkey % 4 WHEN 0 THEN 'MMM-yy' WHEN 1 THEN 'yyyyMM' ELSE 'dd/MM/yyyy' END) THEN 1.0 ELSE 0.0 END) AS share FROM orders) AS s""")
def _(spark, d):
    o = table(spark, d, "orders").select(
        F.when(F.col("o_orderkey") % 4 == 0, F.date_format("o_orderdate", "MMM-yy")).when(F.col("o_orderkey") % 4 == 1, F.date_format("o_orderdate", "yyyyMM"))
        .otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("label"))
    return dates.best_date_format(o, "label")


@query("label_dates_x9", "o_orderkey:i day_first:d month:d quarter:i year:i fy:i", """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day_first,
CAST(date_trunc('month', o_orderdate) AS DATE) AS month, quarter(o_orderdate) AS quarter, year(o_orderdate) AS year, year(o_orderdate) AS fy FROM orders""")
def _(spark, d):
    day = F.to_date("o_orderdate")
    x = table(spark, d, "orders").select(
        "o_orderkey", F.date_format(day, "dd-MM-yyyy").alias("a"), F.date_format(day, "MMM-yy").alias("b"),
        F.concat(F.lit("Q"), F.quarter(day), F.lit(" "), F.year(day)).alias("c"), F.concat(F.year(day), F.lit("/xx")).alias("e"))
    month = dates.month_year_date(F.col("b"))
    q, y = dates.quarter_and_year(F.col("c"))
    return x.select("o_orderkey", dates.day_first_date(F.col("a")).alias("day_first"), month.alias("month"), q.alias("quarter"), y.alias("year"),
                    dates.financial_year_start(F.col("e")).alias("fy"))


@query("embedded_quantity_x10", KEYS + "kind:s value:6", f"""WITH {s.CELLS_SQL} SELECT l_orderkey, l_linenumber, CASE WHEN k IN (5, 6) THEN 'mass_kg' END AS kind,
CASE k WHEN 5 THEN l_quantity WHEN 6 THEN (l_quantity + 0.5) * CAST(0.45359237 AS DOUBLE) END AS value FROM cells""")
def _(spark, d):
    q = units.embedded_quantity(F.col("cell"))
    return _cells(spark, d).select("l_orderkey", "l_linenumber", q["kind"].alias("kind"), q["value"].alias("value"))


@query("fahrenheit_x11", "event_id:i celsius:4", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN (value - 32.0) * 5 / 9 END AS celsius FROM events")
def _(spark, d):
    unit = F.when(F.col("event_id") % 2 == 0, " °F").otherwise(" C")
    cell = F.concat(F.format_string("%.2f", "value"), unit)
    return table(spark, d, "events").select("event_id", units.fahrenheit_cell(cell).alias("celsius"))


@query("canonical_category_x12", "raw:s canonical:s n:i", """SELECT raw, CASE raw WHEN 'U.K.' THEN 'United Kingdom' WHEN 'usa' THEN 'United States'
WHEN 'SOUTH WEST' THEN 'South West' ELSE raw END AS canonical, count(*) AS n FROM (SELECT CASE c_nationkey % 4 WHEN 0 THEN 'U.K.' WHEN 1 THEN 'usa'
WHEN 2 THEN 'SOUTH WEST' ELSE c_mktsegment END AS raw FROM customer) GROUP BY 1, 2""")
def _(spark, d):
    k = F.col("c_nationkey") % 4
    raw = F.when(k == 0, "U.K.").when(k == 1, "usa").when(k == 2, "SOUTH WEST").otherwise(F.col("c_mktsegment"))
    x = table(spark, d, "customer").groupBy(raw.alias("raw")).agg(F.count(F.lit(1)).alias("n"))
    return x.withColumn("canonical", text.canonical_category(F.col("raw")))


@query("snake_name_x13", "p_name:s name:s", "SELECT DISTINCT p_name, replace(p_name, ' ', '_') || '_x' AS name FROM part")
def _(spark, d):
    p = table(spark, d, "part").select("p_name").distinct()
    return p.withColumn("name", text.snake_name(F.concat(F.lit(" "), F.initcap("p_name"), F.lit(" (£X) "))))


@query("output_stem_d21", "s_suppkey:i stem:s", "SELECT s_suppkey, replace(s_name, '#', '_') || '__Table_1_x' AS stem FROM supplier")
def _(spark, d):
    x = table(spark, d, "supplier")
    return x.select("s_suppkey", text.output_stem(F.concat(F.lit("dir/"), F.col("s_name"), F.lit(".xlsx")), F.lit("Table  1 (x)")).alias("stem"))


@query("capacity_factor_flag_x15", "flag:s n:i cf:6", f"""WITH {s.COUNTRY_SQL},
z AS (SELECT (gwh * CASE WHEN technology = 'PROMO' THEN -1 WHEN technology = 'SMALL' THEN 9 ELSE 1 END) / (mw * hours / 1000.0) AS cf FROM factors)
SELECT CASE WHEN cf < 0 THEN 'negative_generation' WHEN abs(cf) > 1.5 THEN 'implausible_factor_gt_1_5' END AS flag, count(*) AS n, sum(cf) AS cf FROM z GROUP BY 1""")
def _(spark, d):
    from statloom.plans.facts import capacity_factor

    g = F.col("electricity_generation_gwh") * F.when(F.col("technology") == "PROMO", -1.0).when(F.col("technology") == "SMALL", 9.0).otherwise(1.0)
    x = capacity_factor(s.country(spark, d).withColumn("electricity_generation_gwh", g))
    return x.groupBy(F.col("capacity_factor_flag").alias("flag")).agg(F.count(F.lit(1)).alias("n"), F.sum("capacity_factor").alias("cf"))


@query("cagr_x16", "technology:s cagr:6", f"""WITH {s.YEARLY_ORDERS_SQL}
SELECT technology, power(max_by(installs, year) / min_by(installs, year), 1.0 / (max(year) - min(year))) - 1 AS cagr FROM yearly GROUP BY 1""")
def _(spark, d):
    from statloom.operators.series import end_to_end_growth

    y = s.monthly_orders(spark, d).groupBy("technology", F.year("date").alias("year")).agg(F.sum("installs").alias("installs"))
    return end_to_end_growth(y, ["technology"], "year", "installs")


@query("deflate_x17", "year:i real:2", """WITH cpi AS (SELECT year(o_orderdate) AS year, 60.0 + count(DISTINCT o_orderstatus) * 10 AS i FROM orders WHERE year(o_orderdate) < 2000 GROUP BY 1)
SELECT year(l_shipdate) AS year, sum(l_extendedprice * coalesce(100.0 / i, 1.0)) AS real FROM lineitem LEFT JOIN cpi ON cpi.year = year(l_shipdate) GROUP BY 1""")
def _(spark, d):
    o = table(spark, d, "orders").where(F.year("o_orderdate") < 2000)
    cpi = o.groupBy(F.year("o_orderdate").alias("year")).agg((F.lit(60.0) + F.count_distinct("o_orderstatus") * 10).alias("cpi_index_2024_base"))
    line = table(spark, d, "lineitem").select(F.year("l_shipdate").alias("year"), "l_extendedprice")
    return deflate(line, "l_extendedprice", "year", cpi, "real").groupBy("year").agg(F.sum("real").alias("real"))


@query("unit_conversion_x18", "p_type:s pj:4 gbp:2 gwh:2", """SELECT p_type, sum(p_size * 41.868) AS pj, sum(p_retailprice * 1000000.0) AS gbp, sum(p_size * 1000.0) AS gwh
FROM part GROUP BY 1""")
def _(spark, d):
    return table(spark, d, "part").groupBy("p_type").agg(
        F.sum(units.mtoe_to_pj(F.col("p_size"))).alias("pj"), F.sum(units.millions(F.col("p_retailprice"))).alias("gbp"), F.sum(units.thousands(F.col("p_size"))).alias("gwh"))


@query("variation_x19", "event_type:s cv:6", "SELECT event_type, stddev_samp(value) / abs(avg(value)) AS cv FROM events GROUP BY 1")
def _(spark, d):
    g = table(spark, d, "events").groupBy("event_type").agg(F.stddev_samp("value").alias("sd"), F.avg("value").alias("m"), F.count("value").alias("n"))
    return g.select("event_type", stats.variation(F.col("sd"), F.col("m"), F.col("n")).alias("cv"))


@query("cell_predicates_x21", "is_text:b is_number:b n:i", f"""WITH {s.CELLS_SQL} SELECT k NOT IN (4, 8, 11) AS is_text, k IN (4, 10, 11) AS is_number, count(*) AS n
FROM cells GROUP BY 1, 2""")
def _(spark, d):
    c = F.col("cell")
    return _cells(spark, d).groupBy(numbers.text_cell(c).alias("is_text"), numbers.numeric_like(c).alias("is_number")).agg(F.count(F.lit(1)).alias("n"))


@query("entropy_gini_x22", "column:s entropy:4 gini:4", """WITH v AS (SELECT p_name, count(*) AS n FROM part GROUP BY 1),
r AS (SELECT n, row_number() OVER (ORDER BY n, p_name) AS i, count(*) OVER () AS k, sum(n) OVER () AS t FROM v)
SELECT 'p_name' AS "column", -sum(n / t * log2(n / t)) AS entropy, 2.0 * sum(i * n) / (max(k) * max(t)) * -1 + (max(k) + 1.0) / max(k) AS g0,
(max(k) + 1 - 2.0 * sum((k + 1 - i) * n) / max(t)) / max(k) AS gini FROM r""")
def _(spark, d):
    from statloom.operators.profile import categorical_profile

    p = categorical_profile(text_cells(table(spark, d, "part"), ["p_name"]), ["column"])
    return p.select("column", F.col("shannon_entropy_bits").alias("entropy"), F.col("gini_concentration").alias("gini"))


@query("finite_x23", "n:i n_finite:i", "SELECT count(*) AS n, count(*) FILTER (WHERE l_tax > 0) AS n_finite FROM lineitem")
def _(spark, d):
    x = F.when(F.col("l_tax") > 0, F.col("l_tax")).otherwise(F.lit(float("inf")))
    return table(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("n"), F.count(finite(x)).alias("n_finite"))


# ---- table cleaning ----------------------------------------------------------

def _dirty_customers(spark, d) -> DataFrame:
    """Text table: a price with notes, placeholders and sentinels, a weight with units, a region, a temperature."""
    c = table(spark, d, "customer")
    bal, k = F.format_string("%.2f", "c_acctbal"), F.col("c_custkey") % 10
    return c.select(
        F.when(k == 0, "n/a").when(k == 1, F.concat(bal, F.lit(" [r]"))).when(k == 2, "999999").when(k == 3, F.concat(F.lit("£"), bal))
        .when(k == 4, F.concat(F.lit("$"), bal)).otherwise(bal).alias("price_gbp"),
        F.when(k < 5, F.concat(F.col("c_nationkey").cast("string"), F.lit(" kg"))).otherwise(F.col("c_nationkey").cast("string")).alias("weight"),
        F.when(k < 3, "usa").when(k < 6, "SOUTH WEST").otherwise("Wales").alias("area"),
        F.concat((F.col("c_nationkey") + 32).cast("string"), F.when(k < 2, " °F").otherwise("")).alias("temp_max"),
        F.col("c_mktsegment").alias("segment"),
    )


DIRTY_SQL = """c AS (SELECT *, c_custkey % 10 AS k FROM customer)"""

ISSUES_SQL = f"""WITH {DIRTY_SQL},
l AS (SELECT x."column", ln(x.v) AS v FROM c, LATERAL (VALUES ('price_gbp', CASE WHEN k IN (1, 5, 6, 7, 8, 9) THEN c_acctbal END), ('weight', CAST(c_nationkey AS DOUBLE)),
  ('temp_max', CASE WHEN k < 2 THEN c_nationkey * 5.0 / 9 ELSE c_nationkey + 32 END)) AS x("column", v) WHERE x.v > 0),
m AS (SELECT "column", median(v) AS med FROM l GROUP BY 1), z AS (SELECT "column", median(abs(v - med)) AS mad FROM l JOIN m USING ("column") GROUP BY 1)
SELECT 'price_gbp' AS "column", 'placeholder_to_na' AS issue_code, count(*) FILTER (WHERE k = 0) AS rows_affected FROM c
UNION ALL SELECT 'price_gbp', 'footnote_marker_stripped', count(*) FILTER (WHERE k = 1) FROM c
UNION ALL SELECT 'price_gbp', 'numeric_sentinel', count(*) FILTER (WHERE k = 2) FROM c
UNION ALL SELECT 'price_gbp', 'multi_currency_detected', count(*) FROM c
UNION ALL SELECT 'price_gbp', 'negative_value_suspicious', count(*) FILTER (WHERE k NOT IN (0, 2, 3, 4) AND c_acctbal < 0) FROM c
UNION ALL SELECT 'weight', 'mixed_type_numeric_string', count(*) FROM c
UNION ALL SELECT 'weight', 'unit_embedded_normalized', count(*) FILTER (WHERE k < 5) FROM c
UNION ALL SELECT 'temp_max', 'temperature_f_to_c', count(*) FILTER (WHERE k < 2) FROM c
UNION ALL SELECT 'temp_max', 'mixed_type_numeric_string', count(*) FROM c
UNION ALL SELECT 'area', 'categorical_canonicalized', count(*) FILTER (WHERE k < 6) FROM c
UNION ALL SELECT '*', 'duplicate_row', coalesce(sum(n) FILTER (WHERE n > 1), 0) FROM (SELECT count(*) AS n FROM (SELECT
  CASE WHEN k = 0 THEN 'n/a' WHEN k = 1 THEN printf('%.2f [r]', c_acctbal) WHEN k = 2 THEN '999999' WHEN k = 3 THEN printf('£%.2f', c_acctbal)
  WHEN k = 4 THEN printf('$%.2f', c_acctbal) ELSE printf('%.2f', c_acctbal) END AS p, c_nationkey, k < 5 AS u,
  CASE WHEN k < 3 THEN 1 WHEN k < 6 THEN 2 ELSE 3 END AS a, k < 2 AS t, c_mktsegment FROM c) GROUP BY p, c_nationkey, u, a, t, c_mktsegment)
UNION ALL SELECT "column", 'outlier_robust_log_mad', count(*) FROM l JOIN m USING ("column") JOIN z USING ("column") WHERE abs(0.6745 * (v - med) / mad) > 3.5 GROUP BY 1"""


@query("issue_register_d6_d17", "column:s issue_code:s rows_affected:i", ISSUES_SQL)
def _(spark, d):
    return cleaning.clean_table(_dirty_customers(spark, d), "customers.xls", "Sheet 1").issues


@query("canonicalisation_log_d15", "column:s from_value:s to_value:s rows_affected:i", f"""WITH {DIRTY_SQL}
SELECT 'area' AS "column", 'usa' AS from_value, 'United States' AS to_value, count(*) FILTER (WHERE k < 3) AS rows_affected FROM c
UNION ALL SELECT 'area', 'SOUTH WEST', 'South West', count(*) FILTER (WHERE k BETWEEN 3 AND 5) FROM c""")
def _(spark, d):
    return cleaning.clean_table(_dirty_customers(spark, d), "customers.xls", "Sheet 1").log


@query("cleaned_table_d5_d18", "area:s weight:4 temp_max:4 price:2 flagged:i n:i shadows:i", f"""WITH {DIRTY_SQL}
SELECT CASE WHEN k < 3 THEN 'United States' WHEN k < 6 THEN 'South West' ELSE 'Wales' END AS area, sum(c_nationkey) AS weight,
sum(CASE WHEN k < 2 THEN c_nationkey * 5.0 / 9 ELSE c_nationkey + 32 END) AS temp_max,
sum(CASE WHEN k IN (1, 5, 6, 7, 8, 9) THEN c_acctbal END) AS price, count(*) FILTER (WHERE k = 1) AS flagged, count(*) AS n, 4 AS shadows
FROM c GROUP BY 1""")
def _(spark, d):
    out = cleaning.clean_table(_dirty_customers(spark, d), "customers.xls", "Sheet 1").table
    shadows = len([c for c in out.columns if c.startswith("raw__")])
    price = numbers.strict_number(F.col("price_gbp"))
    return out.groupBy("area").agg(
        F.sum("weight").alias("weight"), F.sum("temp_max").alias("temp_max"), F.sum(price).alias("price"),
        F.count("price_gbp_flag").alias("flagged"), F.count(F.lit(1)).alias("n"), F.lit(shadows).alias("shadows"))


@query("iso_date_helper_d12", "status:s n:i first:d last:d", f"""WITH {s.CELLS_SQL} SELECT CASE WHEN k = 8 OR (k = 7 AND day(l_shipdate) > 12) THEN 'iso' ELSE 'none' END AS status,
count(*) AS n, min(CASE WHEN k = 8 OR (k = 7 AND day(l_shipdate) > 12) THEN CAST(l_shipdate AS DATE) END) AS first,
max(CASE WHEN k = 8 OR (k = 7 AND day(l_shipdate) > 12) THEN CAST(l_shipdate AS DATE) END) AS last FROM cells GROUP BY 1""")
def _(spark, d):
    ruled = cleaning.apply_rules(_cells(spark, d), {"cell": F.lit(False)}).withColumn("iso", F.col("`cell.iso_date`"))
    return ruled.groupBy(F.when(F.col("iso").isNotNull(), "iso").otherwise("none").alias("status")).agg(
        F.count(F.lit(1)).alias("n"), F.min("iso").alias("first"), F.max("iso").alias("last"))


@query("log_mad_outliers_d16", "column:s n_outlier:i", """WITH x AS (SELECT ln(value) AS l FROM events WHERE value > 0),
m AS (SELECT median(l) AS med FROM x), z AS (SELECT median(abs(l - med)) AS mad FROM x, m)
SELECT 'value' AS "column", count(*) AS n_outlier FROM x, m, z WHERE abs(0.6745 * (l - med) / mad) > 3.5""")
def _(spark, d):
    x = text_cells(table(spark, d, "events"), ["value"])
    return cleaning.log_mad_outliers(cleaning.distinct_values(x, ["column"]), ["column"])


@query("long_mode_cleaning_d7_d18", "sheet:s column:s issue_code:s rows_affected:i", f"""WITH {s.CELLS_SQL},
x AS (SELECT cells.*, o_orderpriority AS sheet FROM cells JOIN orders ON l_orderkey = o_orderkey),
l AS (SELECT sheet, ln(CASE k WHEN 6 THEN (l_quantity + 0.5) * CAST(0.45359237 AS DOUBLE) ELSE l_quantity END) AS v FROM x WHERE k IN (0, 1, 2, 5, 6, 11)),
m AS (SELECT sheet, median(v) AS med FROM l GROUP BY 1), z AS (SELECT sheet, median(abs(v - med)) AS mad FROM l JOIN m USING (sheet) GROUP BY 1)
SELECT sheet, 'cell' AS "column", 'footnote_marker_stripped' AS issue_code, count(*) AS rows_affected FROM x WHERE k IN (0, 1, 2) GROUP BY 1
UNION ALL SELECT sheet, 'cell', 'placeholder_to_na', count(*) FROM x WHERE k = 3 GROUP BY 1
UNION ALL SELECT sheet, 'cell', 'numeric_sentinel', count(*) FROM x WHERE k = 4 GROUP BY 1
UNION ALL SELECT sheet, 'cell', 'unit_embedded_normalized', count(*) FROM x WHERE k IN (5, 6) GROUP BY 1
UNION ALL SELECT sheet, 'cell', 'date_normalized_iso8601', count(*) FROM x WHERE k = 8 OR (k = 7 AND day(l_shipdate) > 12) GROUP BY 1
UNION ALL SELECT sheet, 'cell', 'ambiguous_date', count(*) FROM x WHERE k = 7 AND day(l_shipdate) <= 12 GROUP BY 1
UNION ALL SELECT sheet, 'cell', 'mixed_type_numeric_string', count(*) FROM x WHERE k NOT IN (3, 4) GROUP BY 1
UNION ALL SELECT sheet, 'cell', 'categorical_canonicalized', count(*) FROM x WHERE k = 9 GROUP BY 1
UNION ALL SELECT sheet, '*', 'duplicate_row', sum(n) FROM (SELECT sheet, count(*) AS n FROM x GROUP BY sheet, cell) WHERE n > 1 GROUP BY 1
UNION ALL SELECT sheet, 'cell', 'outlier_robust_log_mad', count(*) FROM l JOIN m USING (sheet) JOIN z USING (sheet) WHERE mad > 0 AND abs(0.6745 * (v - med) / mad) > 3.5 GROUP BY 1""")
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("sheet"))
    body = _cells(spark, d).join(o, "l_orderkey").select(
        F.lit("lines.xls").alias("workbook"), "sheet", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("row_idx"), F.lit("cell").alias("column"), F.col("cell").alias("value"))
    return cleaning.clean_cells(body, ["workbook", "sheet"]).issues


CONTRACT = {
    "workbook": "orders.xlsx", "sheet": "main", "publisher": "p",
    "required_columns": ["o_orderkey", "o_region"], "min_rows": 1_000_000_000, "max_null_pct": 5,
    "numeric_columns": {"o_totalprice": {"min": 0, "max": 400000, "unit": "GBP"}},
}


@query("contract_check_d19", "column:s detail:s confidence:s rows_affected:i", """WITH n AS (SELECT count(*) AS n, count(*) FILTER (WHERE o_totalprice > 400000) AS above,
count(*) FILTER (WHERE o_orderstatus = 'P') AS nulls FROM orders)
SELECT 'o_region' AS "column", 'Columns not delivered: o_region' AS detail, 'high' AS confidence, 1 AS rows_affected FROM n
UNION ALL SELECT '*', printf('%d rows, agreed were 1000000000 or more', n), 'high', 1000000000 - n FROM n
UNION ALL SELECT '*', printf('%.1f per cent of the cells are blank, agreed were 5.0 at most', 100.0 * nulls / (n * 3)), 'medium', CAST(round(100.0 * nulls / (n * 3) - 5) AS BIGINT) FROM n WHERE 100.0 * nulls / (n * 3) > 5
UNION ALL SELECT 'o_totalprice', printf('Outside 0 to 400000 [GBP]: 0 too low, %d too high', above), 'medium', above FROM n WHERE above > 0""")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("o_orderstatus"), "o_totalprice")
    return contract.check_table(o, CONTRACT, spark)


CONTRACT_TEXT = """
datasets:
- {workbook: orders.xlsx, sheet: main, publisher: sales, required_columns: [o_orderkey, o_region, o_clerk], min_rows: 1000000000, max_null_pct: 5,
   numeric_columns: {o_totalprice: {min: 0, max: 400000, unit: GBP}, o_orderkey: {min: 0}}}
- {workbook: customer.xlsx, sheet: main, required_columns: [c_custkey], min_rows: 1, max_null_pct: 99, numeric_columns: {c_acctbal: {min: 0, max: 9000, unit: GBP}}}
- {workbook: supplier.xlsx, sheet: main, publisher: nobody, required_columns: [s_suppkey]}
- {workbook: supplier.xlsx, sheet: main, publisher: sales, numeric_columns: {s_acctbal: {max: 0, unit: GBP}}}
"""


@query("contracts_of_many_tables_d19_s10", "workbook:s column:s detail:s confidence:s rows_affected:i", """WITH n AS (SELECT count(*) AS n, count(*) FILTER (WHERE o_totalprice > 400000) AS above, count(*) FILTER (WHERE o_orderstatus = 'P') AS nulls FROM orders),
c AS (SELECT count(*) FILTER (WHERE c_acctbal < 0) AS below, count(*) FILTER (WHERE c_acctbal > 9000) AS above FROM customer), s AS (SELECT count(*) AS above FROM supplier WHERE s_acctbal > 0)
SELECT 'orders.xlsx' AS workbook, 'o_region,o_clerk' AS "column", 'Columns not delivered: o_region, o_clerk' AS detail, 'high' AS confidence, 2 AS rows_affected FROM n
UNION ALL SELECT 'orders.xlsx', '*', printf('%d rows, agreed were 1000000000 or more', n), 'high', 1000000000 - n FROM n
UNION ALL SELECT 'orders.xlsx', '*', printf('%.1f per cent of the cells are blank, agreed were 5.0 at most', 100.0 * nulls / (n * 3)), 'medium', CAST(round(100.0 * nulls / (n * 3) - 5) AS BIGINT) FROM n WHERE 100.0 * nulls / (n * 3) > 5
UNION ALL SELECT 'orders.xlsx', 'o_totalprice', printf('Outside 0 to 400000 [GBP]: 0 too low, %d too high', above), 'medium', above FROM n WHERE above > 0
UNION ALL SELECT 'customer.xlsx', 'c_acctbal', printf('Outside 0 to 9000 [GBP]: %d too low, %d too high', below, above), 'medium', below + above FROM c WHERE below + above > 0
UNION ALL SELECT 'supplier.xlsx', '*', 'Expected table not found', 'high', 0
UNION ALL SELECT 'supplier.xlsx', 's_acctbal', printf('Outside None to 0 [GBP]: 0 too low, %d too high', above), 'medium', above FROM s WHERE above > 0""")
def _(spark, d):
    """The cells of three tables as sheets of one run against the text of a contract file."""
    def sheet(name, cols):
        rows = table(spark, d, name).select(*[c.cast("string") for c in cols])
        numbered = land(rows).withColumn("row_idx", F.monotonically_increasing_id())
        dense = ordered.row_numbers(numbered, [], "row_idx", "_at").drop("row_idx").withColumnRenamed("_at", "row_idx")
        return dense.unpivot(["row_idx"], rows.columns, "column", "value").select(F.lit(f"sales/{name}.xlsx").alias("workbook"), F.lit("main").alias("sheet"), "row_idx", "column", "value")

    status = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("o_orderstatus")
    cells_ = sheet("orders", [F.col("o_orderkey"), status, F.col("o_totalprice")]).unionByName(
        sheet("customer", [F.col("c_custkey"), F.col("c_acctbal")])).unionByName(sheet("supplier", [F.col("s_suppkey"), F.col("s_acctbal")]))
    return contract.contract_issues(cells_, CONTRACT_TEXT)


@query("unreadable_documents_d20", "issue_code:s n:i", "SELECT 'read_error' AS issue_code, count(*) AS n FROM pages WHERE NOT regexp_matches(html, '<table', 'i') HAVING count(*) > 0")
def _(spark, d):
    pages = table(spark, d, "pages").select(F.col("url").alias("doc"), "html")
    return contract.unreadable_documents(pages, F.col("html").rlike("(?i)<table")).groupBy("issue_code").agg(F.count(F.lit(1)).alias("n"))


def _order_pages(spark, d) -> DataFrame:
    """One HTML document per customer with one table: a row per order, its status, clerk group and priority, equal rows included."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.array("o_orderstatus", (F.col("o_orderkey") % 3).cast("string"), "o_orderpriority").alias("cells"))
    row = F.concat(F.lit("<tr><td>"), F.array_join("cells", "</td><td>"), F.lit("</td></tr>"))
    rows = o.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", row.alias("r")))), lambda x: x["r"]), "").alias("rows"))
    head = "<html><table><thead><tr><th>Status</th><th>Group</th><th>Priority</th></tr></thead>"
    return rows.select(F.concat(F.lit("c"), F.col("o_custkey")).alias("doc"), F.concat(F.lit(head), "rows", F.lit("</table></html>")).alias("html"))


@query("duplicate_rows_of_sheets_d6", "workbook:s sheet:s rows_affected:i", """SELECT 'c' || o_custkey AS workbook, 'html_table_0' AS sheet, sum(n) AS rows_affected
FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey, o_orderstatus, o_orderkey % 3, o_orderpriority) WHERE n > 1 GROUP BY 1""")
def _(spark, d):
    cells_ = land(html.html_cells(_order_pages(spark, d)).withColumnRenamed("doc", "workbook"))
    cleaned, _ = landing_run.clean_grid(cells_)
    return cleaned.issues.where(F.col("issue_code") == "duplicate_row")


@query("duplicate_fingerprints_d6", "props:s n_duplicate_rows:i", """SELECT props, sum(n) AS n_duplicate_rows
FROM (SELECT props, count(*) AS n FROM events GROUP BY props, user_id, event_type) WHERE n > 1 GROUP BY 1""")
def _(spark, d):
    """All events as sheets of their properties, cells only."""
    rows = table(spark, d, "events").select("props", "event_id", F.col("user_id").cast("string").alias("user"), "event_type")
    cells_ = rows.unpivot(["props", F.col("event_id").alias("row_idx")], ["user", "event_type"], "column", "value")
    return cleaning.duplicate_cells(cells_, ["props"])


@query("categories_of_many_values_d15", "from_value:s to_value:s rows_affected:i", """SELECT 'CLERK NUMBER ' || o_custkey AS from_value, 'Clerk Number ' || o_custkey AS to_value, count(*) AS rows_affected FROM orders GROUP BY o_custkey
UNION ALL SELECT 'usa', 'United States', count(*) FROM orders WHERE o_orderkey % 7 = 0 HAVING count(*) > 0""")
def _(spark, d):
    """A column with thousands of spellings."""
    o = table(spark, d, "orders")
    both = o.select(F.concat(F.lit("CLERK NUMBER "), "o_custkey").alias("clerk")).unionByName(o.where(F.col("o_orderkey") % 7 == 0).select(F.lit("usa").alias("clerk")))
    return cleaning.clean_table(both, "orders.xls", "Sheet 1").log
