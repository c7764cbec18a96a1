"""The given tables in the shapes the operators expect, each with the same shape in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from workload.base import table

PART_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
# Years of the order dates.
FIRST_YEAR, N_YEARS = 1995, 7
PEERS = ("N01", "N03", "N05", "N07", "N11")


def country(spark: SparkSession, d: str) -> DataFrame:
    """Country statistics: nation x ship year x part type; price is output, quantity is capacity."""
    line = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_tax")
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    nation = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    place = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("r_name").alias("region"), F.col("n_name").alias("country"),
        F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("iso3_code"),
    )
    joined = line.join(part, "l_partkey").join(place, "l_suppkey")
    return joined.groupBy(
        "region", F.lower("region").alias("sub_region"), "country", "iso3_code", F.year("l_shipdate").alias("year"),
        F.when(F.col("p_type").isin("ECONOMY", "PROMO"), "Budget").otherwise("Core").alias("group_technology"),
        F.col("p_type").alias("technology"), F.lower("p_type").alias("sub_technology"),
    ).agg(
        (F.sum("l_extendedprice") / 1000).alias("electricity_generation_gwh"),
        F.sum("l_quantity").alias("electricity_installed_capacity_mw"),
        F.max("l_tax").alias("sdg_7b1_re_capacity_per_capita_w_inhabitant"),
    )


COUNTRY_SQL = """country AS (
  SELECT r_name AS region, lower(r_name) AS sub_region, n_name AS country,
    'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS iso3_code, year(l_shipdate) AS year,
    CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN 'Budget' ELSE 'Core' END AS group_technology,
    p_type AS technology, lower(p_type) AS sub_technology,
    sum(l_extendedprice) / 1000 AS gwh, sum(l_quantity) AS mw, max(l_tax) AS sdg
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY ALL),
factors AS (SELECT *, CASE WHEN (year % 4 = 0 AND year % 100 <> 0) OR year % 400 = 0 THEN 8784 ELSE 8760 END AS hours,
  gwh / (mw * CASE WHEN (year % 4 = 0 AND year % 100 <> 0) OR year % 400 = 0 THEN 8784 ELSE 8760 END / 1000.0) AS cf
  FROM country WHERE mw > 0)"""


def hours_sql(year: str = "year") -> str:
    return f"(CASE WHEN ({year} % 4 = 0 AND {year} % 100 <> 0) OR {year} % 400 = 0 THEN 8784 ELSE 8760 END)"


def sectors(spark: SparkSession, d: str) -> DataFrame:
    """(sector, year, turnover_thousand_gbp, fte): market segment x order year."""
    orders = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    cust = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return orders.join(cust, "o_custkey").groupBy(F.col("c_mktsegment").alias("sector"), F.year("o_orderdate").alias("year")).agg(
        (F.sum("o_totalprice") / 1000).alias("turnover_thousand_gbp"), F.count(F.lit(1)).cast("double").alias("fte")
    )


SECTORS_SQL = """sectors AS (
  SELECT c_mktsegment AS sector, year(o_orderdate) AS year, sum(o_totalprice) / 1000 AS turnover,
    CAST(count(*) AS DOUBLE) AS fte
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""


def quarterly(spark: SparkSession, d: str) -> DataFrame:
    """Wide quarterly table with text labels: one column per part type, named after fuels."""
    line = table(spark, d, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice")
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    fuel = {"ECONOMY": "coal", "LARGE": "gas", "MEDIUM": "wind_and_solar", "PROMO": "oil", "SMALL": "bioenergy", "STANDARD": "nuclear"}
    cols = [F.sum(F.when(F.col("p_type") == t, F.col("l_extendedprice") / 1e6)).alias(f) for t, f in fuel.items()]
    sums = line.join(part, "l_partkey").groupBy(F.quarter("l_shipdate").alias("_q"), F.year("l_shipdate").alias("_y")).agg(*cols)
    return sums.select(F.concat(F.lit("Q"), "_q", F.lit(" "), "_y").alias("unnamed_0"), *fuel.values())


FUELS_SQL = """fuels AS (
  SELECT year(l_shipdate) AS year,
    sum(CASE WHEN p_type = 'ECONOMY' THEN l_extendedprice ELSE 0 END) / 1e6 AS coal,
    sum(CASE WHEN p_type = 'LARGE' THEN l_extendedprice ELSE 0 END) / 1e6 AS gas,
    sum(CASE WHEN p_type = 'MEDIUM' THEN l_extendedprice ELSE 0 END) / 1e6 AS wind_and_solar,
    sum(CASE WHEN p_type = 'PROMO' THEN l_extendedprice ELSE 0 END) / 1e6 AS oil,
    sum(CASE WHEN p_type = 'SMALL' THEN l_extendedprice ELSE 0 END) / 1e6 AS bioenergy,
    sum(CASE WHEN p_type = 'STANDARD' THEN l_extendedprice ELSE 0 END) / 1e6 AS nuclear
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
generation AS (SELECT *, wind_and_solar + bioenergy AS renewable_twh, coal + oil + gas AS fossil_twh,
  coal + gas + wind_and_solar + oil + bioenergy + nuclear AS total_gen_twh,
  (wind_and_solar + bioenergy) / (coal + gas + wind_and_solar + oil + bioenergy + nuclear) * 100 AS renewable_share_pct FROM fuels)"""


def monthly_orders(spark: SparkSession, d: str) -> DataFrame:
    """(technology, month, amount, installs) per order priority; the running sums are cumulative levels."""
    orders = table(spark, d, "orders").select("o_orderpriority", "o_orderdate", "o_totalprice")
    return orders.groupBy(
        F.col("o_orderpriority").alias("technology"), F.trunc(F.to_date("o_orderdate"), "month").alias("date")
    ).agg((F.sum("o_totalprice") / 1e6).alias("amount"), F.count(F.lit(1)).cast("double").alias("installs"))


def cumulative_orders(spark: SparkSession, d: str) -> DataFrame:
    """(technology, date, cumulative_payments_gbpm, cumulative_installs)."""
    upto = W.partitionBy("technology").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    return monthly_orders(spark, d).select(
        "technology", "date", F.sum("amount").over(upto).alias("cumulative_payments_gbpm"),
        F.sum("installs").over(upto).alias("cumulative_installs"),
    )


YEARLY_ORDERS_SQL = """yearly AS (
  SELECT o_orderpriority AS technology, year(o_orderdate) AS year, sum(o_totalprice) / 1e6 AS amount, count(*) AS installs
  FROM orders GROUP BY ALL),
levels AS (SELECT *, sum(amount) OVER w AS cum_amount, sum(installs) OVER w AS cum_installs FROM yearly
  WINDOW w AS (PARTITION BY technology ORDER BY year))"""


def daily_events(spark: SparkSession, d: str) -> DataFrame:
    """(event_type, day, value): mean event value per day."""
    events = table(spark, d, "events").select("event_type", "ts", "value")
    return events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("value"))


DAILY_SQL = """daily AS (SELECT event_type, CAST(ts AS DATE) AS day, avg(value) AS value FROM events GROUP BY ALL)"""


def labelled_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their labels; quality and toxic are NULL where there is none."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(table(spark, d, "labels"), "doc_id", "left")


LABELLED_SQL = """labelled AS (SELECT d.doc_id, lang, source, n_chars, quality, toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def vintages(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(technology, year, value) of two vintages: even and odd order keys, the second revised upwards."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate", "o_totalprice")
    rows = orders.select(
        "o_orderkey", F.col("o_orderpriority").alias("technology"), F.year("o_orderdate").alias("year"),
        F.col("o_totalprice").alias("value"),
    )
    old = rows.where(F.col("o_orderkey") % 2 == 0)
    new = rows.where(F.col("o_orderkey") % 2 == 1).withColumn(
        "value", F.col("value") * F.when(F.col("technology") == "1-URGENT", 1.8).otherwise(1.0)
    )
    return old.drop("o_orderkey"), new.drop("o_orderkey")


VINTAGES_SQL = """sides AS (
  SELECT o_orderpriority AS technology, year(o_orderdate) AS year, o_orderkey % 2 AS side,
    CASE WHEN o_orderkey % 2 = 1 AND o_orderpriority = '1-URGENT' THEN o_totalprice * CAST(1.8 AS DOUBLE) ELSE o_totalprice END AS value
  FROM orders)"""


def text_cells_frame(spark: SparkSession, d: str) -> DataFrame:
    """One dirty text cell per line item, made from its columns (every rule has cells to act on)."""
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate")
    qty, day = F.col("l_quantity").cast("int").cast("string"), F.to_date("l_shipdate")
    k = F.col("l_partkey") % 12
    cell = (
        F.when(k == 0, F.concat(qty, F.lit(" [c]"))).when(k == 1, F.concat(F.lit("[Low] "), qty))
        .when(k == 2, F.concat(F.lit("[note 3] "), qty)).when(k == 3, F.lit("n/a")).when(k == 4, F.lit("-999"))
        .when(k == 5, F.concat(qty, F.lit(" kg"))).when(k == 6, F.concat(qty, F.lit(",5 lb")))
        .when(k == 7, F.date_format(day, "dd/MM/yyyy")).when(k == 8, F.date_format(day, "yyyy-MM-dd"))
        .when(k == 9, F.lit("usa")).when(k == 10, F.concat(F.lit("£1,"), F.lpad(qty, 3, "0")))
        .otherwise(qty)
    )
    return line.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", cell.alias("cell"))


CELLS_SQL = """cells AS (
  SELECT l_orderkey, l_linenumber, CASE l_partkey % 12
    WHEN 0 THEN q || ' [c]' WHEN 1 THEN '[Low] ' || q WHEN 2 THEN '[note 3] ' || q WHEN 3 THEN 'n/a' WHEN 4 THEN '-999'
    WHEN 5 THEN q || ' kg' WHEN 6 THEN q || ',5 lb' WHEN 7 THEN strftime(l_shipdate, '%d/%m/%Y')
    WHEN 8 THEN strftime(l_shipdate, '%Y-%m-%d') WHEN 9 THEN 'usa' WHEN 10 THEN '£1,' || lpad(q, 3, '0') ELSE q END AS cell,
    l_quantity, l_shipdate, l_partkey % 12 AS k
  FROM (SELECT *, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS q FROM lineitem))"""
