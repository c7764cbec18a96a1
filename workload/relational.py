"""Projections, filters, joins, aggregates, windows and reshapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.functions.dates import hours_in_year
from statloom.functions.nulls import clip_low, div_nonzero, row_sum, safe_div, share_of
from statloom.operators import ordered, relational as r
from statloom.operators.series import rolling_volatility
from workload import shapes as s
from workload.base import query, table


# ---- projections and filters -------------------------------------------------

@query("tolerant_projection_f1", "s_suppkey:i s_acctbal:2", "SELECT s_suppkey, s_acctbal FROM supplier")
def _(spark, d):
    return r.pick(table(spark, d, "supplier"), ["s_suppkey", "not_there", "s_acctbal"])


@query("drop_housekeeping_f2", "c_custkey:i c_mktsegment:s", "SELECT c_custkey, c_mktsegment FROM customer")
def _(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    noisy = c.withColumns({"raw__c_mktsegment": F.col("c_mktsegment"), "c_mktsegment_flag": F.lit(None).cast("string"), "x_iso_date": F.lit("")})
    return r.only_data(noisy)


@query("mask_filters_f3", "technology:s n:i gwh:2", f"""WITH {s.COUNTRY_SQL}
SELECT technology, count(*) AS n, sum(gwh) AS gwh FROM country
WHERE year BETWEEN 1996 AND 1999 AND technology IN ('ECONOMY', 'SMALL', 'PROMO') AND iso3_code <> 'N00' GROUP BY 1""")
def _(spark, d):
    c = s.country(spark, d).where(
        F.col("year").between(1996, 1999) & F.col("technology").isin("ECONOMY", "SMALL", "PROMO") & (F.col("iso3_code") != "N00")
    )
    return c.groupBy("technology").agg(F.count(F.lit(1)).alias("n"), F.sum("electricity_generation_gwh").alias("gwh"))


@query("regex_filter_f4", "p_name:s n:i", """SELECT p_name, count(*) AS n FROM part
WHERE regexp_matches(p_name, 'RED|bolt$', 'i') GROUP BY 1""")
def _(spark, d):
    return table(spark, d, "part").where(r.matches(F.col("p_name"), "RED|bolt$")).groupBy("p_name").agg(F.count(F.lit(1)).alias("n"))


@query("prefix_filter_f5", "o_orderpriority:s n:i", """SELECT o_orderpriority, count(*) AS n FROM orders
WHERE starts_with(o_orderpriority, '1-') OR starts_with(o_orderpriority, '4-') GROUP BY 1""")
def _(spark, d):
    p = F.col("o_orderpriority")
    return table(spark, d, "orders").where(p.startswith("1-") | p.startswith("4-")).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("drop_nulls_f6", "lang:s n:i", f"""WITH {s.LABELLED_SQL}
SELECT lang, count(*) AS n FROM labelled WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1""")
def _(spark, d):
    return s.labelled_documents(spark, d).dropna(subset=["quality", "toxic"]).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("country_column_filter_f7", "country:s year:i gwh:2", f"""WITH {s.COUNTRY_SQL}
SELECT country, year, sum(gwh) AS gwh FROM country WHERE country = 'NATION_7' GROUP BY 1, 2""")
def _(spark, d):
    c = r.country_rows(s.country(spark, d), names=("nation_7",))
    return c.groupBy("country", "year").agg(F.sum("electricity_generation_gwh").alias("gwh"))


@query("guarded_ratio_f8", "l_returnflag:s ratio:6 n_undefined:i", """SELECT l_returnflag, sum(CASE WHEN l_tax > 0 THEN l_discount / l_tax END) AS ratio,
count(*) FILTER (WHERE l_tax <= 0) AS n_undefined FROM lineitem GROUP BY 1""")
def _(spark, d):
    ratio = safe_div(F.col("l_discount"), F.col("l_tax"))
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.sum(ratio).alias("ratio"), F.count_if(ratio.isNull()).alias("n_undefined"))


@query("clip_low_f9", "c_mktsegment:s clipped:2", "SELECT c_mktsegment, sum(greatest(c_acctbal, 0)) AS clipped FROM customer GROUP BY 1")
def _(spark, d):
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.sum(clip_low(F.col("c_acctbal"))).alias("clipped"))


@query("rename_prefix_constant_f10", "segment:s rhi_balance:2 source:s", """SELECT c_mktsegment AS segment, sum(c_acctbal) AS rhi_balance, 'customer' AS source
FROM customer GROUP BY 1""")
def _(spark, d):
    g = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.sum("c_acctbal").alias("balance"))
    return g.withColumnsRenamed({"c_mktsegment": "segment", "balance": "rhi_balance"}).withColumn("source", F.lit("customer"))


@query("first_row_per_key_f11", "o_custkey:i o_orderkey:i o_totalprice:2", """SELECT o_custkey, o_orderkey, o_totalprice FROM (
SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def _(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return r.first_by_key(o, "o_custkey", ["o_orderdate", "o_orderkey"])


# ---- joins -------------------------------------------------------------------

def _fact_parts(spark, d):
    base = s.country(spark, d).where(F.col("iso3_code") == "N05").select("year", "technology", "electricity_installed_capacity_mw")
    lf = table(spark, d, "part").groupBy(F.col("p_type").alias("technology"), (F.lit(1992) + F.col("p_size") % 10).alias("year")).agg(
        F.avg("p_retailprice").alias("load_factor"))
    return base, lf


FACT_PARTS_SQL = f"""WITH {s.COUNTRY_SQL},
base AS (SELECT year, technology, mw FROM country WHERE iso3_code = 'N05'),
lf AS (SELECT p_type AS technology, 1992 + p_size % 10 AS year, avg(p_retailprice) AS load_factor FROM part GROUP BY ALL)"""


@query("left_join_two_keys_j1", "year:i technology:s mw:2 load_factor:4", FACT_PARTS_SQL + """
SELECT b.year, b.technology, mw, load_factor FROM base b LEFT JOIN lf ON b.year IS NOT DISTINCT FROM lf.year AND b.technology IS NOT DISTINCT FROM lf.technology""")
def _(spark, d):
    base, lf = _fact_parts(spark, d)
    return r.join_null_safe(base, lf, ["year", "technology"]).withColumnRenamed("electricity_installed_capacity_mw", "mw")


@query("left_join_year_null_keys_j2", "quality:i n:i n_items:i", f"""WITH {s.LABELLED_SQL},
per AS (SELECT quality, count(*) AS n FROM labelled GROUP BY 1),
other AS (SELECT quality, sum(n_chars) AS n_items FROM labelled GROUP BY 1)
SELECT per.quality, n, n_items FROM per LEFT JOIN other ON per.quality IS NOT DISTINCT FROM other.quality""")
def _(spark, d):
    x = s.labelled_documents(spark, d)
    per = x.groupBy("quality").agg(F.count(F.lit(1)).alias("n"))
    return r.join_null_safe(per, x.groupBy("quality").agg(F.sum("n_chars").alias("n_items")), ["quality"])


@query("inner_join_sector_year_j3", "sector:s year:i ratio:4", f"""WITH {s.SECTORS_SQL}
SELECT a.sector, a.year, a.turnover / b.fte AS ratio FROM sectors a JOIN sectors b ON a.sector = b.sector AND a.year = b.year""")
def _(spark, d):
    x = s.sectors(spark, d)
    both = x.select("sector", "year", "turnover_thousand_gbp").join(x.select("sector", "year", "fte"), ["sector", "year"])
    return both.withColumn("ratio", div_nonzero(F.col("turnover_thousand_gbp"), F.col("fte")))


FULL_SIDES_SQL = """a AS (SELECT year(o_orderdate) AS year, o_orderpriority AS industry, sum(o_totalprice) AS x FROM orders
  WHERE year(o_orderdate) <= 1999 GROUP BY ALL),
b AS (SELECT year(o_orderdate) AS year, o_orderpriority AS industry, count(*) AS y FROM orders WHERE year(o_orderdate) >= 1997 GROUP BY ALL)"""


def _full_sides(spark, d):
    o = table(spark, d, "orders").select(F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("industry"), "o_totalprice")
    a = o.where(F.col("year") <= 1999).groupBy("year", "industry").agg(F.sum("o_totalprice").alias("x"))
    b = o.where(F.col("year") >= 1997).groupBy("year", "industry").agg(F.count(F.lit(1)).alias("y"))
    return a, b


@query("full_join_industry_year_j4", "year:i industry:s x:2 y:i", f"""WITH {FULL_SIDES_SQL}
SELECT coalesce(a.year, b.year) AS year, coalesce(a.industry, b.industry) AS industry, x, y
FROM a FULL JOIN b ON a.year = b.year AND a.industry = b.industry""")
def _(spark, d):
    a, b = _full_sides(spark, d)
    return a.join(b, ["year", "industry"], "full")


@query("left_join_capacity_j7", "year:i industry:s y:i x:2", f"""WITH {FULL_SIDES_SQL}
SELECT b.year, b.industry, y, x FROM b LEFT JOIN a ON a.year = b.year AND a.industry = b.industry""")
def _(spark, d):
    a, b = _full_sides(spark, d)
    return b.join(a, ["year", "industry"], "left")


@query("left_join_chain_j9", "year:i a:2 b:2 c:i", """WITH l AS (SELECT year(l_shipdate) AS year, sum(l_extendedprice) AS a FROM lineitem GROUP BY 1),
o AS (SELECT year(o_orderdate) AS year, sum(o_totalprice) AS b FROM orders GROUP BY 1),
u AS (SELECT year(o_orderdate) AS year, count(*) AS c FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT l.year, a, b, c FROM l LEFT JOIN o ON l.year = o.year LEFT JOIN u ON l.year = u.year""")
def _(spark, d):
    line = table(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("year")).agg(F.sum("l_extendedprice").alias("a"))
    orders = table(spark, d, "orders").select(F.year("o_orderdate").alias("year"), "o_totalprice", "o_orderstatus")
    b = orders.groupBy("year").agg(F.sum("o_totalprice").alias("b"))
    c = orders.where(F.col("o_orderstatus") == "P").groupBy("year").agg(F.count(F.lit(1)).alias("c"))
    return line.join(b, "year", "left").join(c, "year", "left")


@query("join_differently_named_keys_j10", "n_name:s n_customers:i n_suppliers:i", """SELECT n_name, n_customers, n_suppliers FROM nation
LEFT JOIN (SELECT c_nationkey, count(*) AS n_customers FROM customer GROUP BY 1) ON n_nationkey = c_nationkey
LEFT JOIN (SELECT s_nationkey, count(*) AS n_suppliers FROM supplier GROUP BY 1) ON n_nationkey = s_nationkey""")
def _(spark, d):
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n_customers"))
    p = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n_suppliers"))
    n = table(spark, d, "nation")
    return n.join(c, n.n_nationkey == c.c_nationkey, "left").join(p, n.n_nationkey == p.s_nationkey, "left")


@query("dictionary_lookup_j15", "status:s n:i", """SELECT CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS status,
count(*) AS n FROM orders GROUP BY 1""")
def _(spark, d):
    named = r.map_values(F.col("o_orderstatus"), {"F": "final", "O": "open"})
    return table(spark, d, "orders").groupBy(named.alias("status")).agg(F.count(F.lit(1)).alias("n"))


# ---- aggregates --------------------------------------------------------------

@query("grouped_sums_a1", "toxic:i quality:2 n_chars:2", f"""WITH {s.LABELLED_SQL}
SELECT toxic, coalesce(sum(CASE WHEN quality = 0 THEN quality + 0.5 END), 0) AS quality, sum(n_chars) AS n_chars FROM labelled WHERE toxic IS NOT NULL GROUP BY 1""")
def _(spark, d):
    x = s.labelled_documents(spark, d).withColumn("quality", F.when(F.col("quality") == 0, F.col("quality") + 0.5))
    return r.grouped_sums(x, ["toxic"], ["quality", "n_chars"])


@query("named_aggregates_a2", "n_name:s total:2 biggest:2 n:i", """SELECT n_name, sum(c_acctbal) AS total, max(c_acctbal) AS biggest, count(*) AS n
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def _(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, d, "customer").join(n, "c_nationkey").groupBy("n_name").agg(
        F.sum("c_acctbal").alias("total"), F.max("c_acctbal").alias("biggest"), F.count(F.lit(1)).alias("n"))


@query("group_summary_a3", "event_type:s mean:6 std:6 min:4 max:4 n_obs:i p5:6 p95:6", """SELECT event_type, avg(value) AS mean, stddev_samp(value) AS std,
min(value) AS min, max(value) AS max, count(value) AS n_obs, quantile_cont(value, 0.05) AS p5, quantile_cont(value, 0.95) AS p95 FROM events GROUP BY 1""")
def _(spark, d):
    e = table(spark, d, "events").select("event_type", "value")
    return r.group_summary(e, ["event_type"], "value", {"p5": 0.05, "p95": 0.95})


@query("group_median_a4", "o_orderpriority:s median:4", "SELECT o_orderpriority, median(o_totalprice) AS median FROM orders GROUP BY 1")
def _(spark, d):
    return r.group_median(table(spark, d, "orders").select("o_orderpriority", "o_totalprice"), ["o_orderpriority"], "o_totalprice")


@query("group_max_and_mean_a5_a6", "l_suppkey:i biggest:2 mean:4", """SELECT l_suppkey, max(l_extendedprice) AS biggest, avg(l_discount) AS mean
FROM lineitem GROUP BY 1""")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.max("l_extendedprice").alias("biggest"), F.avg("l_discount").alias("mean"))


@query("last_value_per_year_a7", "o_orderpriority:s year:i o_totalprice:2", """SELECT o_orderpriority, year, price AS o_totalprice FROM (
SELECT o_orderpriority, year(o_orderdate) AS year, price, row_number() OVER (PARTITION BY o_orderpriority, year(o_orderdate) ORDER BY o_orderdate DESC) AS rn
FROM (SELECT o_orderpriority, o_orderdate, sum(o_totalprice) AS price FROM orders GROUP BY ALL)) WHERE rn = 1""")
def _(spark, d):
    daily = table(spark, d, "orders").groupBy("o_orderpriority", "o_orderdate").agg(F.sum("o_totalprice").alias("o_totalprice"))
    return r.last_per_year(daily, ["o_orderpriority"], "o_orderdate", "o_totalprice")


@query("first_increment_a8", "technology:s year:i step:i", f"""WITH {s.YEARLY_ORDERS_SQL}
SELECT technology, year, installs AS step FROM levels""")
def _(spark, d):
    from statloom.operators.series import cumulative_long_to_annual

    x = cumulative_long_to_annual(s.cumulative_orders(spark, d), ["technology"], "date", "cumulative_installs")
    return x.withColumnRenamed("new_cumulative_installs", "step")


@query("value_counts_a9", "p_name:s n:i", "SELECT p_name, count(*) AS n FROM part GROUP BY 1")
def _(spark, d):
    return ordered.value_counts(table(spark, d, "part"), [], "p_name")


@query("distinct_counts_a10", "l_returnflag:s parts:i suppliers:i", """SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers
FROM lineitem GROUP BY 1""")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("row_sum_a11", "lang:s total:2", f"""WITH {s.LABELLED_SQL}
SELECT lang, sum(coalesce(quality, 0) + coalesce(toxic, 0) + n_chars) AS total FROM labelled GROUP BY 1""")
def _(spark, d):
    total = row_sum([F.col("quality"), F.col("toxic"), F.col("n_chars")])
    return s.labelled_documents(spark, d).groupBy("lang").agg(F.sum(total).alias("total"))


@query("weighted_mean_a12", "l_returnflag:s mean:6", """SELECT l_returnflag, sum(l_discount * l_quantity) / sum(l_quantity) AS mean FROM lineitem GROUP BY 1""")
def _(spark, d):
    return r.weighted_mean(table(spark, d, "lineitem"), ["l_returnflag"], "l_discount", "l_quantity", "mean")


@query("null_and_zero_shares_a13", "source:s null_share:6 short_share:6", f"""WITH {s.LABELLED_SQL}
SELECT source, avg(CASE WHEN quality IS NULL THEN 1.0 ELSE 0.0 END) AS null_share, avg(CASE WHEN n_chars < 500 THEN 1.0 ELSE 0.0 END) AS short_share
FROM labelled GROUP BY 1""")
def _(spark, d):
    return s.labelled_documents(spark, d).groupBy("source").agg(
        share_of(F.col("quality").isNull()).alias("null_share"), share_of(F.col("n_chars") < 500).alias("short_share"))


@query("group_with_null_keys_a14", "toxic:i n:i", f"WITH {s.LABELLED_SQL} SELECT toxic, count(*) AS n FROM labelled GROUP BY 1")
def _(spark, d):
    return s.labelled_documents(spark, d).groupBy("toxic").agg(F.count(F.lit(1)).alias("n"))


# ---- windows -----------------------------------------------------------------

@query("three_row_difference_w1", "sector:s year:i delta:4", f"""WITH {s.SECTORS_SQL}
SELECT sector, year, turnover - lag(turnover, 3) OVER (PARTITION BY sector ORDER BY year) AS delta FROM sectors""")
def _(spark, d):
    return r.with_difference(s.sectors(spark, d), ["sector"], "year", "turnover_thousand_gbp", "delta", 3)


@query("first_difference_w2", "event_type:s day:d delta:6", f"""WITH {s.DAILY_SQL}
SELECT event_type, day, value - lag(value) OVER (PARTITION BY event_type ORDER BY day) AS delta FROM daily""")
def _(spark, d):
    return r.with_difference(s.daily_events(spark, d), ["event_type"], "day", "value", "delta")


@query("clipped_global_difference_w3", "year:i mw:2 new_mw:2", f"""WITH {s.COUNTRY_SQL}
SELECT year, mw, greatest(mw - lag(mw) OVER (ORDER BY year), CASE WHEN lag(mw) OVER (ORDER BY year) IS NULL THEN NULL ELSE 0 END) AS new_mw
FROM (SELECT year, sum(mw) AS mw FROM country GROUP BY 1)""")
def _(spark, d):
    from statloom.plans.facts import capacity_additions

    x = capacity_additions(s.country(spark, d))
    return x.withColumnsRenamed({"electricity_installed_capacity_mw": "mw", "new_capacity_mw": "new_mw"})


@query("rolling_mean_w4", "event_type:s day:d roll:6", f"""WITH {s.DAILY_SQL}
SELECT event_type, day, avg(value) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS roll FROM daily""")
def _(spark, d):
    return r.with_rolling_mean(s.daily_events(spark, d), ["event_type"], "day", "value", "roll")


@query("rolling_volatility_w5", "event_type:s day:d rolling_mean:6 rolling_std:6 rolling_cv:6", f"""WITH {s.DAILY_SQL}
SELECT event_type, day, CASE WHEN n >= 6 THEN m END AS rolling_mean, CASE WHEN n >= 6 THEN sd END AS rolling_std,
CASE WHEN n >= 6 AND m > 0 THEN sd / m END AS rolling_cv FROM (
SELECT event_type, day, avg(value) OVER w AS m, stddev_samp(value) OVER w AS sd, count(value) OVER w AS n FROM daily
WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))""")
def _(spark, d):
    return rolling_volatility(s.daily_events(spark, d), ["event_type"], "day", "value", 12)


@query("forward_fill_w6", "o_custkey:i o_orderkey:i label:s", """SELECT o_custkey, o_orderkey,
last_value(CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey
ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS label FROM orders""")
def _(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("label"))
    return ordered.fill_forward(o, ["o_custkey"], "o_orderkey", "label")


@query("running_total_w7", "p_brand:s p_size:i share:6", """SELECT p_brand, p_size, sum(n) OVER (PARTITION BY p_brand ORDER BY p_size) / sum(n) OVER (PARTITION BY p_brand) AS share
FROM (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL)""")
def _(spark, d):
    p = table(spark, d, "part").groupBy("p_brand", "p_size").agg(F.count(F.lit(1)).alias("n"))
    run = ordered.running_totals(p, ["p_brand"], ["p_size"], {"cum": "n"})
    return run.withColumn("share", F.col("cum") / F.col("cum_all"))


@query("date_gaps_w8", "o_custkey:i day:d gap_days:i", """SELECT o_custkey, day, datediff('day', lag(day) OVER (PARTITION BY o_custkey ORDER BY day), day) AS gap_days
FROM (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders)""")
def _(spark, d):
    days = table(spark, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day")).distinct()
    return r.with_gaps(days, ["o_custkey"], "day", "gap_days")


@query("one_long_series_w2_w4_w5_w8", "event_id:i delta:4 roll:6 rolling_cv:6 gap_days:i", """SELECT event_id, value - lag(value, 3) OVER w AS delta, CASE WHEN count(value) OVER f5 >= 2 THEN avg(value) OVER f5 END AS roll,
CASE WHEN count(value) OVER f12 >= 6 AND avg(value) OVER f12 > 0 THEN stddev_samp(value) OVER f12 / avg(value) OVER f12 END AS rolling_cv, datediff('day', lag(ts) OVER w, ts) AS gap_days
FROM events WINDOW w AS (ORDER BY ts, event_id), f5 AS (ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), f12 AS (ORDER BY ts, event_id ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""")
def _(spark, d):
    """All events as one series without a key, in chunks of 1,000 rows."""
    e = table(spark, d, "events").select("event_id", "value", "ts", F.struct("ts", "event_id").alias("at"))
    both = r.with_rolling_mean(r.with_difference(e, [], "at", "value", "delta", 3, long_rows=1000), [], "at", "value", "roll", 5, 2, long_rows=1000)
    gaps = ordered.sliding(both, [], "at", 1, lambda w: {"gap_days": F.datediff("ts", F.lag("ts").over(w))}, long_rows=1000)
    return rolling_volatility(gaps, [], "at", "value", 12, long_rows=1000)


@query("one_hot_series_q15", "event_type:s event_id:i rolling_cv:6", """WITH e AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'hot' ELSE event_type || user_id % 50 END AS event_type, event_id, value FROM events)
SELECT event_type, event_id, CASE WHEN n >= 3 AND m > 0 THEN sd / m END AS rolling_cv FROM (SELECT event_type, event_id, avg(value) OVER w AS m, stddev_samp(value) OVER w AS sd, count(value) OVER w AS n FROM e
WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))""")
def _(spark, d):
    """A third of all events in one series, the others in many short ones."""
    kind = F.when(F.col("event_id") % 3 == 0, "hot").otherwise(F.concat("event_type", F.col("user_id") % 50))
    e = table(spark, d, "events").select(kind.alias("event_type"), "event_id", "value")
    return rolling_volatility(e, ["event_type"], "event_id", "value", 7, long_rows=500)


@query("average_ranks_w9", "p_brand:s p_size:i rank:2", """SELECT DISTINCT p_brand, p_size, rank() OVER (PARTITION BY p_brand ORDER BY p_size)
+ (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS rank FROM part""")
def _(spark, d):
    counts = ordered.value_counts(table(spark, d, "part"), ["p_brand"], "p_size")
    return ordered.average_ranks(counts, ["p_brand"], "p_size", "n", "rank")


# ---- sort, top-k, sets, reshape ----------------------------------------------

@query("multi_key_sort_t1", "n_regionkey:i n_name:s", "SELECT n_regionkey, n_name FROM nation ORDER BY 1, 2")
def _(spark, d):
    return table(spark, d, "nation").orderBy("n_regionkey", "n_name")


@query("top_k_t2", "l_partkey:i revenue:2", """SELECT l_partkey, sum(l_extendedprice) AS revenue FROM lineitem GROUP BY 1
ORDER BY revenue DESC, l_partkey LIMIT 20""")
def _(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum("l_extendedprice").alias("revenue"))
    return r.top_k(g, "revenue", 20, ["l_partkey"])


@query("latest_snapshot_t3", "sector:s year:i turnover_thousand_gbp:2", f"""WITH {s.SECTORS_SQL}
SELECT sector, year, turnover AS turnover_thousand_gbp FROM sectors WHERE year = (SELECT max(year) FROM sectors)""")
def _(spark, d):
    return r.latest_rows(s.sectors(spark, d), "year")


@query("nth_from_last_t4", "event_type:s value_last_1:6 value_last_3:6 value_last_5:6", f"""WITH {s.DAILY_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day DESC) AS rn FROM daily)
SELECT event_type, max(CASE WHEN rn = 1 THEN value END) AS value_last_1, max(CASE WHEN rn = 3 THEN value END) AS value_last_3,
max(CASE WHEN rn = 5 THEN value END) AS value_last_5 FROM r GROUP BY 1""")
def _(spark, d):
    return r.nth_from_last(s.daily_events(spark, d), ["event_type"], "day", "value", [1, 3, 5])


@query("union_u1", "kind:s key:i name:s", """SELECT 'customer' AS kind, c_custkey AS key, c_name AS name FROM customer
UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier""")
def _(spark, d):
    c = table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    return c.unionByName(table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("name")))


@query("set_difference_u2", "left_rows:i right_rows:i left_distinct:i right_distinct:i only_left:i only_right:i", """
WITH a AS (SELECT l_partkey, l_returnflag FROM lineitem), b AS (SELECT l_partkey, l_linestatus FROM lineitem)
SELECT (SELECT count(*) FROM a) AS left_rows, (SELECT count(*) FROM b) AS right_rows,
(SELECT count(*) FROM (SELECT DISTINCT * FROM a)) AS left_distinct, (SELECT count(*) FROM (SELECT DISTINCT * FROM b)) AS right_distinct,
(SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS only_left, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS only_right""")
def _(spark, d):
    line = table(spark, d, "lineitem")
    b = line.select("l_partkey", F.col("l_linestatus").alias("l_returnflag"))
    return r.set_difference_counts(line.select("l_partkey", "l_returnflag"), b, ["l_partkey", "l_returnflag"])


@query("shared_keys_u3", "key:i", "SELECT c_nationkey AS key FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def _(spark, d):
    return r.shared_keys(table(spark, d, "customer"), table(spark, d, "supplier"), "c_nationkey", "s_nationkey", "key")


@query("melt_r1", "l_orderkey:i l_linenumber:i measure:s value:4", """SELECT l_orderkey, l_linenumber, measure, value FROM (
SELECT l_orderkey, l_linenumber, 'l_discount' AS measure, NULLIF(l_discount, 0) AS value FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', NULLIF(l_tax, 0) FROM lineitem)""")
def _(spark, d):
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.nullif("l_discount", F.lit(0.0)).alias("l_discount"), F.nullif("l_tax", F.lit(0.0)).alias("l_tax"))
    return r.melt(line, ["l_orderkey", "l_linenumber"], ["l_discount", "l_tax"], "measure", "value")


@query("numbered_columns_r2", "n_name:s year:i value:i", """SELECT n_name, year(o_orderdate) AS year, count(*) AS value FROM customer
JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2""")
def _(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    c = table(spark, d, "customer").join(n, "c_nationkey").select(F.col("c_custkey").alias("o_custkey"), "n_name")
    o = table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("y")).join(c, "o_custkey")
    wide = o.groupBy("n_name").agg(*[F.count_if(F.col("y") == s.FIRST_YEAR + i).alias("estimate" if i == 0 else f"estimate_{i + 1}") for i in range(s.N_YEARS)])
    return r.numbered_columns_to_years(wide, ["n_name"], "estimate", s.FIRST_YEAR, s.N_YEARS).where(F.col("value") > 0)


@query("pivot_r3", "year:i " + " ".join(f"{t}:4" for t in s.PART_TYPES), "SELECT year(l_shipdate) AS year, "
       + ", ".join(f"""avg(CASE WHEN p_type = '{t}' THEN l_quantity END) AS "{t}" """ for t in s.PART_TYPES) + " FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def _(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    line = table(spark, d, "lineitem").select("l_partkey", F.year("l_shipdate").alias("year"), "l_quantity").join(p, "l_partkey")
    return r.to_matrix(line, "year", "p_type", "l_quantity", list(s.PART_TYPES))


@query("vintage_measure_r5", "technology:s year:i value:2", """SELECT o_orderpriority AS technology, year(o_orderdate) AS year, o_totalprice AS value
FROM orders WHERE o_orderstatus = 'F'""")
def _(spark, d):
    from statloom.operators.drift import long_vintage

    long = table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("product_name"), F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("data_type"),
        F.lit("Megawatt").alias("unit"), F.col("o_totalprice").alias("value"))
    return long_vintage(long, "F", "Megawatt")


@query("hours_in_year_x14", "year:i hours:i n:i", f"""SELECT year(l_shipdate) AS year, {s.hours_sql("year(l_shipdate)")} AS hours, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("year")).agg(F.count(F.lit(1)).alias("n")).withColumn("hours", hours_in_year(F.col("year")))
