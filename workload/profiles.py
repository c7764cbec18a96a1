"""Column profiles of the given tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from statloom.operators import profile as p
from statloom.operators.similar import near_duplicates
from statloom.plans import report
from workload import shapes as s
from workload.base import query, table

LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_TEXT = ["l_returnflag", "l_linestatus"]

LINE_CELLS_SQL = "cells AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value FROM lineitem" for c in LINE_NUMBERS) + ")"


def _line(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(*LINE_NUMBERS)


def _line_cells(spark, d) -> DataFrame:
    return p.numeric_cells(_line(spark, d), LINE_NUMBERS)


def _labelled(spark, d) -> DataFrame:
    return s.labelled_documents(spark, d).drop("doc_id")


def _text_tables(spark, d) -> DataFrame:
    """(column, value) of text columns of several tables."""
    part = p.text_cells(table(spark, d, "part"), ["p_name", "p_brand", "p_type"])
    return part.unionByName(p.text_cells(table(spark, d, "orders"), ["o_orderpriority", "o_orderstatus"]))


TEXT_SQL = """cells AS (SELECT 'p_name' AS "column", p_name AS value FROM part UNION ALL SELECT 'p_brand', p_brand FROM part
UNION ALL SELECT 'p_type', p_type FROM part UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders UNION ALL SELECT 'o_orderstatus', o_orderstatus FROM orders),
v AS (SELECT "column", value, count(*) AS n FROM cells GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS place, row_number() OVER (PARTITION BY "column" ORDER BY n, value) AS up,
  sum(n) OVER (PARTITION BY "column") AS total, count(*) OVER (PARTITION BY "column") AS k FROM v)"""


# ---- inventory, roles, schema ------------------------------------------------

CATALOG_TABLES = {"customer": "sales", "orders": "sales", "lineitem": "sales", "part": "goods", "supplier": "goods", "nation": "places", "region": "places"}


def _catalog(spark, d) -> DataFrame:
    out = None
    for name, publisher in CATALOG_TABLES.items():
        t = table(spark, d, name)
        one = p.catalog_row(t, publisher, name, p.column_roles(t))
        out = one if out is None else out.unionByName(one)
    return out


# (numeric, categorical, temporal) columns per table, known from the schemas.
_ROLE_COUNTS = {"customer": (3, 2, 0), "orders": (3, 2, 1), "lineitem": (8, 2, 1), "part": (3, 3, 0), "supplier": (3, 1, 0), "nation": (2, 1, 0), "region": (1, 1, 0)}
CATALOG_SQL = "cat AS (" + " UNION ALL ".join(
    f"SELECT '{CATALOG_TABLES[t]}' AS publisher, '{t}' AS sheet_id, (SELECT count(*) FROM {t}) AS n_rows, {n} AS n_numeric, {c} AS n_categorical, {x} AS n_temporal"
    for t, (n, c, x) in _ROLE_COUNTS.items()
) + "), tiered AS (SELECT *, CASE WHEN n_rows < 50 THEN 'T3' WHEN n_rows >= 200 AND n_numeric + n_categorical >= 4 THEN 'T1' ELSE 'T2' END AS tier FROM cat)"


@query("catalog_roles_tiers_p2_p3_s8", "publisher:s sheet_id:s tier:s n_rows:i n_numeric:i n_categorical:i n_temporal:i",
       f"WITH {CATALOG_SQL} SELECT * FROM tiered")
def _(spark, d):
    return _catalog(spark, d)


@query("inventory_by_tier_p1", "tier:s n_sheets:i n_rows:i", f"WITH {CATALOG_SQL} SELECT tier, count(*) AS n_sheets, sum(n_rows) AS n_rows FROM tiered GROUP BY 1")
def _(spark, d):
    return p.inventory(_catalog(spark, d), "tier")


@query("inventory_by_publisher_p1", "publisher:s n_sheets:i n_rows:i", f"WITH {CATALOG_SQL} SELECT publisher, count(*) AS n_sheets, sum(n_rows) AS n_rows FROM tiered GROUP BY 1")
def _(spark, d):
    return p.inventory(_catalog(spark, d), "publisher")


def _schema_input(spark, d) -> DataFrame:
    """Labelled documents plus a text column that is two thirds numbers and a raw shadow."""
    x = _labelled(spark, d)
    mixed = F.when(F.col("n_chars") % 3 == 0, F.concat(F.lit("about "), F.col("n_chars"))).otherwise(F.col("n_chars").cast("string"))
    return x.withColumns({"size": mixed, "raw__lang": F.col("lang")})


SCHEMA_SQL = f"""WITH {s.LABELLED_SQL}, x AS (SELECT *, CASE WHEN n_chars % 3 = 0 THEN 'about ' || n_chars ELSE CAST(n_chars AS VARCHAR) END AS size, lang AS raw__lang FROM labelled),
c AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{t}' AS dtype, CAST({c} AS VARCHAR) AS value FROM x"
    for c, t in (("lang", "string"), ("source", "string"), ("n_chars", "bigint"), ("quality", "int"), ("toxic", "int"), ("size", "string"), ("raw__lang", "string"))
) + """), r AS (SELECT "column", dtype, count(*) AS n_total, count(*) - count(value) AS n_null, count(DISTINCT value) AS n_unique,
avg(CASE WHEN value IS NULL THEN NULL WHEN regexp_full_match(value, '[0-9]+') THEN 1.0 ELSE 0.0 END) AS share FROM c GROUP BY 1, 2)
SELECT "column", dtype, n_total, n_null, 100.0 * n_null / n_total AS null_pct, n_unique, 100.0 * n_unique / (n_total - n_null) AS uniq_pct,
"column" = 'raw__lang' AS is_raw_shadow, CASE WHEN dtype = 'string' THEN share END AS object_with_numeric_share,
coalesce(dtype = 'string' AND share > 0.05 AND share < 0.95, false) AS mixed_type_residue FROM r"""


@query("schema_report_p4", "column:s dtype:s n_total:i n_null:i null_pct:2 n_unique:i uniq_pct:2 is_raw_shadow:b object_with_numeric_share:4 mixed_type_residue:b", SCHEMA_SQL)
def _(spark, d):
    return p.schema_report(_schema_input(spark, d))


@query("mixed_columns_report_p29", "column:s n_unique:i", f"""SELECT 'size' AS "column", count(DISTINCT n_chars) AS n_unique FROM documents""")
def _(spark, d):
    return report.mixed_columns(p.schema_report(_schema_input(spark, d)))


# ---- missingness -------------------------------------------------------------

NULLS_SQL = f"""{s.LABELLED_SQL}, n AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) AS n, count(*) - count({c}) AS n_null FROM labelled" for c in ("lang", "source", "n_chars", "quality", "toxic")
) + ")"


@query("null_profile_p5", "column:s n:i n_null:i null_share:6", f"WITH {NULLS_SQL} SELECT *, n_null / n AS null_share FROM n")
def _(spark, d):
    return p.null_profile(_labelled(spark, d))


@query("null_summary_p5", "n_cells:i n_null_cells:i null_pct:2 cols_all_null:i cols_no_null:i cols_high_null_50pct:i", f"""WITH {NULLS_SQL}
SELECT sum(n) AS n_cells, sum(n_null) AS n_null_cells, 100 * avg(n_null / n) AS null_pct, count(*) FILTER (WHERE n_null = n) AS cols_all_null,
count(*) FILTER (WHERE n_null = 0) AS cols_no_null, count(*) FILTER (WHERE n_null / n >= 0.5) AS cols_high_null_50pct FROM n""")
def _(spark, d):
    return p.null_summary(p.null_profile(_labelled(spark, d)))


@query("null_pairs_p6", "col_a:s col_b:s null_corr:4", f"""WITH {s.LABELLED_SQL}
SELECT 'quality' AS col_a, 'toxic' AS col_b, corr(CASE WHEN quality IS NULL THEN 1.0 ELSE 0 END, CASE WHEN toxic IS NULL THEN 1.0 ELSE 0 END) AS null_corr FROM labelled""")
def _(spark, d):
    return p.null_pairs(_labelled(spark, d))


@query("missing_by_quartile_p7", "missing_in:s varies_with:s null_share_min:4 null_share_max:4 spread:4", """WITH x AS (SELECT l_quantity AS y, CASE WHEN l_quantity > 20 THEN NULLIF(l_tax, 0.03) END AS t FROM lineitem),
q AS (SELECT min(y) AS q0, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.5) AS q2, quantile_cont(y, 0.75) AS q3 FROM x),
b AS (SELECT CASE WHEN y <= q1 THEN 0 WHEN y <= q2 THEN 1 WHEN y <= q3 THEN 2 ELSE 3 END AS b, avg(CASE WHEN t IS NULL THEN 1.0 ELSE 0.0 END) AS share FROM x, q GROUP BY 1)
SELECT 'l_tax' AS missing_in, 'l_quantity' AS varies_with, min(share) AS null_share_min, max(share) AS null_share_max, max(share) - min(share) AS spread FROM b""")
def _(spark, d):
    x = table(spark, d, "lineitem").select("l_quantity", F.when(F.col("l_quantity") > 20, F.nullif("l_tax", F.lit(0.03))).alias("l_tax"))
    return p.missing_by_quartile(x, ["l_quantity"])


# ---- numeric -----------------------------------------------------------------

DESC_SQL = f"""WITH {LINE_CELLS_SQL}, q AS (SELECT "column", count(*) AS n, count(DISTINCT value) AS n_unique, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max,
quantile_cont(value, 0.01) AS p01, quantile_cont(value, 0.05) AS p05, quantile_cont(value, 0.25) AS p25, median(value) AS median, quantile_cont(value, 0.75) AS p75,
quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99, mad(value) AS mad, skewness(value) AS skew, kurtosis(value) AS kurtosis,
avg(CASE WHEN value = 0 THEN 1.0 ELSE 0.0 END) AS zero_share, avg(CASE WHEN value < 0 THEN 1.0 ELSE 0.0 END) AS negative_share FROM cells GROUP BY 1)"""


@query("numeric_descriptives_p8", "column:s n:i n_unique:i mean:5 std:5 min:4 p01:5 p05:5 p25:5 median:5 p75:5 p95:5 p99:5 max:4 iqr:5 mad:5 skew:5 kurtosis:5 zero_share:6 negative_share:6 constant:b",
       DESC_SQL + " SELECT *, p75 - p25 AS iqr, n_unique <= 1 AS constant FROM q")
def _(spark, d):
    return p.numeric_descriptives(_line_cells(spark, d), ["column"])


@query("most_skewed_report_p29", "column:s skew:4", DESC_SQL + ' SELECT "column", skew FROM q ORDER BY skew DESC LIMIT 2')
def _(spark, d):
    return report.most_skewed(p.numeric_descriptives(_line_cells(spark, d), ["column"]), 2)


@query("distribution_flags_p12", "column:s n:i bimodality_coefficient:4 bimodal_likely:b zero_inflation:4 n_nonzero:i heavy_tail:b log_scale_recommended:b", DESC_SQL + """
SELECT "column", n, b AS bimodality_coefficient, coalesce(b > 0.555, false) AS bimodal_likely, zero_share AS zero_inflation, nz AS n_nonzero, abs(skew) > 2 AS heavy_tail,
min > 0 AND max / greatest(min, 1e-9) > 100 AS log_scale_recommended FROM (SELECT q.*, (skew * skew + 1) / (kurtosis + 3.0 * (n - 1) * (n - 1) / (CAST(n - 2 AS DOUBLE) * (n - 3))) AS b,
(SELECT count(*) FROM cells c WHERE c."column" = q."column" AND value <> 0) AS nz FROM q)""")
def _(spark, d):
    return p.distribution_flags(_line_cells(spark, d), ["column"])


@query("histogram_p13", "column:s bin:i n:i bin_low:2", """WITH x AS (SELECT 'value' AS "column", value AS v FROM events),
q AS (SELECT quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b, count(*) AS n, min(v) AS lo, max(v) AS hi FROM x),
w AS (SELECT lo, hi, CAST(greatest(5, ceil((hi - lo) / (2.0 * (b - a) * power(n, CAST(-1 AS DOUBLE) / 3)))) AS BIGINT) AS bins FROM q)
SELECT "column", least(floor((v - lo) / (hi - lo) * bins), bins - 1) AS bin, count(*) AS n, lo + least(floor((v - lo) / (hi - lo) * bins), bins - 1) * ((hi - lo) / bins) AS bin_low
FROM x, w GROUP BY 1, 2, 4""")
def _(spark, d):
    return p.histogram(p.numeric_cells(table(spark, d, "events"), ["value"]), ["column"])


@query("histogram_of_many_bins_p13", "column:s bin:i n:i", """WITH p2 AS (SELECT o_totalprice * o_totalprice AS v FROM orders), p4 AS (SELECT v * v AS v FROM p2), x AS (SELECT 'v' AS "column", v * v AS v FROM p4),
q AS (SELECT quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b, count(*) AS n, min(v) AS lo, max(v) AS hi FROM x),
w AS (SELECT lo, hi, CAST(greatest(5, ceil((hi - lo) / (2.0 * (b - a) * power(n, CAST(-1 AS DOUBLE) / 3)))) AS BIGINT) AS bins FROM q)
SELECT "column", least(floor((v - lo) / (hi - lo) * bins), bins - 1) AS bin, count(*) AS n FROM x, w GROUP BY 1, 2""")
def _(spark, d):
    powers = table(spark, d, "orders").select(F.col("o_totalprice").alias("v"))
    for _ in range(3):
        powers = powers.select((F.col("v") * F.col("v")).alias("v"))
    return p.histogram(p.numeric_cells(powers, ["v"]), ["column"])


OUTLIER_CELLS = """cells AS (SELECT 'value' AS "column", value AS v FROM events UNION ALL SELECT 'o_totalprice', o_totalprice FROM orders
UNION ALL SELECT 'c_acctbal', c_acctbal FROM customer)"""


def _outlier_cells(spark, d) -> DataFrame:
    e = p.numeric_cells(table(spark, d, "events"), ["value"])
    return e.unionByName(p.numeric_cells(table(spark, d, "orders"), ["o_totalprice"])).unionByName(p.numeric_cells(table(spark, d, "customer"), ["c_acctbal"]))


OUTLIER_SQL = f"""WITH {OUTLIER_CELLS}, q AS (SELECT "column", quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, median(v) AS med, mad(v) AS mad,
median(CASE WHEN v > 0 THEN ln(v) END) AS lmed, mad(CASE WHEN v > 0 THEN ln(v) END) AS lmad FROM cells GROUP BY 1),
m AS (SELECT "column", v, v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1) AS t, abs(0.6745 * (v - med)) > 3.5 * mad AS z,
coalesce(abs(0.6745 * (CASE WHEN v > 0 THEN ln(v) END - lmed)) > 3.5 * lmad, false) AS l FROM cells JOIN q USING ("column")),
c AS (SELECT "column", count(*) AS n_non_null, count(*) FILTER (WHERE t) AS n_tukey, count(*) FILTER (WHERE z) AS n_modified_z, count(*) FILTER (WHERE l) AS n_log_mad,
count(*) FILTER (WHERE t AND z AND l) AS n_agree_all_three FROM m GROUP BY 1)
SELECT *, greatest(n_tukey, n_modified_z, n_log_mad) - least(n_tukey, n_modified_z, n_log_mad) AS method_disagreement, n_log_mad / n_non_null AS share_log_mad
FROM c WHERE greatest(n_tukey, n_modified_z, n_log_mad) > 0"""


@query("outlier_register_p14", "column:s n_non_null:i n_tukey:i n_modified_z:i n_log_mad:i n_agree_all_three:i method_disagreement:i share_log_mad:4", OUTLIER_SQL)
def _(spark, d):
    return p.outlier_register(_outlier_cells(spark, d), ["column"])


@query("most_outliers_report_p29", "column:s n_log_mad:i", f'SELECT "column", n_log_mad FROM ({OUTLIER_SQL}) ORDER BY share_log_mad DESC, 1 LIMIT 2')
def _(spark, d):
    return report.most_outliers(p.outlier_register(_outlier_cells(spark, d), ["column"]), 2)


# ---- categorical -------------------------------------------------------------

CAT_SQL = f"""WITH {TEXT_SQL} SELECT "column", max(total) AS n_non_null, max(k) AS n_unique, max(k) / max(total) AS uniq_share, max(CASE WHEN place = 1 THEN value END) AS top_value,
max(CASE WHEN place = 1 THEN n END) / max(total) AS top_share, coalesce(max(CASE WHEN place = 2 THEN value END), '') AS second_value,
coalesce(max(CASE WHEN place = 2 THEN n END) / max(total), 0) AS second_share, count(*) FILTER (WHERE n = 1) AS singleton_value_count,
-sum(n / total * log2(n / total)) AS shannon_entropy_bits, log2(max(k)) AS max_entropy_bits, count(*) FILTER (WHERE n <= 3) / max(k) AS rare_share_le_3,
(max(k) + 1 - 2.0 * sum((k + 1 - up) * n) / max(total)) / max(k) AS gini_concentration, max(k) <= 1 AS constant FROM r GROUP BY 1"""


@query("categorical_descriptives_p9", "column:s n_non_null:i n_unique:i top_value:s top_share:4 singleton_value_count:i shannon_entropy_bits:4 max_entropy_bits:4 constant:b", CAT_SQL)
def _(spark, d):
    return p.categorical_profile(_text_tables(spark, d), ["column"])


@query("categorical_profile_p10", "column:s uniq_share:4 second_value:s second_share:4 gini_concentration:4 rare_share_le_3:4", CAT_SQL)
def _(spark, d):
    return p.categorical_profile(_text_tables(spark, d), ["column"])


@query("most_informative_report_p29", "column:s shannon_entropy_bits:4", f'SELECT "column", shannon_entropy_bits FROM ({CAT_SQL}) ORDER BY 2 DESC LIMIT 3')
def _(spark, d):
    return report.most_informative(p.categorical_profile(_text_tables(spark, d), ["column"]), 3)


@query("high_cardinality_report_p29", "column:s n_unique:i", f'SELECT "column", n_unique FROM ({CAT_SQL}) ORDER BY 2 DESC, 1 LIMIT 3')
def _(spark, d):
    return report.high_cardinality(p.categorical_profile(_text_tables(spark, d), ["column"]), 3)


@query("lorenz_curve_w7_p10", "column:s count_each:i n_values:i cum_share:6", f"""WITH {TEXT_SQL}, f AS (SELECT "column", n AS count_each, count(*) AS n_values FROM v GROUP BY ALL)
SELECT *, sum(count_each * n_values) OVER (PARTITION BY "column" ORDER BY count_each DESC) / sum(count_each * n_values) OVER (PARTITION BY "column") AS cum_share FROM f""")
def _(spark, d):
    from statloom.operators.ordered import value_counts

    return p.lorenz_curve(value_counts(_text_tables(spark, d), ["column"], "value"), ["column"])


@query("near_duplicates_p11", "column:s value_a:s value_b:s fuzz_score:i count_a:i count_b:i")
def _(spark, d):
    names = p.text_cells(table(spark, d, "part"), ["p_name"]).unionByName(p.text_cells(table(spark, d, "nation"), ["n_name"]))
    return near_duplicates(names, ["column"])


# ---- temporal ----------------------------------------------------------------

COVERAGE_SQL = """days AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders),
steps AS (SELECT *, lag(day) OVER w AS prev, datediff('day', lag(day) OVER w, day) AS step FROM days WINDOW w AS (PARTITION BY o_custkey ORDER BY day)),
mid AS (SELECT o_custkey, coalesce(CAST(floor(median(step)) AS BIGINT), 0) AS m FROM steps GROUP BY 1),
lim AS (SELECT steps.*, m, greatest(1, CAST(floor(m * 1.5) AS BIGINT)) AS lim FROM steps JOIN mid USING (o_custkey))"""


def _coverage(spark, d):
    dates = table(spark, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("date"))
    return p.temporal_coverage(dates, ["o_custkey"])


@query("temporal_coverage_p15", "o_custkey:i n_unique_dates:i min_date:d max_date:d span_days:i median_step_days:i n_gaps_gt_1_5x_step:i", f"""WITH {COVERAGE_SQL}
SELECT o_custkey, count(*) AS n_unique_dates, min(day) AS min_date, max(day) AS max_date, datediff('day', min(day), max(day)) AS span_days, max(m) AS median_step_days,
count(*) FILTER (WHERE step > lim) AS n_gaps_gt_1_5x_step FROM lim GROUP BY 1""")
def _(spark, d):
    return _coverage(spark, d)[0]


@query("temporal_far_dates_p15", "o_orderpriority:s n_unique_dates:i n_dates_outside:i min_date:d max_date:d", """WITH days AS (SELECT DISTINCT o_orderpriority, CASE o_orderkey % 3 WHEN 0 THEN CAST(o_orderdate AS DATE) - INTERVAL 900 YEAR
WHEN 1 THEN CAST(o_orderdate AS DATE) ELSE CAST(o_orderdate AS DATE) + INTERVAL 400 YEAR END AS day FROM orders)
SELECT o_orderpriority, count(*) FILTER (WHERE year(day) BETWEEN 1700 AND 2199) AS n_unique_dates, count(*) FILTER (WHERE year(day) NOT BETWEEN 1700 AND 2199) AS n_dates_outside,
min(CASE WHEN year(day) BETWEEN 1700 AND 2199 THEN day END) AS min_date, max(CASE WHEN year(day) BETWEEN 1700 AND 2199 THEN day END) AS max_date FROM days GROUP BY 1""")
def _(spark, d):
    years = F.when(F.col("o_orderkey") % 3 == 0, -900).when(F.col("o_orderkey") % 3 == 1, 0).otherwise(400)
    dates = table(spark, d, "orders").select("o_orderpriority", F.add_months(F.to_date("o_orderdate"), years * 12).alias("date"))
    return p.temporal_coverage(dates, ["o_orderpriority"])[0]


@query("temporal_gaps_p15", "o_custkey:i from_date:d to_date:d gap_days:i", f"WITH {COVERAGE_SQL} SELECT o_custkey, prev AS from_date, day AS to_date, step AS gap_days FROM lim WHERE step > lim")
def _(spark, d):
    return _coverage(spark, d)[1]


# ---- correlation -------------------------------------------------------------

PAIRS = [(a, b) for i, a in enumerate(LINE_NUMBERS) for b in LINE_NUMBERS[i + 1:]]
PEARSON_SQL = " UNION ALL ".join(f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 4) AS pearson FROM lineitem" for a, b in PAIRS)


@query("pearson_pairs_p16", "col_a:s col_b:s pearson:4", PEARSON_SQL)
def _(spark, d):
    line = _line(spark, d)
    return p.pearson_pairs(line, p.correlation_columns(line, LINE_NUMBERS))


@query("pearson_matrix_p16", "column:s l_discount:4 l_tax:4", f"""WITH x AS ({PEARSON_SQL}), y AS (SELECT * FROM x UNION ALL SELECT col_b, col_a, pearson FROM x)
SELECT col_a AS "column", max(CASE WHEN col_b = 'l_discount' THEN pearson END) AS l_discount, max(CASE WHEN col_b = 'l_tax' THEN pearson END) AS l_tax FROM y GROUP BY 1""")
def _(spark, d):
    return p.correlation_matrix(p.pearson_pairs(_line(spark, d), LINE_NUMBERS), LINE_NUMBERS, "pearson")


@query("spearman_pairs_p17", "col_a:s col_b:s spearman:4", """WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS a,
rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS b,
rank() OVER (ORDER BY p_partkey) AS c FROM part)
SELECT 'p_size' AS col_a, 'p_retailprice' AS col_b, corr(a, b) AS spearman FROM r UNION ALL SELECT 'p_size', 'p_partkey', corr(a, c) FROM r
UNION ALL SELECT 'p_retailprice', 'p_partkey', corr(b, c) FROM r""")
def _(spark, d):
    return p.spearman_pairs(table(spark, d, "part"), ["p_size", "p_retailprice", "p_partkey"])


RANKED = {f"c{i}": f"(p_partkey * {2 * i + 3} + p_size * {i % 4}) % {97 + 10 * i}" for i in range(30)}


@query("spearman_thirty_columns_p17", "col_a:s col_b:s spearman:4", "WITH x AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in RANKED.items()) + " FROM part), r AS (SELECT "
       + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in RANKED) + " FROM x) "
       + " UNION ALL ".join(f"SELECT '{a}' AS col_a, '{b}' AS col_b, corr({a}, {b}) AS spearman FROM r" for a, b in combinations(RANKED, 2)))
def _(spark, d):
    return p.spearman_pairs(table(spark, d, "part").selectExpr(*[f"{e} AS {c}" for c, e in RANKED.items()]), list(RANKED))


@query("spearman_with_nulls_p17", "col_a:s col_b:s spearman:4", """WITH x AS (SELECT l_quantity AS q, CASE WHEN l_linenumber < 6 THEN l_extendedprice END AS e, l_partkey AS k FROM lineitem),
a AS (SELECT 'q' AS col_a, 'e' AS col_b, q AS u, e AS v FROM x WHERE e IS NOT NULL UNION ALL SELECT 'q', 'k', q, k FROM x UNION ALL SELECT 'e', 'k', e, k FROM x WHERE e IS NOT NULL),
r AS (SELECT col_a, col_b, rank() OVER (PARTITION BY col_a, col_b ORDER BY u) + (count(*) OVER (PARTITION BY col_a, col_b, u) - 1) / 2.0 AS u,
rank() OVER (PARTITION BY col_a, col_b ORDER BY v) + (count(*) OVER (PARTITION BY col_a, col_b, v) - 1) / 2.0 AS v FROM a)
SELECT col_a, col_b, corr(u, v) AS spearman FROM r GROUP BY 1, 2""")
def _(spark, d):
    x = table(spark, d, "lineitem").selectExpr("l_quantity AS q", "CASE WHEN l_linenumber < 6 THEN l_extendedprice END AS e", "l_partkey AS k")
    return p.spearman_pairs(x, ["q", "e", "k"])


@query("collinear_pairs_p18", "col_a:s col_b:s pearson:4", "SELECT 'l_extendedprice' AS col_a, 'net' AS col_b, corr(l_extendedprice, l_extendedprice * (1 - l_discount)) AS pearson FROM lineitem")
def _(spark, d):
    line = _line(spark, d).withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return p.collinear_pairs(p.pearson_pairs(line, [*LINE_NUMBERS, "net"]))


def _decile(c: str) -> str:
    return " + ".join(f"CASE WHEN {c} > e{c}[{i}] THEN 1 ELSE 0 END" for i in range(1, 10))


@query("binned_dependency_p19", "feature:s target_proxy:s mutual_information:4", f"""WITH e AS (SELECT {', '.join(f'quantile_cont({c}, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS e{c}' for c in LINE_NUMBERS)} FROM lineitem),
b AS (SELECT {', '.join(f'{_decile(c)} AS b{c}' for c in LINE_NUMBERS)} FROM lineitem, e),
l AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, b{c} AS f, bl_quantity AS t FROM b" for c in LINE_NUMBERS[1:])}),
j AS (SELECT feature, f, t, count(*) AS n FROM l GROUP BY ALL),
w AS (SELECT feature, n / sum(n) OVER (PARTITION BY feature) AS p, sum(n) OVER (PARTITION BY feature, f) / sum(n) OVER (PARTITION BY feature) AS pf,
sum(n) OVER (PARTITION BY feature, t) / sum(n) OVER (PARTITION BY feature) AS pt FROM j)
SELECT feature, 'l_quantity' AS target_proxy, sum(p * ln(p / (pf * pt))) AS mutual_information FROM w GROUP BY 1""")
def _(spark, d):
    return p.binned_dependency(_line(spark, d), "l_quantity", LINE_NUMBERS[1:])


# ---- duplicates and equality -------------------------------------------------

@query("composite_keys_p20", "composite_keys:s", "SELECT 'p_name,p_brand,p_type' AS composite_keys FROM part LIMIT 1")
def _(spark, d):
    part = table(spark, d, "part")
    return part.agg(F.lit(",".join(p.composite_keys(part))).alias("composite_keys"))


@query("duplicate_summary_p20", "n_rows:i n_exact_duplicates:i exact_dup_pct:2 n_key_collisions:i key_collision_pct:2", """WITH x AS (SELECT p_name, p_brand, p_type, p_size FROM part),
e AS (SELECT count(*) AS n FROM x GROUP BY p_name, p_brand, p_type, p_size), k AS (SELECT count(*) AS n FROM x GROUP BY p_name, p_brand, p_type)
SELECT (SELECT count(*) FROM x) AS n_rows, (SELECT coalesce(sum(n), 0) FROM e WHERE n > 1) AS n_exact_duplicates, 100.0 * (SELECT coalesce(sum(n), 0) FROM e WHERE n > 1) / (SELECT count(*) FROM x) AS exact_dup_pct,
(SELECT coalesce(sum(n), 0) FROM k WHERE n > 1) AS n_key_collisions, 100.0 * (SELECT coalesce(sum(n), 0) FROM k WHERE n > 1) / (SELECT count(*) FROM x) AS key_collision_pct""")
def _(spark, d):
    part = table(spark, d, "part").select("p_name", "p_brand", "p_type", "p_size")
    return p.duplicate_summary(part, ["p_name", "p_brand", "p_type"])


@query("duplicate_documents_d6_p20", "n_duplicate_rows:i", """SELECT coalesce(sum(n), 0) AS n_duplicate_rows FROM (SELECT count(*) AS n FROM documents GROUP BY text, lang) WHERE n > 1""")
def _(spark, d):
    from statloom.operators.cleaning import duplicate_rows

    # Long texts travel as digests: two 64-bit hashes and the length stand for the text.
    docs = table(spark, d, "documents").select(F.sha2("text", 256).alias("text"), "lang")
    return duplicate_rows(docs, ["text", "lang"])


@query("key_collision_samples_p20", "p_name:s p_brand:s group_size:i", "SELECT p_name, p_brand, count(*) AS group_size FROM part GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, d):
    return p.duplicate_samples(table(spark, d, "part"), ["p_name", "p_brand"])


KEY_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate"]
KEY_SETS = [s for k in (1, 2, 3) for s in combinations(KEY_COLUMNS, k)]
KEYS_SQL = "WITH u AS (" + " UNION ALL ".join(f"SELECT {[*s]} AS s, (SELECT count(*) FROM (SELECT DISTINCT {', '.join(s)} FROM lineitem)) = (SELECT count(*) FROM lineitem) AS is_key" for s in KEY_SETS) + """)
SELECT array_to_string(a.s, ',') AS key_columns, len(a.s) AS n_columns FROM u a WHERE a.is_key AND NOT EXISTS (SELECT 1 FROM u b WHERE b.is_key AND len(b.s) < len(a.s) AND list_has_all(a.s, b.s))"""


@query("minimal_keys_p20", "key_columns:s n_columns:i", KEYS_SQL)
def _(spark, d):
    return p.minimal_keys(table(spark, d, "lineitem"), KEY_COLUMNS)


@query("table_equality_p21", "pivot_rows:i country_rows:i row_delta:i n_common_cols:i cols_only_in_pivot:s cols_only_in_country:s rows_only_in_pivot:i rows_only_in_country:i pivot_unique_after_dedup:i verdict:s", """
WITH r AS (SELECT c_custkey, c_mktsegment, c_acctbal FROM customer), l AS (SELECT c_custkey, c_mktsegment, c_acctbal FROM customer UNION ALL SELECT c_custkey + 1000000000, c_mktsegment, c_acctbal FROM customer WHERE c_acctbal < 0)
SELECT (SELECT count(*) FROM l) AS pivot_rows, (SELECT count(*) FROM r) AS country_rows, (SELECT count(*) FROM l) - (SELECT count(*) FROM r) AS row_delta, 3 AS n_common_cols,
'extra' AS cols_only_in_pivot, '' AS cols_only_in_country, (SELECT count(*) FROM (SELECT * FROM l EXCEPT SELECT * FROM r)) AS rows_only_in_pivot,
(SELECT count(*) FROM (SELECT * FROM r EXCEPT SELECT * FROM l)) AS rows_only_in_country, (SELECT count(*) FROM (SELECT DISTINCT * FROM l)) AS pivot_unique_after_dedup, 'near_identical_pivot_extra' AS verdict""")
def _(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    more = c.where(F.col("c_acctbal") < 0).withColumn("c_custkey", F.col("c_custkey") + 1_000_000_000)
    pivot = c.unionByName(more).select("c_custkey", "c_mktsegment", F.col("c_acctbal").alias("sum_of_c_acctbal"), F.lit(1).alias("extra"))
    return p.table_equality(pivot, c)


# ---- units, scorecard, health ------------------------------------------------

@query("unit_register_p22", "column:s unit_hint:s n_below_min:i n_above_max:i actual_min:2 actual_max:2 n_total:i", """SELECT 'energy_gwh' AS "column", '_gwh' AS unit_hint,
count(*) FILTER (WHERE c_acctbal < 0) AS n_below_min, 0 AS n_above_max, min(c_acctbal) AS actual_min, max(c_acctbal) AS actual_max, count(*) AS n_total FROM customer
UNION ALL SELECT 'share_pct', '_pct', count(*) FILTER (WHERE c_acctbal < -100), count(*) FILTER (WHERE c_acctbal > 100), min(c_acctbal), max(c_acctbal), count(*) FROM customer""")
def _(spark, d):
    x = table(spark, d, "customer").select(F.col("c_acctbal").alias("energy_gwh"), F.col("c_acctbal").alias("share_pct"), F.col("c_acctbal").alias("plain"))
    return p.unit_register(x, x.columns)


@query("magnitude_alignment_p23", "logical_metric:s source:s n:i min:2 p50:4 p99:4 max:2", """SELECT 'price' AS logical_metric, 'orders' AS source, count(*) AS n, min(o_totalprice) AS min, median(o_totalprice) AS p50,
quantile_cont(o_totalprice, 0.99) AS p99, max(o_totalprice) AS max FROM orders UNION ALL SELECT 'price', 'lineitem', count(*), min(l_extendedprice), median(l_extendedprice), quantile_cont(l_extendedprice, 0.99), max(l_extendedprice) FROM lineitem""")
def _(spark, d):
    def side(t, c):
        return table(spark, d, t).select(F.lit("price").alias("logical_metric"), F.lit(t).alias("source"), F.col(c).alias("value"))

    return p.magnitude_alignment(side("orders", "o_totalprice").unionByName(side("lineitem", "l_extendedprice")), ["logical_metric", "source"])


def _scorecard(spark, d) -> DataFrame:
    x = table(spark, d, "lineitem").select(
        "l_quantity", "l_extendedprice", (F.col("l_extendedprice") * 1.2).alias("gross"), F.lit(7.0).alias("same"),
        F.when(F.col("l_tax") == 0.01, F.col("l_tax")).alias("rare_tax"), (1000.0 + F.col("l_discount")).alias("flat"), "l_returnflag")
    roles = p.Roles(["l_quantity", "l_extendedprice", "gross", "same", "rare_tax", "flat"], ["l_returnflag"], [])
    keep = [c for c in roles.numeric if c not in ("same", "rare_tax")]
    return p.feature_scorecard(x, roles, p.collinear_pairs(p.pearson_pairs(x, keep)))


SCORE_SQL = """WITH x AS (SELECT l_quantity, l_extendedprice, l_extendedprice * 1.2 AS gross, CASE WHEN l_tax = 0.01 THEN l_tax END AS rare_tax, 1000 + l_discount AS flat, l_returnflag FROM lineitem),
s AS (SELECT 'l_quantity' AS "column", 'numeric' AS kind, 0.0 AS null_pct, count(DISTINCT l_quantity) AS n_unique, false AS constant, false AS variance_low, false AS redundant, 'high' AS category FROM x
UNION ALL SELECT 'l_extendedprice', 'numeric', 0, count(DISTINCT l_extendedprice), false, false, true, 'dangerous' FROM x
UNION ALL SELECT 'gross', 'numeric', 0, count(DISTINCT gross), false, false, true, 'dangerous' FROM x
UNION ALL SELECT 'same', 'numeric', 0, least(count(*), 1), true, true, false, 'drop' FROM x
UNION ALL SELECT 'rare_tax', 'numeric', round(100.0 * count(*) FILTER (WHERE rare_tax IS NULL) / count(*), 2), 1, true, true, false, 'drop' FROM x
UNION ALL SELECT 'flat', 'numeric', 0, count(DISTINCT flat), false, true, false, 'weak' FROM x
UNION ALL SELECT 'l_returnflag', 'categorical', 0, count(DISTINCT l_returnflag), false, false, false, 'high' FROM x)"""


@query("feature_scorecard_p24", "column:s kind:s null_pct:2 n_unique:i constant:b redundant:b category:s", SCORE_SQL + " SELECT * FROM s")
def _(spark, d):
    return _scorecard(spark, d)


@query("category_counts_report_p29", "category:s n:i", SCORE_SQL + " SELECT category, count(*) AS n FROM s GROUP BY 1")
def _(spark, d):
    return report.category_counts(_scorecard(spark, d))


@query("dangerous_features_report_p29", "column:s", SCORE_SQL + """ SELECT "column" FROM s WHERE category = 'dangerous'""")
def _(spark, d):
    return report.features_of(_scorecard(spark, d), "dangerous")


@query("table_health_p28", "sheet_id:s tier:s rag:s null_pct:1 n_exact_duplicates:i", f"""WITH {s.LABELLED_SQL},
h AS (SELECT 'documents' AS sheet_id, (SELECT 100 * (avg(CASE WHEN quality IS NULL THEN 1.0 ELSE 0 END) + avg(CASE WHEN toxic IS NULL THEN 1.0 ELSE 0 END)) / 5 FROM labelled) AS null_pct,
(SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM labelled GROUP BY lang, source, n_chars, quality, toxic) WHERE n > 1) AS dup, (SELECT count(*) FROM labelled) AS n
UNION ALL SELECT 'orders', 0, 0, (SELECT count(*) FROM orders))
SELECT sheet_id, CASE WHEN n < 50 THEN 'T3' WHEN n >= 200 THEN 'T1' ELSE 'T2' END AS tier,
CASE WHEN n < 50 THEN 'n/a (metadata)' WHEN null_pct >= 50 THEN 'RED' WHEN null_pct >= 25 OR dup > 0 THEN 'AMBER' ELSE 'GREEN' END AS rag, null_pct, dup AS n_exact_duplicates FROM h""")
def _(spark, d):
    docs, orders = _labelled(spark, d), table(spark, d, "orders")
    keyed = lambda df, name: df.select(F.lit(name).alias("sheet_id"), "*")
    catalog = p.catalog_row(docs, "x", "documents", p.column_roles(docs)).unionByName(p.catalog_row(orders, "x", "orders", p.column_roles(orders)))
    nulls = keyed(p.null_summary(p.null_profile(docs)), "documents").unionByName(keyed(p.null_summary(p.null_profile(orders)), "orders"))
    schema = keyed(p.schema_report(docs), "documents").unionByName(keyed(p.schema_report(orders), "orders"))
    dup = keyed(p.duplicate_summary(docs, []), "documents").unionByName(keyed(p.duplicate_summary(orders, ["o_orderkey"]), "orders"))
    return p.health(catalog, nulls, schema, dup, ["sheet_id"])


@query("sheet_explorer_p32", "column:s n:i mean:4 median:4 p05:4 p95:4 iqr:4 zero_share:6", DESC_SQL + ' SELECT *, p75 - p25 AS iqr FROM q')
def _(spark, d):
    return p.numeric_descriptives(_line_cells(spark, d), ["column"])
