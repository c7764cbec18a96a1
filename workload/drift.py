"""Drift between two vintages of the orders table."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.operators import drift as dr
from statloom.plans import benchmarks as b
from statloom.plans import report
from workload import shapes as s
from workload.base import query

LABELS = ("2025h2", "2026h1")

# Every scope of the report, then each measure from bin counts and running shares.
DRIFT_SQL = f"""WITH {s.VINTAGES_SQL},
years AS (SELECT year FROM sides WHERE side = 0 INTERSECT SELECT year FROM sides WHERE side = 1),
techs AS (SELECT technology FROM sides WHERE side = 0 INTERSECT SELECT technology FROM sides WHERE side = 1),
rows AS (SELECT 'price' AS metric, 'overall' AS scope, side, value FROM sides
  UNION ALL SELECT 'price', 'technology=' || technology, side, value FROM sides WHERE technology IN (FROM techs)
  UNION ALL SELECT 'price', 'year=' || year, side, value FROM sides WHERE year IN (FROM years)
  UNION ALL SELECT 'year', 'overall', side, CAST(year AS DOUBLE) FROM sides),
bounds AS (SELECT metric, scope, min(value) AS lo, max(value) AS hi, count(*) FILTER (WHERE side = 0) AS ne, count(*) FILTER (WHERE side = 1) AS na,
  median(value) FILTER (WHERE side = 0) AS me, median(value) FILTER (WHERE side = 1) AS ma FROM rows GROUP BY ALL
  HAVING count(*) FILTER (WHERE side = 0) >= 30 AND count(*) FILTER (WHERE side = 1) >= 30),
binned AS (SELECT r.metric, r.scope, side, least(floor((value - lo) / (hi - lo) * 10), 9) AS b10, least(floor((value - lo) / (hi - lo) * 50), 49) AS b50
  FROM rows r JOIN bounds USING (metric, scope)),
c10 AS (SELECT metric, scope, b10, greatest(count(*) FILTER (WHERE side = 0) / max(ne), 1e-6) AS e, greatest(count(*) FILTER (WHERE side = 1) / max(na), 1e-6) AS a
  FROM binned JOIN bounds USING (metric, scope) GROUP BY 1, 2, 3),
psi AS (SELECT metric, scope, sum((a - e) * ln(a / e)) AS psi FROM c10 GROUP BY ALL),
c50 AS (SELECT metric, scope, b50, count(*) FILTER (WHERE side = 0) / max(ne) AS p, count(*) FILTER (WHERE side = 1) / max(na) AS q
  FROM binned JOIN bounds USING (metric, scope) GROUP BY 1, 2, 3),
js AS (SELECT metric, scope, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END) / 2 + sum(CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 0)) AS js FROM c50 GROUP BY ALL),
cv AS (SELECT metric, scope, value, count(*) FILTER (WHERE side = 0) AS ce, count(*) FILTER (WHERE side = 1) AS ca FROM rows GROUP BY ALL),
run AS (SELECT metric, scope, sum(ce) OVER w / ne AS fe, sum(ca) OVER w / na AS fa FROM cv JOIN bounds USING (metric, scope) WINDOW w AS (PARTITION BY metric, scope ORDER BY value)),
ks AS (SELECT metric, scope, max(abs(fe - fa)) AS ks FROM run GROUP BY ALL),
report AS (SELECT metric, scope, ne AS n_2025h2, na AS n_2026h1, me AS median_2025h2, ma AS median_2026h1, round(100 * (ma - me) / greatest(abs(me), 1e-9), 2) AS median_pct_change,
  round(ks, 4) AS ks_stat, round(js, 4) AS jensen_shannon, round(psi, 4) AS psi, psi > 0.25 AS high_drift_psi_gt_0_25,
  abs(round(100 * (ma - me) / greatest(abs(me), 1e-9), 2)) > 30 AS high_median_drift_gt_30pct,
  psi > 0.25 OR abs(round(100 * (ma - me) / greatest(abs(me), 1e-9), 2)) > 30 AS high_drift_any
  FROM bounds JOIN psi USING (metric, scope) JOIN js USING (metric, scope) JOIN ks USING (metric, scope))"""

REPORT = "metric:s scope:s n_2025h2:i n_2026h1:i median_2025h2:3 median_2026h1:3 median_pct_change:2 ks_stat:4 jensen_shannon:4 psi:4 high_drift_psi_gt_0_25:b high_median_drift_gt_30pct:b high_drift_any:b"


def _report(spark, d):
    old, new = s.vintages(spark, d)
    return dr.drift_report(old, new, "price", LABELS)


@query("drift_report_p25_p26", REPORT, DRIFT_SQL + " SELECT * FROM report")
def _(spark, d):
    return _report(spark, d)


@query("drift_p_values_p25", "metric:s scope:s ks_p_value:4", DRIFT_SQL + """, lam AS (SELECT metric, scope, ks * ks * (ne / CAST(ne + na AS DOUBLE) * na) AS l2 FROM bounds JOIN ks USING (metric, scope))
SELECT metric, scope, CASE WHEN l2 < 0.001 THEN 1.0 ELSE greatest(0.0, least(1.0, 2 * (SELECT sum(CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0 * j * j * l2)) FROM range(1, 101) t(j)))) END AS ks_p_value FROM lam""")
def _(spark, d):
    return _report(spark, d)


@query("quantile_comparison_p27", "quantile:s expected:4 actual:4 pct_change:4", f"""WITH {s.VINTAGES_SQL},
q(quantile, p) AS (VALUES ('p5', 0.05), ('p25', 0.25), ('p50', 0.5), ('p75', 0.75), ('p95', 0.95), ('p99', 0.99)),
x AS (SELECT quantile_cont(value, [0.05, 0.25, 0.5, 0.75, 0.95, 0.99]) FILTER (WHERE side = 0 AND value > 0) AS e, quantile_cont(value, [0.05, 0.25, 0.5, 0.75, 0.95, 0.99]) FILTER (WHERE side = 1 AND value > 0) AS a FROM sides),
y AS (SELECT unnest(['p5', 'p25', 'p50', 'p75', 'p95', 'p99']) AS quantile, unnest(e) AS expected, unnest(a) AS actual FROM x)
SELECT quantile, expected, actual, (actual - expected) / expected * 100 AS pct_change FROM y""")
def _(spark, d):
    old, new = s.vintages(spark, d)
    return dr.quantile_comparison(old, new)


@query("ecdf_p27", "vintage:s value:4 ecdf:6", f"""WITH {s.VINTAGES_SQL}, c AS (SELECT CASE side WHEN 0 THEN '2025h2' ELSE '2026h1' END AS vintage, value, count(*) AS n FROM sides GROUP BY ALL)
SELECT vintage, value, sum(n) OVER (PARTITION BY vintage ORDER BY value) / sum(n) OVER (PARTITION BY vintage) AS ecdf FROM c""")
def _(spark, d):
    old, new = s.vintages(spark, d)
    both = old.select(F.lit(LABELS[0]).alias("vintage"), "value").unionByName(new.select(F.lit(LABELS[1]).alias("vintage"), "value"))
    return dr.ecdf(both, ["vintage"])


@query("drift_counters_q30", "metrics_tested:i psi_high:i median_high:i ks_high:i", DRIFT_SQL + """ SELECT count(*) AS metrics_tested, count(*) FILTER (WHERE psi > 0.25) AS psi_high,
count(*) FILTER (WHERE abs(median_pct_change) > 30) AS median_high, count(*) FILTER (WHERE ks_stat > 0.2) AS ks_high FROM report""")
def _(spark, d):
    return dr.drift_counters(_report(spark, d))


@query("drift_view_q27", "metric:s scope:s psi:4", DRIFT_SQL + " SELECT metric, scope, psi FROM report WHERE high_drift_any")
def _(spark, d):
    return b.drift_view(_report(spark, d), ("n_2025h2", "n_2026h1"), high_only=True)


@query("highest_drift_q30_p29", "metric:s scope:s psi:4", DRIFT_SQL + " SELECT metric, scope, psi FROM report WHERE high_drift_any ORDER BY psi DESC, metric, scope LIMIT 15")
def _(spark, d):
    return report.high_drift(_report(spark, d), 15)
