from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.operators import drift, fit, profile, relational, series
from statloom.operators.similar import near_duplicates
from statloom.plans import benchmarks, facts


def test_drift_of_equal_shifted_constant_and_short_pairs(spark):
    rows = [("same", float(i)) for i in range(100)] + [("flat", 5.0)] * 40 + [("short", float(i)) for i in range(29)] + [("moved", float(i)) for i in range(100)]
    other = [(k, v + (80.0 if k == "moved" else 0.0)) for k, v in rows]
    a, b = (spark.createDataFrame(r, "scope string, value double") for r in (rows, other))
    for small in (True, False):
        got = {r["scope"]: r for r in drift.drift_measures(a, b, ["scope"], small=small).collect()}
        assert set(got) == {"same", "flat", "moved"}
        assert got["same"]["psi"] == got["same"]["ks_stat"] == got["same"]["jensen_shannon"] == 0.0 and got["same"]["ks_p_value"] == 1.0
        assert got["flat"]["psi"] == 0.0 and not got["flat"]["high_drift_any"]
        assert got["moved"]["psi"] > 1 and got["moved"]["ks_stat"] == 0.8 and got["moved"]["high_drift_any"]


def _ratio(a: str, b: str) -> int:
    """Token-set similarity by the book, for the brute-force comparison."""
    def indel(x, y):
        row = list(range(len(y) + 1))
        for i, cx in enumerate(x, 1):
            new = [i]
            for j, cy in enumerate(y, 1):
                new.append(row[j - 1] if cx == cy else 1 + min(row[j], new[-1]))
            row = new
        return row[-1]

    ta, tb = set(a.split()), set(b.split())
    both, da, db = sorted(ta & tb), " ".join(sorted(ta - tb)), " ".join(sorted(tb - ta))
    if both and (not da or not db):
        return 100
    s = len(" ".join(both))
    la, lb = s + bool(s) + len(da), s + bool(s) + len(db)
    best = 100 - 100 * indel(da, db) / (la + lb)
    if s:
        best = max(best, 100 - 100 * (bool(s) + len(da)) / (s + la), 100 - 100 * (bool(s) + len(db)) / (s + lb))
    return best


def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    words = ["windpower", "offshore", "onshore", "solar", "hydropower", "photovoltaic", "bioenergy"]
    values = set()
    while len(values) < 120:
        picked = " ".join(rng.choice(words, rng.integers(1, 4), replace=False))
        if rng.random() < 0.6:
            at = rng.integers(0, len(picked))
            picked = picked[:at] + "x" + picked[at + 1:]
        values.add(picked)
    values |= {"Germany", "Germanny", "Netherlands", "Nethrlands", "netherlands"}
    cells = spark.createDataFrame([("c", v) for v in sorted(values)], "column string, value string")
    got = {(r["value_a"], r["value_b"]): r["fuzz_score"] for r in near_duplicates(cells, ["column"]).collect()}
    want = {(a, b): int(_ratio(a, b)) for a, b in itertools.combinations(sorted(values), 2) if a.lower() != b.lower() and _ratio(a, b) >= 90}
    assert got == want and ("Germanny", "Germany") in got


def test_near_duplicates_of_many_long_and_few_values(spark):
    rng = np.random.default_rng(4)
    words = [f"{w}{i}" for w in ("windpower", "offshore", "photovoltaic") for i in range(12)] + ["plant", "site", "of", "the"]
    many = {f"site {i} of the plant" for i in range(90)}
    while len(many) < 330:
        picked = list(rng.choice(words, rng.integers(1, 9), replace=False))
        text = " ".join(picked)
        at = int(rng.integers(0, len(text)))
        many |= {text, text[:at] + "x" + text[at + 1:], " ".join(reversed(picked))}
    long = {" ".join(rng.choice(words, 14)) for _ in range(5)}
    long |= {v[:20] + "q" + v[21:] for v in long}
    pair = {"Netherlands", "Nethrlands"}
    cells = spark.createDataFrame([(k, v) for k, vs in (("many", many), ("long", long), ("pair", pair)) for v in sorted(vs)], "column string, value string")
    want = {(k, a, b): int(_ratio(a, b)) for k, vs in (("many", many), ("long", long), ("pair", pair))
            for a, b in itertools.combinations(sorted(vs), 2) if a.lower() != b.lower() and _ratio(a, b) >= 90}
    assert {k for k, _, _ in want} == {"many", "long", "pair"}
    for chunk in (2_000, 40):
        got = [(r["column"], r["value_a"], r["value_b"], r["fuzz_score"]) for r in near_duplicates(cells, ["column"], chunk=chunk).collect()]
        assert {g[:3]: g[3] for g in got} == want and len(got) == len(want)


def test_cumulative_increments_sum_to_the_last_level(spark):
    rows = [("01-01-2014", "1", "5"), ("01-12-2014", "3", "9"), ("01-06-2016", "8", "4"), ("01-12-2016", "6", None), ("01-12-2017", "10", "12")]
    df = spark.createDataFrame(rows, "unnamed_0 string, biomass string, solar_thermal string")
    got = {(r["technology"], r["year"]): (r["level"], r["new_level"]) for r in series.cumulative_to_annual(df, ["biomass", "solar_thermal", "absent"], "unnamed_0", "level").collect()}
    assert got[("biomass", 2014)] == (3.0, 3.0) and got[("biomass", 2016)] == (6.0, 3.0) and got[("biomass", 2017)] == (10.0, 4.0)
    assert got[("solar_thermal", 2014)] == (9.0, 9.0) and got[("solar_thermal", 2016)] == (4.0, 0.0)


def test_mean_shift_p_value(spark):
    rows = [("a", t, v) for t, v in enumerate([1.0, 2.0, 3.0, 4.0, 8.0, 9.0, 10.0, 13.0])] + [("b", 0, 1.0), ("b", 9, 2.0)]
    df = spark.createDataFrame(rows, "k string, t int, v double")
    row = series.mean_shift(df, ["k"], "t", "v", 4).collect()
    # Means 2.5 and 10, variances 5/3 and 14/3, four values each.
    e0, e1 = 5 / 12, 14 / 12
    assert len(row) == 1 and row[0]["t_statistic"] == pytest.approx(-7.5 / (e0 + e1) ** 0.5)
    assert row[0]["welch_df"] == pytest.approx((e0 + e1) ** 2 / (e0 ** 2 / 3 + e1 ** 2 / 3)) and 0.001 < row[0]["p_value_welch"] < 0.003
    # |t| = 2 with 4 degrees of freedom is a table value.
    p = spark.createDataFrame([(2.0, 4.0), (0.0, 4.0), (None, 4.0), (12.706, 1.0)], "t double, df double").select(series.t_p_value()("t", "df").alias("p"))
    assert [r["p"] for r in p.collect()] == [pytest.approx(0.116117, abs=1e-5), 1.0, None, pytest.approx(0.05, abs=1e-4)]


def test_change_points_find_both_steps(spark):
    rows = [("k", t, 1.0 + (t >= 20) * 10 + (t >= 35) * 5 + 0.01 * (t % 3)) for t in range(50)] + [("short", t, float(t)) for t in range(4)]
    got = series.change_points(spark.createDataFrame(rows, "s string, t int, v double"), ["s"], "t", "v", penalty=1.0).orderBy("position").collect()
    assert [(r["s"], r["segment_start"], r["position"]) for r in got] == [("k", 20.0, 20), ("k", 35.0, 35)]


def test_change_points_with_tied_times(spark):
    rows = [("k", t // 3, 1.0 + (t >= 30) * 10) for t in range(60)] + [("one", 5, float(t)) for t in range(12)]
    got = series.change_points(spark.createDataFrame(rows, "s string, t int, v double"), ["s"], "t", "v", penalty=1.0).collect()
    assert [(r["s"], r["segment_start"], r["position"]) for r in got] == [("k", 10.0, 30)]


def test_bootstrap_interval_holds_the_estimate(spark):
    df = spark.createDataFrame([("g", 2000 + i, 100.0 * 1.1 ** i * (1.02 if i % 2 else 0.99)) for i in range(12)], "k string, year int, v double")
    row = series.bootstrap_growth(df, ["k"], "year", "v").first()
    assert row["cagr_low"] < row["cagr"] < row["cagr_high"] and row["cagr"] == pytest.approx(0.1, abs=0.02)


def test_learning_fit_guards(spark):
    rows = [("exact", 2.0 ** i, 8.0 / 2 ** i) for i in range(5)] + [("few", 1.0, 1.0), ("few", 2.0, 1.0)] + [("flat", float(i), 3.0) for i in range(1, 5)] + [("exact", -1.0, 5.0)]
    got = {r["b"]: r for r in fit.learning_fit(spark.createDataFrame(rows, "b string, x double, y double"), ["b"], "x", "y").collect()}
    assert got["exact"]["slope"] == pytest.approx(-1) and got["exact"]["lr_per_doubling"] == pytest.approx(0.5) and got["exact"]["n_obs"] == 5
    assert got["few"]["slope"] is None and got["flat"]["r_squared"] is None and got["flat"]["slope"] == pytest.approx(0)


def test_generation_shares_by_year(spark):
    rows = [("Q1 1998", "10", "5", "5"), ("Q2 1998", "20", None, "10"), ("Q1 1999", "1", "1", "0"), ("total", "9", "9", "9")]
    df = spark.createDataFrame(rows, "unnamed_0 string, coal string, wind_and_solar string, bioenergy string")
    got = {r["year"]: r for r in facts.generation_annual(df).collect()}
    assert set(got) == {1998, 1999} and got[1998]["renewable_share_pct"] == 40.0 and got[1998]["fossil_twh"] == 30.0


def test_null_keys_match_in_joins_but_not_in_groups(spark):
    a = spark.createDataFrame([(None, "x", 1.0), (2001, "x", 2.0)], "year int, t string, v double")
    b = spark.createDataFrame([(None, "x", 9.0)], "year int, t string, w double")
    got = {r["year"]: r["w"] for r in relational.join_null_safe(a, b, ["year", "t"]).collect()}
    assert got == {None: 9.0, 2001: None}
    assert relational.grouped_sums(a, ["year"], ["v"]).count() == 1


def test_concentration_is_a_share_of_one(spark):
    df = spark.createDataFrame([(2000, "a", 1.0), (2000, "b", 1.0), (2001, "a", 5.0), (2002, "a", 0.0)], f"year int, technology string, {facts.CAPACITY} double")
    got = {r["year"]: r["hhi"] for r in benchmarks.concentration(df).collect()}
    assert got == {2000: 0.5, 2001: 1.0}


def test_histogram_counts_every_value(spark):
    df = spark.createDataFrame([(float(x),) for x in range(101)] + [(None,)], "v double")
    bins = profile.histogram(profile.numeric_cells(df, ["v"]), ["column"]).collect()
    assert sum(r["n"] for r in bins) == 101 and max(r["bin_high"] for r in bins) == pytest.approx(100.0)


def test_spearman_skips_rows_with_a_null(spark):
    rows = [(1.0, 10.0, 5.0), (2.0, None, 4.0), (3.0, 30.0, 3.0), (4.0, 20.0, 2.0), (5.0, 50.0, 1.0), (2.0, 10.0, 9.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = {(r["col_a"], r["col_b"]): r["spearman"] for r in profile.spearman_pairs(df, ["a", "b", "c"]).collect()}
    pdf = df.toPandas()
    for a, b in got:
        pair = pdf[[a, b]].dropna().rank()
        assert got[(a, b)] == pytest.approx(round(pair[a].corr(pair[b]), 4), abs=1e-4)


def test_temporal_gap_is_found(spark):
    df = spark.createDataFrame([("s", f"2020-01-{d:02d}") for d in (1, 2, 3, 4, 9, 10)] + [("s", "0001-01-01")], "k string, d string")
    summary, gaps = profile.temporal_coverage(df.select("k", F.col("d").cast("date").alias("date")), ["k"])
    row, gap = summary.first(), gaps.first()
    assert (row["n_unique_dates"], row["median_step_days"], row["n_gaps_gt_1_5x_step"], row["span_days"]) == (6, 1, 1, 9)
    assert gap["gap_days"] == 5


def test_composite_keys_and_duplicates(spark):
    df = spark.createDataFrame([("a", 2000, 1.0, "x"), ("a", 2000, 1.0, "x"), ("b", 2001, 2.0, "x"), ("b", 2001, 3.0, "x")], "area string, year int, v double, same string")
    assert profile.composite_keys(df) == ["area", "year"]
    row = profile.duplicate_summary(df, ["area", "year"]).first()
    assert (row["n_rows"], row["n_exact_duplicates"], row["n_key_collisions"]) == (4, 2, 4)


@pytest.mark.parametrize("seed", range(4))
def test_minimal_keys_against_all_sets(spark, seed):
    draw = random.Random(seed)
    rows = [(i // 7, i % 7 or None, draw.choice([None, *range(40)]), draw.choice([None, *range(60)]), draw.random() if seed % 2 else None) for i in range(700)]
    names = list("abcde")
    is_key = {s: len({tuple(r[names.index(c)] for c in s) for r in rows}) == len(rows) for k in (1, 2, 3) for s in itertools.combinations(names, k)}
    want = {",".join(s) for s, yes in is_key.items() if yes and not any(is_key[t] and set(t) < set(s) for t in is_key)}
    found = profile.minimal_keys(spark.createDataFrame(rows, "a int, b int, c int, d int, e double"))
    assert {r["key_columns"] for r in found.collect()} == want and "a,b" in want


def test_minimal_keys_sends_blocks_and_looks_equal_digests_up(spark, monkeypatch):
    draw = random.Random(7)
    rows = [(draw.choice([None, *range(25)]), draw.choice([0.0, -0.0, float("nan"), *map(float, range(20))]), draw.choice(["x", "y", None, ""]), i // 3) for i in range(300)]
    names = list("abcd")
    plain = [tuple("nan" if v != v else v for v in r) for r in rows]
    is_key = {s: len({tuple(r[names.index(c)] for c in s) for r in plain}) == len(rows) for k in (1, 2, 3) for s in itertools.combinations(names, k)}
    want = {",".join(s) for s, yes in is_key.items() if yes and not any(is_key[t] and set(t) < set(s) for t in is_key)}
    df = spark.createDataFrame(rows, "a int, b double, c string, d int").repartition(3)
    hashed = df.select(*[F.xxhash64(F.col(c), F.col(c).isNull()) for c in names])
    assert profile.digest_blocks(hashed, [(0, 1), (1, 2, 3)], 5).count() <= 3 * 2 * 5  # of 600 digests
    for held, size in ((1 << 22, 1 << 21), (40, 16)):
        monkeypatch.setattr(profile, "DIGESTS_HELD", held)
        monkeypatch.setattr(profile, "DIGESTS_OF_A_BLOCK", size)
        assert {r["key_columns"] for r in profile.minimal_keys(df).collect()} == want
    monkeypatch.setattr(profile, "TURN", 0)  # rows that differ meet: (0, 1) and (1, 0)
    pairs = [(a, b, 0) for a in range(3) for b in range(4)]
    for more, found in (([], {"a,b"}), ([(2, 3, 0)], set())):
        assert {r["key_columns"] for r in profile.minimal_keys(spark.createDataFrame(pairs + more, "a int, b int, c int")).collect()} == found
