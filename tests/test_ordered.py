from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.operators import ordered as o, relational as r
from statloom.operators.series import latest_volatility, rolling_volatility


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows and one value a third of them."""
    rng = np.random.default_rng(1)
    rows = [("hot", float(v)) for v in rng.integers(0, 400, 1500)] + [("hot", 7.0)] * 900
    rows += [("cold", float(v)) for v in rng.normal(size=61)] + [("one", 3.5), ("cold", None)]
    return spark.createDataFrame(rows, "k string, v double")


@pytest.mark.parametrize("small", [True, False])
def test_quantiles_are_exact_on_both_paths(skewed, small):
    probs = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.93, "e": 1.0}
    got = {r["k"]: r for r in o.quantiles(skewed, ["k"], "v", probs, small=small).collect()}
    data = skewed.toPandas().dropna()
    for k, part in data.groupby("k"):
        want = np.quantile(part["v"], list(probs.values()))
        assert [got[k][n] for n in probs] == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("small", [True, False])
def test_weighted_quantiles_equal_those_of_the_rows(skewed, small):
    counts = o.value_counts(skewed, ["k"], "v")
    a = {r["k"]: r["m"] for r in o.quantiles(counts, ["k"], "v", {"m": 0.3}, weight="n", small=small).collect()}
    b = {r["k"]: r["m"] for r in o.quantiles(skewed, ["k"], "v", {"m": 0.3}, small=True).collect()}
    assert a == pytest.approx(b)


@pytest.mark.parametrize("small", [True, False])
def test_median_and_mad(skewed, small):
    got = {r["k"]: (r["median"], r["mad"]) for r in o.median_and_mad(skewed, ["k"], "v", small=small).collect()}
    for k, part in skewed.toPandas().dropna().groupby("k"):
        med = np.median(part["v"])
        assert got[k] == pytest.approx((med, np.median(np.abs(part["v"] - med))))


def test_running_totals_agree_and_end_at_the_total(skewed):
    counts = o.value_counts(skewed, ["k"], "v")
    a, b = (
        {(r["k"], r["v"]): (r["c"], r["c_all"]) for r in o.running_totals(counts, ["k"], ["v"], {"c": "n"}, small=s).collect()}
        for s in (True, False)
    )
    assert a == b
    assert max(c for (k, _), (c, _) in a.items() if k == "hot") == 2400


def test_size_threshold_comes_from_the_session(spark):
    df = spark.range(10)
    assert o.is_small(df)
    spark.conf.set(o.SMALL_INPUT_CONF, "1")
    try:
        assert not o.is_small(df)
    finally:
        spark.conf.unset(o.SMALL_INPUT_CONF)


def test_average_ranks(spark):
    df = spark.createDataFrame([("a", x) for x in (3, 1, 3, 2)], "k string, v int")
    got = {r["v"]: r["r"] for r in o.average_ranks(o.value_counts(df, ["k"], "v"), ["k"], "v", "n", "r").collect()}
    assert got == {1: 1.0, 2: 2.0, 3: 3.5}


@pytest.mark.parametrize("chunk", [3, 1000])
def test_fill_forward_crosses_chunks_without_values(spark, chunk):
    rows = [("a", i, {1: "x", 11: "y"}.get(i)) for i in range(15)] + [("b", i, None) for i in range(4)]
    df = spark.createDataFrame(rows, "k string, i int, v string")
    got = {(r["k"], r["i"]): r["v"] for r in o.fill_forward(df, ["k"], "i", "v", chunk).collect()}
    assert [got[("a", i)] for i in range(15)] == [None] + ["x"] * 10 + ["y"] * 4
    assert all(got[("b", i)] is None for i in range(4))


def test_null_keys_stay_together(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "k string, v double")
    got = {r["k"]: r["m"] for r in o.quantiles(df, ["k"], "v", {"m": 0.5}, small=False).collect()}
    assert got == {None: 2.0, "a": 5.0}
    joined = o.attach(df, df.groupBy("k").agg(F.count(F.lit(1)).alias("n")), ["k"])
    assert {(r["k"], r["n"]) for r in joined.collect()} == {(None, 2), ("a", 1)}


def plain_windows(rows, k, width, least):
    out, series = {}, {}
    for key, at, i, v in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        series.setdefault(key, []).append((i, v))
    for key, points in series.items():
        for j, (i, v) in enumerate(points):
            got = [x for _, x in points[max(0, j - width + 1):j + 1] if x is not None]
            past = points[j - k][1] if j >= k else None
            out[key, i] = (None if v is None or past is None else v - past, sum(got) / len(got) if len(got) >= least else None)
    return out


def sliding_rows():
    rng = random.Random(11)
    keys = ["hot"] * 700 + ["b"] * 60 + [None] * 45 + ["c"]
    return [(k, rng.randrange(10_000), i, None if rng.random() < 0.1 else float(rng.randrange(100))) for i, k in enumerate(keys)]


@pytest.mark.parametrize("long_rows", [1, 3, 20, 64, 10**6])
def test_sliding_frames_equal_the_window_form(spark, long_rows):
    rows = sliding_rows()
    df = spark.createDataFrame(rows, "k string, at int, i int, v double").withColumn("o", F.struct("at", "i"))
    frames = lambda w: {"d": r.difference_over(w, "v", 2), "m": r.mean_over(w, "v", 6, 3)}
    got = {(x["k"], x["i"]): (x["d"], x["m"]) for x in o.sliding(df, ["k"], "o", 5, frames, long_rows).collect()}
    want = plain_windows(rows, 2, 6, 3)
    assert got.keys() == want.keys()
    assert all(got[key] == pytest.approx(want[key]) for key in want)


@pytest.mark.parametrize("long_rows", [2, 30])
def test_sliding_frames_of_one_series_without_key(spark, long_rows):
    rows = [(None, at, i, v) for _, at, i, v in sliding_rows()]
    df = spark.createDataFrame(rows, "k string, at int, i int, v double").withColumn("o", F.struct("at", "i")).drop("k")
    got = {(None, x["i"]): (x["d"], x["m"]) for x in o.sliding(df, [], "o", 5, lambda w: {"d": r.difference_over(w, "v", 2), "m": r.mean_over(w, "v", 6, 3)}, long_rows).collect()}
    want = plain_windows(rows, 2, 6, 3)
    assert got.keys() == want.keys() and all(got[key] == pytest.approx(want[key]) for key in want)


def test_no_window_sees_a_whole_long_series(spark):
    df = spark.range(5000).select(F.lit("one").alias("k"), "id", (F.col("id") % 7).cast("double").alias("v"))
    out = r.with_rolling_mean(df, ["k"], "id", "v", "m", 5, long_rows=100)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and sum("_chunk" in line for line in windows) == 1
    # what is left over is the window of the short series, which the long one never reaches
    short = [line for line in windows if "_chunk" not in line and "_slice" not in line]
    assert len(short) == 1
    assert out.where("m IS NULL").count() == 0 and out.count() == 5000
    halo = o.with_halo(o.row_numbers(df, ["k"], "id", "_row"), "_row", 100, before=4)
    assert halo.groupBy("k", "_chunk").count().agg(F.max("count")).first()[0] == 104


def test_last_values_without_keys_need_no_window(spark):
    df = spark.createDataFrame([(i, float(i * i % 17)) for i in range(50)], "i int, v double")
    found = r.nth_from_last(df, [], "i", "v", [1, 3, 60])
    assert tuple(found.first()) == (49 * 49 % 17, 47 * 47 % 17, None)
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    assert tuple(r.nth_from_last(df.where("i < 0"), [], "i", "v", [1]).first()) == (None,)
    assert latest_volatility(df, "i", "v", 4).first()["cv"] == pytest.approx(rolling_volatility(df, [], "i", "v", 4).orderBy(F.desc("i")).first()["rolling_cv"])


@pytest.mark.parametrize("bins", [1, 2, 7, 1024])
def test_narrowed_quantiles_are_exact(spark, bins):
    rng = np.random.default_rng(5)
    kinds = {
        "even": rng.uniform(-5, 5, 400), "heavy": np.exp(rng.normal(0, 8, 300)) * rng.choice([-1, 1], 300), "ties": rng.integers(0, 4, 500).astype(float),
        "one": np.array([3.25]), "same": np.full(40, -7.5), "huge": np.concatenate([rng.uniform(0, 1e-300, 50), [1e308, -1e308]]),
        "infinite": np.concatenate([rng.uniform(0, 1, 30), [np.inf, -np.inf]]),
    }
    rows = [(k, float(v), int(n)) for k, vs in kinds.items() for v, n in zip(vs, rng.integers(1, 4, len(vs)))]
    probs = {"a": 0.0, "b": 0.013, "c": 0.25, "d": 0.5, "e": 0.9, "f": 1.0}
    df = spark.createDataFrame([*rows, (None, 2.0, 5), (None, 4.0, 5)], "k string, v double, n int")
    got = {x["k"]: x for x in o.narrowed_quantiles(df, ["k"], "v", "n", probs, bins).collect()}
    for k in kinds:
        values = np.sort(np.repeat([v for kk, v, _ in rows if kk == k], [n for kk, _, n in rows if kk == k]))
        for name, p in probs.items():
            low, high = int(np.floor(p * (len(values) - 1))), int(np.ceil(p * (len(values) - 1)))
            part = p * (len(values) - 1) - low
            want = values[low] if part == 0 else values[low] * (1 - part) + values[high] * part
            assert got[k][name] == pytest.approx(want, rel=1e-9, nan_ok=True) or (part == 0 and np.isinf(want)), (k, name)
    assert got[None]["d"] == 3.0
