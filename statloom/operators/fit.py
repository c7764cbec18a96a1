"""Log-log experience curves: one regression per group, all groups at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from statloom.operators.ordered import attach

MIN_POINTS = 3


def learning_fit(df: DataFrame, keys: list[str], capacity: str, cost: str) -> DataFrame:
    """(keys, slope, intercept, lr_per_doubling, r_squared, n_obs).

    Only positive pairs count; fewer than three leave the fit NULL. A constant
    cost has no r squared.
    """
    usable = (F.col(capacity) > 0) & (F.col(cost) > 0)
    x, y = F.log(F.when(usable, F.col(capacity))), F.log(F.when(usable, F.col(cost)))
    raw = df.groupBy(*keys).agg(
        F.count(F.when(usable, F.lit(1))).alias("n_obs"), F.regr_slope(y, x).alias("_b"),
        F.regr_intercept(y, x).alias("_a"), F.regr_r2(y, x).alias("_r2"), F.regr_syy(y, x).alias("_syy"),
    )
    enough = F.col("n_obs") >= MIN_POINTS
    return raw.select(
        *keys, F.when(enough, F.col("_b")).alias("slope"), F.when(enough, F.col("_a")).alias("intercept"),
        F.when(enough, 1.0 - F.pow(F.lit(2.0), F.col("_b"))).alias("lr_per_doubling"),
        F.when(enough & (F.col("_syy") > 0), F.col("_r2")).alias("r_squared"), "n_obs",
    )


def fitted_curve(df: DataFrame, keys: list[str], capacity: str, cost: str, points: int = 100) -> DataFrame:
    """(keys, cum_capacity, cost_fit) at evenly spaced capacities between the observed ends."""
    fit = learning_fit(df, keys, capacity, cost).where(F.col("slope").isNotNull())
    ends = df.where(F.col(capacity) > 0).groupBy(*keys).agg(F.min(capacity).alias("_lo"), F.max(capacity).alias("_hi"))
    grid = attach(fit, ends, keys).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    x = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_i") / (points - 1)
    return grid.select(*keys, x.alias("cum_capacity"), F.exp(F.col("slope") * F.log(x) + F.col("intercept")).alias("cost_fit"))
