"""Top-N and filtered views of the profiles, as the report shows them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from statloom.operators.relational import top_k


def most_skewed(descriptives: DataFrame, n: int = 25) -> DataFrame:
    cols = [c for c in ("column", "n", "median", "p99", "max", "skew", "kurtosis") if c in descriptives.columns]
    return top_k(descriptives.select(*cols), "skew", n, ["column"])


def constant_columns(descriptives: DataFrame) -> DataFrame:
    return descriptives.where("constant").orderBy("column")


def most_informative(categorical: DataFrame, n: int = 25) -> DataFrame:
    cols = ["column", "n_unique", "top_share", "shannon_entropy_bits", "max_entropy_bits"]
    return top_k(categorical.select(*cols), "shannon_entropy_bits", n, ["column"])


def high_cardinality(categorical: DataFrame, n: int = 20) -> DataFrame:
    return top_k(categorical, "n_unique", n, ["column"])


def concentrated(categorical: DataFrame, at_least: float = 0.9, n: int = 20) -> DataFrame:
    return top_k(categorical.where(F.col("gini_concentration") >= at_least), "gini_concentration", n, ["column"])


def mixed_columns(schema: DataFrame, n: int = 20) -> DataFrame:
    return top_k(schema.where("mixed_type_residue"), "object_with_numeric_share", n, ["column"])


def most_outliers(register: DataFrame, n: int = 15) -> DataFrame:
    return top_k(register, "share_log_mad", n, ["column"])


def category_counts(scorecard: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return scorecard.groupBy(*(keys or []), "category").agg(F.count(F.lit(1)).alias("n"))


def features_of(scorecard: DataFrame, category: str) -> DataFrame:
    return scorecard.where(F.col("category") == category).orderBy("column")


def high_drift(report: DataFrame, n: int = 30) -> DataFrame:
    return top_k(report.where("high_drift_any"), "psi", n, ["metric", "scope"])
