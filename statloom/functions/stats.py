"""Closed-form statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def corrected_skew(n: Column, g1: Column, std: Column) -> Column:
    """Bias-corrected skewness from the population value; NULL when it means nothing."""
    adj = F.sqrt(n * (n - 1.0)) / (n - 2.0) * g1
    return F.when((n > 3) & (std >= 1e-12), adj)


def corrected_kurtosis(n: Column, g2: Column, std: Column) -> Column:
    """Bias-corrected excess kurtosis from the population value."""
    adj = (n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1.0) * g2 + 6.0)
    return F.when((n > 3) & (std >= 1e-12), adj)


def bimodality(n: Column, skew: Column, kurt: Column) -> Column:
    """(g^2 + 1) / (k + 3(n-1)^2 / ((n-2)(n-3))); above 0.555 hints at two modes."""
    denom = F.when(n > 3, kurt + 3.0 * F.pow(n - 1.0, F.lit(2)) / ((n - 2.0) * (n - 3.0)))
    return F.when(denom > 0, (skew * skew + 1.0) / denom)


def cagr(start: Column, end: Column, years: Column) -> Column:
    """Compound annual growth; NULL unless both ends and the span are positive."""
    return F.when((start > 0) & (end > 0) & (years > 0), F.pow(end / start, 1.0 / years) - 1.0)


def variation(std: Column, mean: Column, n: Column) -> Column:
    """Coefficient of variation; NULL for fewer than two values or a zero mean."""
    return F.when((n >= 2) & (mean != 0), std / F.abs(mean))


def entropy_bits(share: Column) -> Column:
    """Shannon entropy of a set of shares (an aggregate)."""
    return -F.sum(F.when(share > 0, share * F.log2(share)).otherwise(0.0))


def kolmogorov_p(d: Column, n: Column, m: Column, terms: int = 100) -> Column:
    """Asymptotic two-sample p-value: 2 * sum (-1)^(j-1) exp(-2 j^2 lambda^2)."""
    lam2 = d * d * (n * m / (n + m))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.lit(0.0),
        lambda acc, j: acc + F.when(j % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * j * j * lam2),
    )
    return F.when(lam2 < 1e-3, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2.0 * series)))
