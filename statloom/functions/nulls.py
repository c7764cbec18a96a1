"""Null-safe arithmetic. NULL is the only missing value; NaN never leaves a reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T


def lit_double(x: float) -> Column:
    return F.lit(float(x))


def finite(c: Column) -> Column:
    """The value if it is a finite number, else NULL."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), d)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every floating column (one projection)."""
    floating = (T.DoubleType, T.FloatType)
    return df.select(
        *[
            F.when(~F.isnan(F.col(f.name)), F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, floating)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def safe_div(num: Column, den: Column) -> Column:
    """num / den where den > 0, else NULL. Never raises under ANSI mode."""
    return F.when(den > 0, num / den)


def div_nonzero(num: Column, den: Column) -> Column:
    """num / den where den is not zero, else NULL (negative denominators count)."""
    return F.when(den != 0, num / den)


def clip_low(c: Column, low: float = 0.0) -> Column:
    """max(c, low) that keeps NULL (greatest() alone would drop it)."""
    return F.when(c < F.lit(float(low)), F.lit(float(low))).otherwise(c)


def sum0(c: Column) -> Column:
    """Sum that is 0 for an all-null group."""
    return F.coalesce(F.sum(c), F.lit(0.0))


def row_sum(cols: list[Column]) -> Column:
    """Sum across columns of one row, nulls skipped."""
    total = F.lit(0.0)
    for c in cols:
        total = total + F.coalesce(c.cast("double"), F.lit(0.0))
    return total


def share_of(pred: Column) -> Column:
    """Share of rows for which ``pred`` holds (NULL counts as false)."""
    return F.avg(F.when(pred, F.lit(1.0)).otherwise(F.lit(0.0)))
