"""Statistics that differ from Spark's built-in definition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sample_skewness(value: Column) -> Column:
    """Bias-corrected skewness; null below three values."""
    n = F.count(value).cast("double")
    return F.when(n > 2, F.skewness(value) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(value: Column) -> Column:
    """Bias-corrected excess kurtosis; null below four values."""
    n = F.count(value).cast("double")
    corrected = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(value) + 6)
    return F.when(n > 3, corrected)


def finite_or_null(value: Column) -> Column:
    return F.when(F.isnan(value) | (F.abs(value) == F.lit(float("inf"))), None).otherwise(value)


def safe_ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def known(value: str | Column) -> Column:
    """The value, null where it is NaN: aggregates skip it then."""
    v = F.col(value) if isinstance(value, str) else value
    return F.when(~F.isnan(v.cast("double")), v)
