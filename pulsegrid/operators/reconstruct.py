"""Detection by reconstruction error: project on few components, rebuild, measure the difference."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.ordered import order_statistic
from pulsegrid.operators.vectors import with_matrix

ERROR_QUANTILE = 0.99
COMPONENTS = 4


def cosine_components(width: int, k: int = COMPONENTS) -> np.ndarray:
    """``k`` orthonormal waves over the positions of an array, as components that need no fit."""
    at, j = np.arange(width)[:, None] + 0.5, np.arange(1, k + 1)[None, :]
    return np.sqrt(2 / width) * np.cos(np.pi * at * j / width)


def pivot_first(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], ts: str = "_time", value: str = "counter", order: Sequence[str] = ()
) -> DataFrame:
    """First value of each (keys) combination per instant as a column; 0 where there is none."""
    name = F.concat_ws("_", *[F.col(k) for k in keys])
    first = F.min_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))) if order else F.first(value, True)
    return df.withColumn("_name", name).groupBy(ts).pivot("_name", list(columns)).agg(first).na.fill(0)


def fit_standard(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the mean and population deviation of every column."""
    return df.agg(
        *[F.avg(c).alias(f"{c}__mean") for c in columns], *[F.stddev_pop(c).alias(f"{c}__std") for c in columns]
    )


def apply_standard(df: DataFrame, fitted: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Standard scores with fitted statistics; a constant column is only centred."""
    stats = fitted.select(F.struct(*fitted.columns)).scalar()
    with_stats = df.withColumn("_fit", stats)

    def scaled(c: str) -> Column:
        std = F.col(f"_fit.{c}__std")
        return (F.col(c) - F.col(f"_fit.{c}__mean")) / F.when(std > 0, std).otherwise(1.0)

    return with_stats.withColumns({c: scaled(c) for c in columns}).drop("_fit")


def standardise_array(df: DataFrame, train: DataFrame, array: str, out: str = "scaled") -> DataFrame:
    """The same for an array column of fixed length."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    moments = Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(F.col(array)))
    summary = train.select(moments.alias("m"))
    shrink = (F.col("m.count") - 1) / F.col("m.count")
    std = F.transform(vector_to_array("m.variance"), lambda v: F.sqrt(v * shrink))
    fit = summary.select(F.struct(vector_to_array("m.mean").alias("mean"), std.alias("std"))).scalar()
    centred = F.zip_with(F.col(array), F.col("_fit.mean"), lambda x, m: x.cast("double") - m)
    scaled = F.zip_with(centred, F.col("_fit.std"), lambda x, s: x / F.when(s > 0, s).otherwise(1.0))
    return df.withColumn("_fit", fit).withColumn(out, scaled).drop("_fit")


def fit_components(train: DataFrame, array: str = "scaled", k: int = COMPONENTS):
    """Principal components of an array column."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    rows = train.select(array_to_vector(F.col(array)).alias("v"))
    return PCA(k=k, inputCol="v", outputCol="p").fit(rows)


def reconstruction_errors(df: DataFrame, components, array: str = "scaled") -> DataFrame:
    """Adds ``mae`` and ``mse`` of every row against its rebuilt form.

    ``components`` is a fitted model or a matrix with an orthonormal column per component. With those, the squared residual is that
    of the row less that of its projection; the absolute one takes a product per Arrow batch. For centred data, the mean lies outside
    the projection.
    """
    matrix = np.asarray(components.pc.toArray() if hasattr(components, "pc") else components, dtype=float)
    if not np.allclose(matrix.T @ matrix, np.eye(matrix.shape[1]), atol=1e-6):
        raise ValueError("components must be orthonormal")

    def errors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        projected = x @ matrix
        residual = np.maximum((x * x).sum(axis=1) - (projected * projected).sum(axis=1), 0.0)
        return np.abs(x - projected @ matrix.T).mean(axis=1), residual / x.shape[1]

    return with_matrix(df, array, "mae double, mse double", errors)


def quantile_threshold(train_errors: DataFrame, error: str = "mae", q: float = ERROR_QUANTILE, group_rows: int | None = None) -> DataFrame:
    """(n, threshold): linearly interpolated quantile of the training errors."""
    return order_statistic(train_errors, [], error, q, "threshold", interpolate=True, group_rows=group_rows)


def flag_above(errors: DataFrame, threshold: DataFrame, error: str = "mae", out: str = "alarm") -> DataFrame:
    limit = threshold.select("threshold").scalar()
    return errors.withColumn(out, (F.col(error) > limit).cast("int"))
