"""Prediction errors of windows and summaries of scores."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.statistics import known
from pulsegrid.operators.ordered import OrderKey, attach, row_frames
from pulsegrid.operators.vectors import with_matrix
from pulsegrid.storage import durable


def detrend(
    df: DataFrame, keys: Sequence[str], order: Sequence[OrderKey], value: str, depth: int, out: str = "detrended",
    group_rows: int | None = None,
) -> DataFrame:
    """Value minus the mean of the ``depth`` rows before it; rows without that many are dropped.

    A key with no more than ``depth`` rows keeps its raw values.
    """

    def frame(rows, w):
        back = w.rowsBetween(-depth, -1)
        return rows.withColumns({"_back": F.count(F.lit(1)).over(back), "_mean": F.avg(value).over(back)})

    framed = row_frames(df, keys, order, depth, 0, frame, group_rows)
    sizes = df.groupBy(*keys).agg((F.count(F.lit(1)) <= depth).alias("_short"))
    if keys:
        framed = attach(framed, durable(sizes, "sizes"), keys, ["_short"])
    else:
        framed = framed.withColumn("_short", sizes.scalar())
    full = F.col("_back") == depth
    return (
        framed.where(full | F.col("_short"))
        .withColumn(out, F.when(F.col("_short"), F.col(value)).otherwise(F.col(value) - F.col("_mean")))
        .drop("_back", "_mean", "_short")
    )


def rolling_mean_prediction(
    df: DataFrame, keys: Sequence[str], order: Sequence[OrderKey], values: Sequence[str], window: int,
    group_rows: int | None = None,
) -> DataFrame:
    """Predicts row W of a window from rows 1..W-1 by their mean: ``<value>_pred``, full windows only."""
    back_rows = window - 1

    def frame(rows, w):
        back = w.rowsBetween(-back_rows, -1)
        predictions = {f"{v}_pred": F.avg(v).over(back) for v in values}
        return rows.withColumn("_back", F.count(F.lit(1)).over(back)).withColumns(predictions)

    framed = row_frames(df, keys, order, back_rows, 0, frame, group_rows)
    return framed.where(F.col("_back") == back_rows).drop("_back")


def lag_features(
    df: DataFrame, keys: Sequence[str], order: Sequence[OrderKey], value: str, window: int, group_rows: int | None = None
) -> DataFrame:
    """``lag_1`` .. ``lag_{W-1}`` of every row that has them all."""
    names = [f"lag_{i}" for i in range(1, window)]

    def frame(rows, w):
        return rows.withColumns({n: F.lag(value, i + 1).over(w) for i, n in enumerate(names)})

    return row_frames(df, keys, order, window - 1, 0, frame, group_rows).na.drop(subset=names)


def fit_lag_regression(features: DataFrame, keys: Sequence[str], value: str, window: int) -> DataFrame:
    """keys, n and ``coefficients`` (intercept first) of a linear model per series of a row from its W-1 predecessors.

    One aggregation gives the sums of products of every series; the small systems are solved in Arrow batches. A series whose lags
    depend on each other gets the solution of least length.
    """
    names = [f"lag_{i}" for i in range(1, window)]
    terms, d = [F.lit(1.0), *[F.col(n).cast("double") for n in names]], window
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    y = F.col(value).cast("double")
    usable = features.where(F.col(value).isNotNull())
    sums = usable.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(terms[i] * terms[j]) for i, j in pairs]).alias("_gram"), F.array(*[F.sum(t * y) for t in terms]).alias("_moment")
    )
    rows, columns = np.array(pairs).T

    def solve(cells: np.ndarray) -> tuple[np.ndarray]:
        gram = np.zeros((len(cells), d, d))
        gram[:, rows, columns] = gram[:, columns, rows] = cells[:, : len(pairs)]
        # Scaled to a unit diagonal, so that what counts as dependent does not turn on the units.
        size = np.sqrt(np.maximum(np.einsum("nii->ni", gram), 1e-300))
        inverse = np.linalg.pinv(gram / size[:, :, None] / size[:, None, :], rcond=1e-12, hermitian=True)
        return (np.einsum("nij,nj->ni", inverse, cells[:, len(pairs) :] / size) / size,)

    fitted = with_matrix(sums.withColumn("_cells", F.concat("_gram", "_moment")), "_cells", "coefficients array<double>", solve)
    return fitted.select(*keys, "n", "coefficients")


def predict_lag_regression(fitted: DataFrame, features: DataFrame, keys: Sequence[str], value: str, window: int) -> DataFrame:
    """``<value>_pred`` by the model of the row's series, null where it has none."""
    joined = attach(features, fitted, keys, ["coefficients"])
    total = F.col("coefficients")[0]
    for i in range(1, window):
        total = total + F.col("coefficients")[i] * F.col(f"lag_{i}")
    return joined.withColumn(f"{value}_pred", total).drop("coefficients")


def prediction_error(pairs: Sequence[tuple[str, str]]) -> Column:
    """Mean absolute error over all (actual, predicted) columns of a row."""
    errors = [F.abs(F.col(a) - F.col(p)) for a, p in pairs]
    total = errors[0]
    for e in errors[1:]:
        total = total + e
    return total / len(errors)


def window_error(features: DataFrame, keys: Sequence[str], actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """The same for rows in long form, one per (window, feature)."""
    return features.groupBy(*keys).agg(F.avg(F.abs(F.col(actual) - F.col(predicted))).alias("score"))


def group_loss(errors: DataFrame, group: str = "group", actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Mean squared error per group."""
    return errors.groupBy(group).agg(F.avg(F.pow(F.col(actual) - F.col(predicted), 2.0)).alias("mse"))


def total_loss(errors: DataFrame, group: str = "group", actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    return group_loss(errors, group, actual, predicted).agg(F.sum("mse").alias("loss"))


def score_summary(scores: DataFrame, score: str = "score") -> DataFrame:
    """Mean, population deviation, minimum and maximum; an error without scores."""
    s = known(score)
    return scores.agg(
        F.count(s).alias("n"),
        F.avg(s).alias("mean_score"),
        F.stddev_pop(s).alias("std_score"),
        F.min(s).alias("min_score"),
        F.max(s).alias("max_score"),
    ).withColumn(
        "mean_score",
        F.when(F.col("n") == 0, F.raise_error(F.lit("no scores to summarise")).cast("double")).otherwise(F.col("mean_score")),
    )


def error_summary(errors: DataFrame, error: str = "error") -> DataFrame:
    """Mean, population deviation, threshold mean + 2 deviations, and the rows above it."""
    e = known(error)
    threshold = errors.select(F.avg(e) + 2 * F.stddev_pop(e)).scalar()
    return errors.agg(
        F.count(e).alias("n"),
        F.avg(e).alias("mean_error"),
        F.stddev_pop(e).alias("std_error"),
        F.max(threshold).alias("threshold"),
        F.count_if(e > threshold).alias("anomalies"),
    )
