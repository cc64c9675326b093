"""A margin around normal rows: the one-class hinge objective on random Fourier features.

Per fold, ``w`` and ``rho`` minimise |w|^2 / 2 - rho + sum max(0, rho - w z) / (nu n) over the normal rows outside the fold. The driver holds the
models, one short vector per fold; rows add to the subgradients of all folds but their own in one pass, so no row is repeated or written
per fold. In the end ``rho`` is set to the exact place that leaves the share ``nu`` outside, by two histograms.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.statistics import safe_ratio
from pulsegrid.operators.evaluate import f1
from pulsegrid.operators.splits import plain_folds
from pulsegrid.operators.vectors import SEED, Fourier, matrix_sums
from pulsegrid.storage import dealt, durable

# Fixed value: share of normal rows left outside.
NU = 0.05
FEATURES, STEPS, BINS = 128, 25, 2_000
_ODD = -1


def margin_scores(
    df: DataFrame, ids: Sequence[str], array: str, length: int, folds: int, normal: int = 0, nu: float = NU, features: int = FEATURES,
    gamma: float | None = None, steps: int = STEPS, group_rows: int | None = None,
) -> tuple[DataFrame, np.ndarray]:
    """Per fold counts and rates of the anomaly class, and the share of training rows outside each margin.

    Each fold tests its held-out normal rows and all anomalies. Scaling and margin come from the other normal rows.
    """
    is_normal = F.col("label") == normal
    held = plain_folds(df.where(is_normal), ids, folds, SEED, group_rows).select(*ids, F.col("fold").cast("int").alias("own"), array)
    odd = df.where(~is_normal).select(*ids, F.lit(_ODD).alias("own"), array)
    rows = durable(dealt(held.unionByName(odd), ids, df.count()).select("own", array), "rows")

    def moments(own: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.zeros((folds, 1 + 2 * length))
        for f in range(folds):
            part = x[own == f]
            out[f] = np.concatenate([[len(part)], part.sum(axis=0), (part**2).sum(axis=0)])
        return out.ravel()

    by_fold = matrix_sums(rows, array, "own", folds * (1 + 2 * length), moments).reshape(folds, -1)
    rest = by_fold.sum(axis=0) - by_fold
    n = np.maximum(rest[:, :1], 1)
    mean = rest[:, 1 : 1 + length] / n
    spread = np.sqrt(np.maximum(rest[:, 1 + length :] / n - mean**2, 0))
    spread[spread == 0] = 1
    lift = Fourier(length, features, gamma)
    trained = rest[:, 0]

    def scored(x: np.ndarray, f: int) -> tuple[np.ndarray, np.ndarray]:
        z = lift((x - mean[f]) / spread[f])
        return z, z @ w[f]

    def outside(own: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.zeros((folds, features + 1))
        for f in range(folds):
            z, s = scored(x, f)
            beyond = (own != _ODD) & (own != f) & (s < rho[f])
            out[f] = np.concatenate([[beyond.sum()], z[beyond].sum(axis=0)])
        return out.ravel()

    # The first pass has every row inside the sum, which gives the mean of the features: the margin for nu = 1.
    w, rho = np.zeros((folds, features)), np.full(folds, np.inf)
    for step in range(steps + 1):
        sums = matrix_sums(rows, array, "own", folds * (features + 1), outside).reshape(folds, -1)
        if step == 0:
            w = sums[:, 1:] / np.maximum(trained, 1)[:, None]
            rho = (w**2).sum(axis=1)
            continue
        pull = sums / (nu * np.maximum(trained, 1))[:, None]
        rate = 1 / (step + 1)
        rho = rho + rate * (1 - pull[:, 0]) * np.sqrt((w**2).sum(axis=1)) / 10
        w = w - rate * (w - pull[:, 1:])

    # A feature vector is no longer than sqrt(2), which bounds the scores.
    low, high = -np.sqrt(2 * (w**2).sum(axis=1)) - 1e-9, np.sqrt(2 * (w**2).sum(axis=1)) + 1e-9

    def histogram(own: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.zeros((folds, BINS + 1))
        for f in range(folds):
            s = scored(x, f)[1][(own != _ODD) & (own != f)]
            at = np.floor((s - low[f]) / (high[f] - low[f]) * BINS)
            out[f] = np.bincount(np.clip(at + 1, 0, BINS + 1).astype(int), minlength=BINS + 2)[: BINS + 1]
        return out.ravel()

    for _ in range(2):
        # The first cell counts what lies below the range.
        upto = np.cumsum(matrix_sums(rows, array, "own", folds * (BINS + 1), histogram).reshape(folds, -1), axis=1)
        cell = np.array([np.searchsorted(upto[f], nu * trained[f], side="right") for f in range(folds)])
        cell = np.clip(cell - 1, 0, BINS - 1)
        width = (high - low) / BINS
        low, high = low + cell * width, low + (cell + 1) * width
    rho = low

    def tested(own: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.zeros((folds, 5))
        for f in range(folds):
            s, odd = scored(x, f)[1], own == _ODD
            out[f] = [((own == f) & (s < rho[f])).sum(), ((own == f) & (s >= rho[f])).sum(), (odd & (s < rho[f])).sum(), (odd & (s >= rho[f])).sum(), (~odd & (own != f) & (s < rho[f])).sum()]
        return out.ravel()

    counts = matrix_sums(rows, array, "own", folds * 5, tested).reshape(folds, 5)
    listed = [(f, *[int(v) for v in counts[f, [2, 0, 1, 3]]]) for f in range(folds)]
    rated = df.sparkSession.createDataFrame(listed, "fold int, tp long, fp long, tn long, fn long").withColumns(
        {"precision": safe_ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": safe_ratio(F.col("tp"), F.col("tp") + F.col("fn"))}
    )
    return rated.withColumn("f1", f1(F.col("precision"), F.col("recall"))), counts[:, 4] / np.maximum(trained, 1)
