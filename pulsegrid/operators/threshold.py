"""Extreme-value alarm thresholds (peaks over threshold), fitted for all keys in one job.

The tail beyond an initial threshold is modelled by a generalised Pareto distribution. With
theta = gamma / sigma its likelihood has one free parameter: for a given theta,
gamma = mean ln(1 + theta y), and theta is stationary where
(1 + mean ln(1 + theta y)) * mean 1 / (1 + theta y) = 1. Both means are sums over peaks, so they are
taken for a fixed grid of theta with an ordinary aggregation, and the sign changes between
neighbouring grid points give the stationary points. The same sums are the whole state of the
streaming detector, which therefore does not grow with the number of peaks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.operators.ordered import attach, order_statistics
from pulsegrid.storage import durable

# The grid of theta, in units of 1 / (mean excess of the fit): geometric on both sides of 0.
GRID_NEGATIVE, GRID_POSITIVE = 90, 96
GRID_START, GRID_STEP_NEGATIVE, GRID_STEP_POSITIVE = 0.002, 1.08, 1.12
GRID_SIZE = GRID_NEGATIVE + GRID_POSITIVE

# Shape limit, and the cap of a threshold relative to the initial one.
SHAPE_LIMIT = 0.5
CAP_SHARE = 0.5
NEAR_ZERO_SHAPE = 1e-8


def grid_value(k: Column) -> Column:
    """k-th grid point, ascending in k."""
    negative = -GRID_START * F.pow(F.lit(GRID_STEP_NEGATIVE), F.lit(GRID_NEGATIVE - 1) - k)
    positive = GRID_START * F.pow(F.lit(GRID_STEP_POSITIVE), k - GRID_NEGATIVE)
    return F.when(k < GRID_NEGATIVE, negative).otherwise(positive)


def tail_sign(tail: str) -> int:
    if tail not in ("upper", "lower"):
        raise ValueError("tail must be 'upper' or 'lower'")
    return 1 if tail == "upper" else -1


def initial_thresholds(
    scores: DataFrame, keys: Sequence[str], score: str, quantiles: Sequence[float], tail: str = "upper", group_rows: int | None = None
) -> DataFrame:
    """(keys, quantile, n, init): the element at floor(q n) of the sorted scores, q mirrored for a lower tail; one pass for all quantiles."""
    mirrored = {float(q if tail_sign(tail) > 0 else 1 - q): float(q) for q in quantiles}
    found = order_statistics(scores, keys, score, list(mirrored), group_rows=group_rows)
    asked = F.create_map(*[F.lit(x) for pair in mirrored.items() for x in pair])
    return found.select(*keys, F.element_at(asked, F.col("q")).alias("quantile"), "n", F.col("value").alias("init"))


def quantile_offset(gamma: Column, sigma: Column, n: Column, peaks: Column, risk: Column) -> Column:
    """Distance of the alarm threshold from the initial one."""
    r = n * risk / peaks
    return F.when(F.abs(gamma) > NEAR_ZERO_SHAPE, sigma / gamma * (F.pow(r, -gamma) - 1)).otherwise(-sigma * F.ln(r))


def capped(threshold: Column, init: Column) -> Column:
    return F.least(threshold, init + CAP_SHARE * F.abs(init))


def grid_points() -> np.ndarray:
    """The grid as an array."""
    negative = -GRID_START * GRID_STEP_NEGATIVE ** np.arange(GRID_NEGATIVE - 1, -1, -1.0)
    return np.concatenate([negative, GRID_START * GRID_STEP_POSITIVE ** np.arange(0.0, GRID_POSITIVE)])


def excess_sums(peaks: DataFrame, keys: Sequence[str], excess: str = "y", scale: str = "scale") -> DataFrame:
    """Per key: for every grid point the sums over its peaks, null where a peak lies outside the support.

    A task adds up the grid of every key of an Arrow batch, so what is shuffled is a row per batch, key and grid point, not one per peak.
    """
    rows = peaks.select(*keys, F.col(excess).alias("_y"), F.col(scale).alias("_scale"), "sum_excess")
    sums = ["k", "_c", "_ok", "_log", "_inv", "sum_excess", "_scale"]
    types = "k int, _c long, _ok long, _log double, _inv double, sum_excess double, _scale double"
    schema = T.StructType([*[rows.schema[k] for k in keys], *T.StructType.fromDDL(types).fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = grid_points()
        at = pa.array(np.arange(GRID_SIZE), pa.int32())
        for batch in batches:
            if not batch.num_rows:
                continue
            named = batch.select(list(keys))
            codes = np.zeros(batch.num_rows, dtype=np.int64)
            for column in named.columns:
                encoded = column.dictionary_encode(null_encoding="encode")
                codes = codes * (len(encoded.dictionary) + 1) + encoded.indices.to_numpy(zero_copy_only=False)
            y, scales, totals = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_y", "_scale", "sum_excess"))
            for code in np.unique(codes):
                own = np.flatnonzero(codes == code)
                with np.errstate(all="ignore"):
                    s = 1 + grid / scales[own[0]] * y[own, None]
                    inside = s > 0
                    s[~inside] = 1.0
                first = named.take(pa.array(np.full(GRID_SIZE, own[0])))
                same = lambda v, kind: pa.array(np.full(GRID_SIZE, v), kind)
                found = [
                    at, same(own.size, pa.int64()), pa.array(inside.sum(axis=0), pa.int64()), pa.array(np.log(s).sum(axis=0)),
                    pa.array(np.where(inside, 1 / s, 0.0).sum(axis=0)), same(totals[own[0]], pa.float64()), same(scales[own[0]], pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays([*first.columns, *found], names=[*keys, *sums])

    parts = rows.mapInArrow(work, schema)
    return parts.groupBy(*keys, "k").agg(
        F.sum("_c").alias("_c"), F.sum("_ok").alias("_ok"), F.sum("_log").alias("_log"), F.sum("_inv").alias("_inv"),
        F.max("sum_excess").alias("sum_excess"), F.max("_scale").alias(scale),
    ).select(
        *keys, "k", "sum_excess", scale, F.col("_c").alias("peaks"),
        F.when(F.col("_ok") == F.col("_c"), F.col("_log")).alias("log_sum"),
        F.when(F.col("_ok") == F.col("_c"), F.col("_inv")).alias("inv_sum"),
    )


def with_stationary_point(sums: DataFrame, keys: Sequence[str], scale: str = "scale") -> DataFrame:
    """Adds ``point`` (fit, gamma, sigma) where the condition changes sign before the next grid point.

    A larger fit is likelier. The window holds one row per grid point, so it is as small as the grid.
    """
    w = Window.partitionBy(*keys).orderBy("k")
    mean_log, mean_inv = F.col("log_sum") / F.col("peaks"), F.col("inv_sum") / F.col("peaks")
    prepared = sums.withColumns(
        {"_l0": mean_log, "_w0": (1 + mean_log) * mean_inv - 1, "_t0": grid_value(F.col("k")) / F.col(scale)}
    )
    paired = prepared.withColumns({f"_{n}1": F.lead(f"_{n}0").over(w) for n in ("l", "w", "t")})
    crossing = (F.col("k") != GRID_NEGATIVE - 1) & ((F.col("_w0") < 0) != (F.col("_w1") < 0))
    share = F.col("_w0") / (F.col("_w0") - F.col("_w1"))
    gamma = F.col("_l0") + share * (F.col("_l1") - F.col("_l0"))
    theta = F.col("_t0") + share * (F.col("_t1") - F.col("_t0"))
    point = F.struct((-F.ln("_s") - F.col("_g")).alias("fit"), F.col("_g").alias("gamma"), F.col("_s").alias("sigma"))
    shaped = paired.withColumns({"_g": F.when(crossing, gamma), "_s": F.when(crossing, gamma / theta)})
    return shaped.withColumn("point", F.when(F.col("_s").isNotNull(), point)).drop(
        "_g", "_s", *[f"_{n}{i}" for n in ("l", "w", "t") for i in (0, 1)]
    )


def fit_tails(
    scores: DataFrame,
    keys: Sequence[str],
    score: str,
    quantiles: Sequence[float],
    tail: str = "upper",
    group_rows: int | None = None,
    written: bool = False,
) -> DataFrame:
    """One row per key and quantile: n, init, peaks, gamma, sigma, and the sums a stream starts from.

    All quantiles share each pass: a row is repeated for those quantiles only in whose tail it lies. Scores are read several times,
    so their narrow columns are written once first, unless they are a written table already; so are the few peaks.
    """
    sign, by = tail_sign(tail), [*keys, "quantile"]
    scores = scores.select(*keys, score)
    if not written:
        scores = durable(scores, "scores")
    start = durable(initial_thresholds(scores, keys, score, quantiles, tail, group_rows), "start")
    listed = start.groupBy(*keys).agg(F.collect_list(F.struct("quantile", "init")).alias("_q"))
    beyond = F.filter("_q", lambda x: sign * (F.col(score) - x["init"]) > 0)
    tails = attach(scores, listed, keys, ["_q"]).select(*keys, score, F.explode(beyond).alias("_q"))
    peaks = durable(tails.select(*keys, "_q.quantile", (sign * (F.col(score) - F.col("_q.init"))).alias("y")), "peaks")
    basics = peaks.groupBy(*by).agg(F.sum("y").alias("sum_excess"), F.avg("y").alias("scale"))
    sums = excess_sums(attach(peaks, basics, by, ["sum_excess", "scale"]), by)
    tails = with_stationary_point(sums, by).groupBy(*by).agg(
        F.max("peaks").alias("peaks"), F.max("sum_excess").alias("sum_excess"), F.max("scale").alias("scale"),
        F.max("point").alias("_best"), F.array_sort(F.collect_list(F.struct("k", "log_sum", "inv_sum"))).alias("_s"),
    )
    fitted = attach(start, tails, by, ["peaks", "sum_excess", "scale", "_best", "_s"])
    pareto = F.col("_best").isNotNull() & (F.col("_best.fit") > -F.ln("scale"))
    gamma = F.when(pareto, F.greatest(F.lit(-SHAPE_LIMIT), F.least(F.lit(SHAPE_LIMIT), F.col("_best.gamma")))).when(
        F.col("peaks") > 0, F.lit(0.0)
    )
    sigma = F.when(pareto, F.col("_best.sigma")).otherwise(F.col("scale"))
    return fitted.withColumns({"gamma": gamma, "sigma": sigma, "peaks": F.coalesce("peaks", F.lit(0))}).select(
        *by, "n", "init", "peaks", "gamma", "sigma", "sum_excess", "scale",
        F.transform("_s", lambda p: p["log_sum"]).alias("log_sums"),
        F.transform("_s", lambda p: p["inv_sum"]).alias("inv_sums"),
    )


def fit_thresholds(
    scores: DataFrame,
    keys: Sequence[str],
    score: str = "score",
    quantile: float = 0.98,
    risk: float = 1e-3,
    tail: str = "upper",
    group_rows: int | None = None,
    written: bool = False,
) -> DataFrame:
    """One row per key: n, init, peaks, gamma, sigma, threshold, and the sums a stream starts from. Without peaks the threshold is the initial one."""
    fitted = fit_tails(scores, keys, score, [quantile], tail, group_rows, written).withColumn("risk", F.lit(float(risk)))
    return fitted.withColumn("threshold", alarm_level(F.col("risk"), tail_sign(tail))).select(
        *keys, "n", "init", "peaks", "gamma", "sigma", "threshold", "risk", "sum_excess", "scale", "log_sums", "inv_sums"
    )


def alarm_level(risk: Column, sign: int = 1) -> Column:
    """Alarm threshold of a fit (n, init, peaks, gamma, sigma) at a risk."""
    offset = quantile_offset(F.col("gamma"), F.col("sigma"), F.col("n"), F.col("peaks"), risk)
    init = F.col("init")
    level = capped(init + offset, init) if sign > 0 else init - offset
    return F.when(F.col("peaks") > 0, level).otherwise(init)


def classify(
    scores: DataFrame, fitted: DataFrame, keys: Sequence[str], score: str = "score", tail: str = "upper", out: str = "alarm"
) -> DataFrame:
    """1 where the score lies beyond the fitted threshold of its key."""
    joined = attach(scores, fitted, keys, ["threshold"])
    beyond = F.col(score) > F.col("threshold") if tail_sign(tail) > 0 else F.col(score) < F.col("threshold")
    return joined.withColumn(out, F.coalesce(beyond, F.lit(False)).cast("int"))
