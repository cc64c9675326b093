"""Alignment of metric and log rows to one timeline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.statistics import known
from pulsegrid.operators.ordered import known_around, positions, row_frames


def floor_time(ts: Column, every: str) -> Column:
    return F.window(ts, every)["start"]


def mean_per_instant(df: DataFrame, keys: Sequence[str] = ("metric",), ts: str = "ts", value: str = "value") -> DataFrame:
    """Mean over all entities that report the same instant."""
    return df.groupBy(*keys, ts).agg(F.avg(known(value)).alias(value))


def resample(
    df: DataFrame, every: str, keys: Sequence[str] = ("metric",), ts: str = "ts", value: str = "value"
) -> DataFrame:
    """Tumbling mean per key; buckets without rows do not appear."""
    return df.groupBy(*keys, floor_time(F.col(ts), every).alias(ts)).agg(F.avg(known(value)).alias(value))


def range_per_metric(df: DataFrame, keys: Sequence[str] = ("metric",), value: str = "value") -> DataFrame:
    v = known(value)
    return df.groupBy(*keys).agg(F.count(v).alias("points"), F.min(v).alias("min_value"), F.max(v).alias("max_value"))


def collapse_mean(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(known(v)).alias(v) for v in values])


def collapse_last(df: DataFrame, keys: Sequence[str], values: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last non-null value of each column by ``order``."""
    return df.groupBy(*keys).agg(
        *[F.max_by(v, F.when(F.col(v).isNotNull(), F.struct(*order))).alias(v) for v in values]
    )


def _span(df: DataFrame, ts: str) -> Column:
    return df.select(F.struct(F.min(ts).alias("lo"), F.max(ts).alias("hi"))).scalar()


def clip_to_overlap(
    left: DataFrame, right: DataFrame, ts: str = "ts", first_minutes: int = 0
) -> tuple[DataFrame, DataFrame]:
    """Both frames within the time range they share, or its first minutes.

    A pair without overlap gives two empty frames; ``require_overlap`` turns that into an error.
    """

    def clip(df: DataFrame) -> DataFrame:
        a, b = _span(left, ts), _span(right, ts)
        lo = F.greatest(a["lo"], b["lo"])
        hi = F.least(a["hi"], b["hi"])
        if first_minutes > 0:
            hi = F.least(hi, lo + F.expr(f"interval {int(first_minutes)} minutes"))
        return df.where((F.col(ts) >= lo) & (F.col(ts) <= hi))

    return clip(left), clip(right)


def require_overlap(left: DataFrame, right: DataFrame, ts: str = "ts") -> None:
    a = left.agg(F.min(ts), F.max(ts)).first()
    b = right.agg(F.min(ts), F.max(ts)).first()
    if None in (*a, *b) or max(a[0], b[0]) > min(a[1], b[1]):
        raise ValueError(f"no shared time range: {a[0]}..{a[1]} and {b[0]}..{b[1]}")


def first_instants(df: DataFrame, count: int, ts: str = "ts") -> DataFrame:
    """Rows of the first ``count`` distinct instants; 0 keeps all."""
    if count <= 0:
        return df
    cut = df.select(ts).distinct().orderBy(ts).limit(count).agg(F.max(ts)).scalar()
    return df.where(F.col(ts) <= cut)


def to_wide(df: DataFrame, metrics: Sequence[str], ts: str = "ts", value: str = "value", keys: Sequence[str] = ()) -> DataFrame:
    """One row per instant, one column per metric; full outer alignment without joins."""
    return df.groupBy(*keys, ts).pivot("metric", list(metrics)).agg(F.first(value))


def to_long(df: DataFrame, metrics: Sequence[str], ids: Sequence[str] = ("ts",), value: str = "value") -> DataFrame:
    return df.unpivot([F.col(i) for i in ids], [F.col(m) for m in metrics], "metric", value)


def align_left(timeline: DataFrame, other: DataFrame, on: Sequence[str] = ("ts",)) -> DataFrame:
    """``other`` on the timeline of the first frame, null where it has no row."""
    return timeline.join(other, list(on), "left")


FILL_FORWARD = 3
FILL_INTERPOLATE = 10
FILL_BACKWARD = 3


def fill_gaps(
    df: DataFrame,
    keys: Sequence[str] = ("metric",),
    ts: str = "ts",
    value: str = "value",
    unlimited: bool = True,
    group_rows: int | None = None,
) -> DataFrame:
    """Forward fill of 3 rows, linear interpolation of 10 rows from either side, backward fill of 3.

    Limits count rows of the timeline, which must be complete (one row per instant and key).
    ``unlimited`` then fills what is left forward and backward, as for metrics. Only the nearest
    known points on both sides matter, so every fill follows from them by arithmetic.
    """
    placed = positions(df, keys, [ts], "_p", group_rows)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("_p").alias("p"), F.col(value).alias("v")))
    seen = known_around(placed, keys, ["_p"], {"_a": known}, {"_b": known}, group_rows)

    p, a, b = F.col("_p"), F.col("_a"), F.col("_b")
    has_a, has_b = a.isNotNull(), b.isNotNull()
    left_edge = a["p"] + FILL_FORWARD
    slope = (b["v"] - a["v"]) / (b["p"] - left_edge)

    def line(at: Column) -> Column:
        return a["v"] + slope * (at - left_edge)

    near_left = has_a & (p - left_edge <= FILL_INTERPOLATE)
    near_right = has_b & (b["p"] - p <= FILL_INTERPOLATE)
    back_reach = has_b & (b["p"] - p <= FILL_INTERPOLATE + FILL_BACKWARD)
    filled = (
        F.when(F.col(value).isNotNull(), F.col(value))
        .when(has_a & (p <= left_edge), a["v"])
        .when(has_a & has_b & (near_left | near_right), line(p))
        .when(has_a & near_left, a["v"])
        .when(~has_a & near_right, b["v"])
        .when(has_a & back_reach, line(b["p"] - FILL_INTERPOLATE))
        .when(~has_a & back_reach, b["v"])
    )
    if unlimited:
        filled = (
            filled.when(has_a & has_b, line(left_edge + FILL_INTERPOLATE)).when(has_a, a["v"]).when(has_b, b["v"])
        )
    return seen.withColumn(value, filled).drop("_p", "_a", "_b")


def time_gaps(
    df: DataFrame,
    keys: Sequence[str] = ("metric",),
    ts: str = "ts",
    longer_than_seconds: float = 1.0,
    group_rows: int | None = None,
) -> DataFrame:
    """Count, longest and total of the steps between neighbouring rows that exceed a length."""
    seconds = F.col(ts).cast("timestamp").cast("double")

    def step(rows, w):
        return rows.withColumn("_step", F.round(seconds - F.lag(seconds).over(w), 6))

    rows = df.select(*keys, ts, F.monotonically_increasing_id().alias("_tie"))  # rows of one instant may be split
    stepped = row_frames(rows, keys, [ts, "_tie"], 1, 0, step, group_rows)
    long_step = F.when(F.col("_step") > longer_than_seconds, F.col("_step"))
    return stepped.groupBy(*keys).agg(
        F.count(long_step).alias("gap_count"),
        F.max(long_step).alias("max_gap"),
        F.coalesce(F.sum(long_step), F.lit(0.0)).alias("total_gap"),
    )


def backward_steps(
    df: DataFrame, keys: Sequence[str], ts: str, arrival: Sequence[str], group_rows: int | None = None
) -> DataFrame:
    """Rows per key whose time lies before that of the row that arrived just earlier."""

    def step(rows, w):
        return rows.withColumn("_back", (F.col(ts) < F.lag(ts).over(w)).cast("int"))

    stepped = row_frames(df.select(*keys, ts, *arrival), keys, list(arrival), 1, 0, step, group_rows)
    return stepped.groupBy(*keys).agg(F.coalesce(F.sum("_back"), F.lit(0)).alias("backward_steps"))
