"""Streams of metric and label rows on a time grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WATERMARK = "30 seconds"


def aligned(stream: DataFrame, every: str = "1 second", keys: Sequence[str] = ("metric",), ts: str = "ts", value: str = "value", watermark: str = WATERMARK) -> DataFrame:
    """Mean per key and interval, emitted once the watermark has passed the interval; later rows are dropped."""
    return (
        stream.withWatermark(ts, watermark)
        .groupBy(*keys, F.window(ts, every))
        .agg(F.avg(value).alias(value), F.count(value).alias("points"))
        .select(*keys, F.col("window.start").alias(ts), value, "points")
    )


def aligned_logs(stream: DataFrame, every: str = "1 second", ts: str = "ts", watermark: str = WATERMARK) -> DataFrame:
    """Records and rarest template number per interval."""
    return (
        stream.withWatermark(ts, watermark)
        .groupBy(F.window(ts, every))
        .agg(F.count("number").alias("records"), F.max("number").alias("log_template"))
        .select(F.col("window.start").alias(ts), "records", "log_template")
    )


def deduplicated(stream: DataFrame, ids: Sequence[str], ts: str = "ts", watermark: str = WATERMARK) -> DataFrame:
    """First row of each id within the watermark."""
    return stream.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(list(ids))


def unlabelled_periods(
    stream: DataFrame, keys: Sequence[str] = ("label",), gap: str = "1 second", ts: str = "ts", label: str = "label", watermark: str = WATERMARK
) -> DataFrame:
    """Periods of unlabelled rows at most ``gap`` apart per key, as sessions; the end is that of the last row.

    A stream needs a key for sessions. Without a series, the label serves as one.
    """
    sessions = (
        stream.where(F.col(label) == -1)
        .withWatermark(ts, watermark)
        .groupBy(*keys, F.session_window(ts, gap).alias("s"))
        .agg(F.count(F.lit(1)).alias("instants"))
    )
    kept = [k for k in keys if k != label]
    return sessions.select(
        *kept, F.col("s.start").alias("start_ts"), (F.col("s.end") - F.expr(f"interval {gap}")).alias("end_ts"), "instants"
    )
