"""Time expressions and the time ranges of collection slices."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SESSION_BUFFER_SECONDS = 120
SLICE_MINUTES = 10


def parse_iso(text: Column) -> Column:
    """UTC timestamp from ISO text, null if it is none."""
    return text.try_cast("timestamp")


def floor_div(value: Column, by: int) -> Column:
    """Whole quotient of long values, rounded down; division of doubles would lose the last digits of nanoseconds."""
    whole = value.cast("long")
    return F.call_function("div", whole - F.pmod(whole, F.lit(by).cast("long")), F.lit(by).cast("long"))


def from_epoch(value: Column, unit: str) -> Column:
    if unit == "s":
        return F.timestamp_micros((value.cast("double") * 1_000_000).cast("long"))
    if unit == "ms":
        return F.timestamp_millis(value.cast("long"))
    if unit == "us":
        return F.timestamp_micros(value.cast("long"))
    if unit == "ns":
        return F.timestamp_micros(floor_div(value, 1000))
    raise ValueError(f"unknown time unit {unit!r}; use s, ms, us or ns")


def parse_start(text: str, now: datetime) -> datetime | None:
    """``-3600s`` relative to ``now``, or ISO text; None if it is neither."""
    text = text.strip()
    if re.fullmatch(r"-*\d+s", text):
        return now + timedelta(seconds=int(text[:-1]))
    try:
        moment = datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        return None
    return moment.replace(tzinfo=timezone.utc) if moment.tzinfo is None else moment.astimezone(timezone.utc)


def session_ranges(sessions: DataFrame, now: Column | None = None, first_minutes: int = 0) -> DataFrame:
    """Collection range of each session: from its start minus a buffer to its end plus the buffer.

    ``first_minutes`` ends the range early, never later than ``now``. A session that has not begun
    has no range; one still running has no stop.
    """
    now = F.current_timestamp() if now is None else now
    start = parse_iso(F.col("session_start"))
    pad = F.expr(f"interval {SESSION_BUFFER_SECONDS} seconds")
    if first_minutes > 0:
        stop = F.least(start + F.expr(f"interval {int(first_minutes)} minutes"), now) + pad
    else:
        stop = parse_iso(F.col("session_end")) + pad
    begun = start <= now
    return sessions.select(
        "*", F.when(begun, start - pad).alias("range_start"), F.when(begun, stop).alias("range_stop")
    )


def time_slices(spark: SparkSession, start: datetime, stop: datetime, minutes: int = SLICE_MINUTES) -> DataFrame:
    """[slice_start, slice_stop) pieces that cover the range; the last one may be short."""
    step = F.expr(f"interval {int(minutes)} minutes")
    pieces = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(stop), step)).alias("slice_start"))
    return pieces.where(F.col("slice_start") < F.lit(stop)).withColumn(
        "slice_stop", F.least(F.col("slice_start") + step, F.lit(stop))
    )
