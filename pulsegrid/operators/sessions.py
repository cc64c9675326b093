"""Analytics of fault-injection session records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.ordered import order_statistic


def faults_by_type(faults: DataFrame) -> DataFrame:
    return faults.groupBy(F.coalesce("fault_type", F.lit("unknown")).alias("fault_type")).agg(F.count(F.lit(1)).alias("n"))


def top_targets(faults: DataFrame, k: int = 8) -> DataFrame:
    """Most often hit targets; equal counts by name."""
    counts = faults.groupBy(F.coalesce("target_service", F.lit("unknown")).alias("target_service")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), "target_service").limit(k)


def duration_summary(faults: DataFrame, duration: str = "duration_s", group_rows: int | None = None) -> DataFrame:
    """Count, minimum, maximum and upper median (element at n / 2) of the fault durations."""
    median = order_statistic(faults, [], duration, 0.5, "median_s", group_rows=group_rows).select("median_s").scalar()
    return faults.agg(
        F.count(duration).alias("n"), F.min(duration).alias("min_s"), F.max(duration).alias("max_s")
    ).withColumn("median_s", median)
