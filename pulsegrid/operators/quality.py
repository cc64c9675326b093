"""Data quality reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.statistics import known, sample_kurtosis, sample_skewness
from pulsegrid.operators.ordered import attach
from pulsegrid.operators.timegrid import backward_steps, time_gaps
from pulsegrid.storage import durable


def metric_quality(
    df: DataFrame, keys: Sequence[str] = ("metric",), ts: str = "ts", value: str = "value", gap_seconds: float = 1.0,
    group_rows: int | None = None, arrival: Sequence[str] = (),
) -> DataFrame:
    """Points, nulls, range, moments, outliers beyond 3 deviations, and time gaps per metric.

    A missing value is null or NaN, and no statistic counts it. ``valid`` needs a metric without missing values and gaps and, if
    ``arrival`` names the columns that order the rows as they came, without steps back in time.
    """
    v = known(value)
    stats = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("points"),
        F.count_if(v.isNull()).alias("nan_count"),
        F.min(v).alias("min_value"),
        F.max(v).alias("max_value"),
        F.avg(v).alias("mean_value"),
        F.stddev_samp(v).alias("std_value"),
        sample_skewness(v).alias("skewness"),
        sample_kurtosis(v).alias("kurtosis"),
    )
    stats = durable(stats, "stats")
    scored = attach(df.select(*keys, value), stats, keys, ["mean_value", "std_value"])
    beyond = (F.col("std_value") > 0) & (F.abs((v - F.col("mean_value")) / F.col("std_value")) > 3)
    outliers = scored.groupBy(*keys).agg(F.count_if(beyond).alias("outliers"))
    gaps = time_gaps(df, keys, ts, gap_seconds, group_rows)
    joined = attach(attach(stats, outliers, keys, ["outliers"]), gaps, keys, ["gap_count", "max_gap", "total_gap"])
    valid = (F.col("nan_count") == 0) & (F.col("gap_count") == 0) & (F.col("points") > 0)
    if arrival:
        joined = attach(joined, backward_steps(df, list(keys), ts, list(arrival), group_rows), keys, ["backward_steps"])
        valid = valid & (F.col("backward_steps") == 0)
    return joined.withColumns({"outlier_percentage": F.col("outliers") / F.col("points") * 100, "valid": valid})


def overall_valid(report: DataFrame, missing: DataFrame) -> DataFrame:
    """One verdict: all metrics of a report are valid and none of the catalogue is missing."""
    absent = missing.agg(F.count(F.lit(1))).scalar()
    return report.agg(F.coalesce(F.bool_and("valid"), F.lit(False)).alias("metrics_valid"), F.count(F.lit(1)).alias("metrics")).select(
        "metrics", absent.alias("missing"), (F.col("metrics_valid") & (absent == 0)).alias("valid")
    )


def column_profile(df: DataFrame, skip: Sequence[str] = (), numeric_share: float = 1.0) -> DataFrame:
    """Kind of every column from its values: continuous, categorical or empty; one scan."""
    names = [c for c in df.columns if c not in skip]
    text = {c: F.col(c).cast("string") for c in names}
    counts = df.agg(
        *[F.count(text[c]).alias(f"{c}__known") for c in names],
        *[F.count(text[c].try_cast("double")).alias(f"{c}__numeric") for c in names],
    )
    listed = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(f"{c}__known").alias("known"), F.col(f"{c}__numeric").alias("numeric")) for c in names]
    )
    kind = (
        F.when(F.col("known") == 0, F.lit("empty"))
        .when(F.col("numeric") >= F.col("known") * numeric_share, F.lit("continuous"))
        .otherwise(F.lit("categorical"))
    )
    return counts.select(F.explode(listed).alias("c")).select("c.*").withColumn("kind", kind)


def nan_counts(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(c) for c in columns])


def window_structure(windows: DataFrame, size: int, steps: str = "steps", group: str = "group") -> DataFrame:
    """Per group: windows, their length range, and whether all groups have as many windows of the right length."""
    per_group = windows.groupBy(group).agg(
        F.count(F.lit(1)).alias("windows"), F.min(F.size(steps)).alias("shortest"), F.max(F.size(steps)).alias("longest")
    )
    most, least = per_group.agg(F.max("windows")).scalar(), per_group.agg(F.min("windows")).scalar()
    return per_group.withColumn("ok", (F.col("shortest") == size) & (F.col("longest") == size) & (most == least))


def collected_counts(metrics: DataFrame, lines: DataFrame, line: str = "value") -> DataFrame:
    """Metric rows and non-blank log lines of a collection."""
    filled = lines.agg(F.count_if(F.length(F.trim(line)) > 0)).scalar()
    return metrics.agg(F.count(F.lit(1)).alias("metric_rows")).withColumn("log_lines", filled)
