"""Metric selection, cleaning, repair and scaling on long-format rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.statistics import known
from pulsegrid.functions.timeparse import floor_div
from pulsegrid.operators.ordered import attach


@dataclass(frozen=True)
class MetricSpec:
    """Where one metric is found: a measurement, a value column or field name, and tag filters."""

    group: str
    metric: str
    measurement: str
    column: str
    filters: dict[str, str] = field(default_factory=dict)


def _tag(df: DataFrame, name: str) -> Column | None:
    if name in df.columns:
        return F.col(name).cast("string")
    if "tags" in df.columns:
        return F.element_at("tags", name)
    return None


def _matches(df: DataFrame, spec: MetricSpec) -> Column:
    match = F.col("_measurement") == spec.measurement
    if spec.column not in df.columns:
        match = match & (F.col("_field") == spec.column)
    for name, wanted in spec.filters.items():
        tag = _tag(df, name)
        if tag is not None:
            match = match & (tag == wanted)
    return match


def select_metrics(df: DataFrame, catalogue: Sequence[MetricSpec]) -> DataFrame:
    """Rows as (group, metric, value) for every catalogue entry they match, in one pass.

    The value is the configured column if the table has it, else ``_value`` of the rows whose
    ``_field`` has that name. A filter on a tag that the table lacks is ignored.
    """
    hits = [
        F.when(
            _matches(df, spec),
            F.struct(
                F.lit(spec.group).alias("group"),
                F.lit(spec.metric).alias("metric"),
                to_number(F.col(spec.column if spec.column in df.columns else "_value")).alias("value"),
            ),
        )
        for spec in catalogue
    ]
    wanted = {spec.measurement for spec in catalogue}
    taken = {"group", "metric", "value"}
    kept = [c for c in df.columns if c not in taken]
    return (
        df.where(F.col("_measurement").isin(*sorted(wanted)))
        .withColumn("_hit", F.explode(F.array_compact(F.array(*hits))))
        .select(*kept, "_hit.group", "_hit.metric", "_hit.value")
    )


def to_number(value: Column) -> Column:
    """Number from text that may hold thousands separators or quotes; null if it is none."""
    text = F.trim(F.translate(value.cast("string"), ',"', ""))
    number = text.try_cast("double")
    return F.when(F.isnan(number), None).otherwise(number)


def drop_null_points(df: DataFrame, value: str = "value") -> DataFrame:
    return df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value)))


def finite_or_zero(value: Column) -> Column:
    number = value.cast("double")
    bad = number.isNull() | F.isnan(number) | (F.abs(number) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(number)


def epoch_to_millis(value: Column, largest: Column) -> Column:
    """Milliseconds from an epoch whose unit follows from the size of the largest value."""
    return (
        F.when(largest < F.lit(10**11), value * 1000)
        .when(largest < F.lit(10**14), value)
        .when(largest < F.lit(10**17), floor_div(value, 1000))
        .otherwise(floor_div(value, 1_000_000))
        .cast("long")
    )


def normalise_epoch(df: DataFrame, column: str = "_time") -> DataFrame:
    """Replace an epoch column of unknown unit by milliseconds; one unit per table."""
    largest = df.select(F.max(F.abs(F.col(column)))).scalar()
    return df.withColumn(column, epoch_to_millis(F.col(column), largest))


def clip_negative(df: DataFrame, columns: Sequence[str] = ("counter", "gauge")) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c) < 0, F.lit(0.0)).otherwise(F.col(c)) for c in columns})


def value_column_map(df: DataFrame, measurement: str = "_measurement") -> DataFrame:
    """Which of counter / gauge each measurement fills; counter wins, none of the two gives null."""
    return df.groupBy(measurement).agg(
        F.when(F.bool_or(F.col("counter").isNotNull()), F.lit("counter"))
        .when(F.bool_or(F.col("gauge").isNotNull()), F.lit("gauge"))
        .alias("value_column")
    )


# Measurements whose name holds one of these words are gauges; used without a mapping.
GAUGE_NAME_WORDS = ("memory", "spec", "tasks_state", "fs_io_current", "fs_limit")


def _name_heuristic(measurement: Column) -> Column:
    is_gauge = measurement.rlike("|".join(GAUGE_NAME_WORDS))
    return F.when(is_gauge, F.lit("gauge")).otherwise(F.lit("counter"))


def one_value_column(df: DataFrame, mapping: DataFrame, measurement: str = "_measurement") -> DataFrame:
    """Keep one of counter / gauge per row, the one its measurement uses; 0.0 there if both are null."""
    mapped = attach(df, mapping, [measurement], ["value_column"])
    use = F.coalesce("value_column", _name_heuristic(F.col(measurement)))
    counter, gauge = F.col("counter"), F.col("gauge")
    both = counter.isNotNull() & gauge.isNotNull()
    none = counter.isNull() & gauge.isNull()
    known = F.col("value_column")
    return (
        mapped.withColumn("_use", use)
        .withColumn(
            "_counter",
            F.when(both & (F.col("_use") == "gauge"), None)
            .when(none & (known == "counter"), F.lit(0.0))
            .otherwise(counter),
        )
        .withColumn(
            "gauge",
            F.when(both & (F.col("_use") == "counter"), None)
            .when(none & (known == "gauge"), F.lit(0.0))
            .otherwise(gauge),
        )
        .withColumn("counter", F.col("_counter"))
        .drop("_use", "_counter", "value_column")
    )


def fit_scaler(df: DataFrame, keys: Sequence[str] = ("metric",), value: str = "value") -> DataFrame:
    """Mean and sample standard deviation per key."""
    v = known(value)
    return df.groupBy(*keys).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"))


def apply_scaler(
    df: DataFrame, stats: DataFrame, keys: Sequence[str] = ("metric",), value: str = "value", out: str = "z"
) -> DataFrame:
    """z-score with given statistics; the raw value where there are none or the deviation is not positive."""
    joined = attach(df, stats, keys, ["mean", "std"])
    z = F.when(F.col("std") > 0, (F.col(value) - F.col("mean")) / F.col("std")).otherwise(F.col(value))
    return joined.withColumn(out, z).drop("mean", "std")


def missing_metrics(df: DataFrame, catalogue: Sequence[MetricSpec]) -> DataFrame:
    """Catalogue metrics that no row carries."""
    names = df.sparkSession.createDataFrame([(s.group, s.metric) for s in catalogue], "group string, metric string")
    return names.join(df.select("metric").distinct(), "metric", "left_anti").select("group", "metric")


def group_columns(catalogue: Sequence[MetricSpec], available: Sequence[str]) -> dict[str, list[str]]:
    """Metric columns of every group that the frame has, in catalogue order."""
    groups: dict[str, list[str]] = {}
    for spec in catalogue:
        groups.setdefault(spec.group, [])
        if spec.metric in available:
            groups[spec.group].append(spec.metric)
    return groups
