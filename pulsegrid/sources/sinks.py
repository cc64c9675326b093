"""Writers, and the slice-wise landing of collected rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.functions.statistics import finite_or_null
from pulsegrid.functions.timeparse import SLICE_MINUTES
from pulsegrid.operators.labels import has_usable_labels


def write_metrics(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def write_log_lines(lines: DataFrame, path: str, line: str = "value") -> None:
    lines.select(line).write.mode("overwrite").text(path)


def write_labels(labels: DataFrame, path: str, ts: str = "ts", label: str = "label") -> bool:
    """Labels as CSV (unix ms, label), one per instant; nothing is written if all are unlabelled."""
    if not has_usable_labels(labels.withColumnRenamed(label, "label")):
        return False
    millis = F.unix_millis(F.col(ts).cast("timestamp")).alias("_time")
    rows = labels.groupBy(millis).agg(F.max(label).alias("anomaly_label"))
    rows.write.mode("overwrite").option("header", True).csv(path)
    return True


def write_processed_logs(counts: DataFrame, per_interval: DataFrame, path: str) -> None:
    """Templates with their numbers, and template numbers per interval, as two JSON tables."""
    counts.write.mode("overwrite").json(f"{path}/templates")
    per_interval.write.mode("overwrite").json(f"{path}/intervals")


def finite_only(df: DataFrame) -> DataFrame:
    """Non-finite numbers as null."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: finite_or_null(F.col(c)) for c in floats}) if floats else df


def write_result(result: DataFrame, path: str) -> None:
    finite_only(result).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_summary(ledger: DataFrame, path: str) -> None:
    """Ledger as CSV, with params and metrics as JSON text."""
    flat = ledger.withColumns({"params": F.to_json("params"), "metrics": F.to_json("metrics")})
    flat.write.mode("overwrite").option("header", True).csv(path)


def append_ledger(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("experiment").parquet(path)


def write_bags(bags: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = bags.write.mode("overwrite")
    writer.option("header", True).option("sep", " ").csv(path) if fmt == "csv" else writer.parquet(path)


def with_slice(df: DataFrame, ts: str = "ts", minutes: int = SLICE_MINUTES) -> DataFrame:
    start = F.window(F.col(ts), f"{minutes} minutes")["start"]
    return df.withColumn("slice", F.date_format(start, "yyyyMMdd-HHmm"))


def land_slices(df: DataFrame, path: str, start: datetime, stop: datetime, ts: str = "ts", minutes: int = SLICE_MINUTES) -> None:
    """Land the rows of [start, stop) partitioned by time slice; a repeated slice replaces itself.

    Rows of one slice spread over several files, so that a busy slice has no single writer.
    """
    chosen = with_slice(df.where((F.col(ts) >= F.lit(start)) & (F.col(ts) < F.lit(stop))), ts, minutes)
    chosen.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slice").parquet(path)
