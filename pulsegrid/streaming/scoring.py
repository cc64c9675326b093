"""Continuous scoring and slice-wise collection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.operators.metrics import apply_scaler
from pulsegrid.operators.threshold import classify
from pulsegrid.sources.sinks import with_slice

MIN_INTERVAL_SECONDS, MAX_INTERVAL_SECONDS = 5, 3600


def read_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)


def score_stream(stream: DataFrame, stats: DataFrame, thresholds: DataFrame, keys: Sequence[str] = ("metric",), value: str = "value") -> DataFrame:
    """Distance from the trained mean in deviations, and whether it lies beyond the fitted threshold.

    ``stats`` and ``thresholds`` are written tables with one row per key.
    """
    scaled = apply_scaler(stream, stats, keys, value, "z").withColumn("score", F.abs("z"))
    return classify(scaled, thresholds, keys)


def start_monitor(scored: DataFrame, alarms_path: str, checkpoint: str, interval_seconds: int = 60, once: bool = False):
    """Write the alarms of a scored stream every interval; ``once`` handles what is there and stops.

    The alarms table is the status of the monitor: its latest rows are the current alarms.
    """
    if not MIN_INTERVAL_SECONDS <= interval_seconds <= MAX_INTERVAL_SECONDS:
        raise ValueError(f"interval must be {MIN_INTERVAL_SECONDS} to {MAX_INTERVAL_SECONDS} seconds")
    writer = (
        scored.where(F.col("alarm") == 1).withColumn("scored_at", F.current_timestamp())
        .writeStream.format("parquet").option("path", alarms_path).option("checkpointLocation", checkpoint).outputMode("append")
    )
    trigger = {"availableNow": True} if once else {"processingTime": f"{interval_seconds} seconds"}
    return writer.trigger(**trigger).start()


def latest_alarms(spark: SparkSession, alarms_path: str, k: int = 20, ts: str = "ts") -> DataFrame:
    return spark.read.parquet(alarms_path).orderBy(F.col(ts).desc()).limit(k)


def collect_slices(stream: DataFrame, path: str, checkpoint: str, ts: str = "ts"):
    """Land everything that has arrived by time slice and stop; a next call goes on from there.

    A slice that fails is retried by Spark, and the checkpoint keeps rows from landing twice.
    """
    return (
        with_slice(stream, ts).writeStream.format("parquet").partitionBy("slice").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
