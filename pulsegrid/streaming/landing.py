"""Exactly-once tables behind ``foreachBatch``: what a micro-batch writes depends on its number alone.

Spark repeats a micro-batch, with the same number and the same rows, when a run ends between its writes and its commit. Every batch therefore
has a folder of its own that a repetition overwrites, and a line in a ledger that is written last: readers take the batches of the ledger only,
so a batch is seen whole or not at all.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pulsegrid.functions.timeparse import SLICE_MINUTES
from pulsegrid.sources.sinks import with_slice

BATCH = "batch"
LEDGER_SCHEMA = f"rows bigint, first_ts timestamp, last_ts timestamp, {BATCH} bigint"


def _start(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def slice_writer(path: str, ts: str = "ts", minutes: int = SLICE_MINUTES) -> Callable[[DataFrame, int], None]:
    """Writes a batch by time slice, and then its line of the ledger."""

    def write(rows: DataFrame, batch: int) -> None:
        target = f"{path}/rows/{BATCH}={batch}"
        # One file per slice, but for slices so large that Spark splits them.
        with_slice(rows, ts, minutes).hint("rebalance", "slice").write.mode("overwrite").partitionBy("slice").parquet(target)
        written = rows.sparkSession.read.schema(rows.schema).parquet(target)
        line = written.agg(F.count(F.lit(1)).alias("rows"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
        line.write.mode("overwrite").parquet(f"{path}/ledger/{BATCH}={batch}")

    return write


def land_slices_once(stream: DataFrame, path: str, checkpoint: str, ts: str = "ts", minutes: int = SLICE_MINUTES) -> StreamingQuery:
    """Land everything that has arrived by time slice and stop; a next call goes on from there."""
    return _start(stream, slice_writer(path, ts, minutes), checkpoint)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER_SCHEMA).parquet(f"{path}/ledger")


def landed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of all batches of the ledger, with their slice and batch."""
    full = T.StructType([*schema.fields, T.StructField(BATCH, T.LongType()), T.StructField("slice", T.StringType())])
    return spark.read.schema(full).parquet(f"{path}/rows").join(ledger(spark, path).select(BATCH), BATCH, "left_semi")


def status_writer(path: str, keys: Sequence[str], order: Sequence[str], alarm: str = "alarm") -> Callable[[DataFrame, int], None]:
    """Writes, for every key with an alarm in a batch, its latest alarm and the number of alarms."""

    def write(rows: DataFrame, batch: int) -> None:
        kept = F.struct(*[c for c in rows.columns if c not in keys])
        latest = rows.where(F.col(alarm) == 1).groupBy(*keys).agg(F.count(F.lit(1)).alias("alarms"), F.max_by(kept, F.struct(*order)).alias("latest"))
        latest.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch}")

    return write


def keep_status(scored: DataFrame, path: str, checkpoint: str, keys: Sequence[str], order: Sequence[str]) -> StreamingQuery:
    """The status of a monitor: what ``current_status`` reads. A batch writes only the keys that alarm in it."""
    return _start(scored, status_writer(path, keys, order), checkpoint)


def current_status(spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str], schema: T.StructType) -> DataFrame:
    """Latest alarm and number of alarms per key; ``schema`` is that of the scored stream."""
    inner = T.StructType([f for f in schema.fields if f.name not in keys])
    fields = [schema[k] for k in keys] + [T.StructField("alarms", T.LongType()), T.StructField("latest", inner), T.StructField(BATCH, T.LongType())]
    written = spark.read.schema(T.StructType(fields)).parquet(path)
    newest = written.groupBy(*keys).agg(F.sum("alarms").alias("alarms"), F.max_by("latest", F.struct(*[F.col(f"latest.{c}") for c in order])).alias("latest"))
    return newest.select(*keys, "alarms", "latest.*")
