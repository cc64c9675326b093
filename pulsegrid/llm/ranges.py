"""Ranks and running sums per key over range-partitioned runs, so that no key, however many rows it has, goes through one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators.ordered import attach
from pulsegrid.storage import durable

RUN, AT = "_run", "_at"


def sorted_runs(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """``df`` cut into runs along ``order``, written once: rows of a run are numbered in order (column ``_at``), and runs (``_run``) follow one another.

    The number of runs is the session's number of shuffle partitions. ``order`` should tell all rows apart; rows that it does not tell apart
    stay in one run.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return durable(ranged.withColumns({RUN: F.spark_partition_id(), AT: F.monotonically_increasing_id()}), "runs")


def ranked(df: DataFrame, key: str, order: Sequence[Column | str]) -> DataFrame:
    """``df`` with ``lo``, the 0-based rank of the row within ``key`` (never null) by ``order``, and ``n``, the rows of its key.

    One shuffle of the rows. What earlier runs hold of a key comes from a table with one row per key and run.
    """
    runs = sorted_runs(df, [key, *order])
    per = runs.groupBy(key, RUN).agg(F.min(AT).alias("_first"), F.count(F.lit(1)).alias("_c"))
    earlier = Window.partitionBy(key).orderBy(RUN).rowsBetween(Window.unboundedPreceding, -1)
    offsets = durable(per.select(key, RUN, F.col("_first"), F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_before"), F.sum("_c").over(Window.partitionBy(key)).alias("n")), "offsets")
    placed = attach(runs, offsets, [key, RUN], ["_first", "_before", "n"])
    return placed.withColumn("lo", F.col(AT) - F.col("_first") + F.col("_before")).drop(RUN, AT, "_first", "_before")


def summed_before(df: DataFrame, key: str, order: Sequence[Column | str], value: str, out: str) -> DataFrame:
    """``df`` with ``out``, the sum of ``value`` over the rows of its key that stand before it in ``order``."""
    runs = sorted_runs(df, [key, *order])
    per = runs.groupBy(key, RUN).agg(F.sum(value).alias("_s"))
    earlier = Window.partitionBy(key).orderBy(RUN).rowsBetween(Window.unboundedPreceding, -1)
    offsets = durable(per.select(key, RUN, F.sum("_s").over(earlier).alias("_before")), "offsets")
    inside = Window.partitionBy(key, RUN).orderBy(AT).rowsBetween(Window.unboundedPreceding, -1)
    local = runs.withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return attach(local, offsets, [key, RUN], ["_before"]).withColumn(out, F.col(out) + F.coalesce("_before", F.lit(0))).drop(RUN, AT, "_before")
