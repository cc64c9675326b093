"""Sliding windows over ordered rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.labels import ANOMALOUS, NORMAL, UNLABELLED
from pulsegrid.operators.ordered import OrderKey, positions, row_frames


def sliding_windows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[OrderKey],
    columns: dict[str, tuple[str, Column]],
    size: int,
    stride: int = 1,
    group_rows: int | None = None,
) -> DataFrame:
    """One row per full window of ``size`` rows, every ``stride`` rows, as ``win_id`` 0, 1, ...

    ``columns`` maps an output name to (aggregate, input), where the aggregate is one of ``list``,
    ``first``, ``last``, ``max``, ``min``, ``avg``, ``sum``. A key with fewer rows than ``size``
    has no window.
    """
    placed = positions(df, keys, order, "_p", group_rows)
    aggregates = {
        "list": F.collect_list, "first": F.first, "last": F.last, "max": F.max, "min": F.min, "avg": F.avg, "sum": F.sum,
    }

    def frame(rows, w):
        ahead = w.rowsBetween(0, size - 1)
        named = {n: aggregates[how](c).over(ahead) for n, (how, c) in columns.items()}
        return rows.withColumn("_rows", F.count(F.lit(1)).over(ahead)).withColumns(named)

    framed = row_frames(placed, keys, ["_p"], 0, size - 1, frame, group_rows)
    return framed.where((F.col("_rows") == size) & (F.col("_p") % stride == 0)).select(
        *keys, F.floor(F.col("_p") / stride).alias("win_id"), *columns
    )


def window_label(lowest: Column, highest: Column) -> Column:
    """Label of a window from the smallest and largest label in it: 1 if any 1, else -1 if any -1, else 0."""
    return F.when(highest == ANOMALOUS, ANOMALOUS).when(lowest == UNLABELLED, UNLABELLED).otherwise(NORMAL)


def pad_list(values: Column, length: int) -> Column:
    """``values`` cut or filled with 0 to ``length``."""
    return F.slice(F.concat(values, F.array_repeat(F.lit(0), length)), 1, length)
