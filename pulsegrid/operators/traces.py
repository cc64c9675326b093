"""System-call traces as bags of calls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.ordered import attach, positions

CALLS_PER_CHUNK = 50


def extend_dictionary(
    trace: DataFrame, dictionary: DataFrame, order: Sequence[str], call: str = "system_call", group_rows: int | None = None
) -> DataFrame:
    """Dictionary (id, call) plus the calls it lacks, numbered on from its largest id as first seen."""
    known = dictionary.select(F.col("id").cast("long").alias("id"), call)
    unseen = (
        trace.select(call, *order)
        .where(F.col(call).isNotNull())
        .groupBy(call)
        .agg(F.min(F.struct(*order)).alias("_first"))
        .join(known, call, "left_anti")
    )
    largest = known.select(F.coalesce(F.max("id"), F.lit(0))).scalar()
    added = positions(unseen, [], ["_first", call], "_n", group_rows)
    return known.unionByName(added.select((largest + F.col("_n") + 1).alias("id"), call))


def encode_calls(trace: DataFrame, dictionary: DataFrame, call: str = "system_call") -> DataFrame:
    return attach(trace, dictionary, [call], ["id"]).withColumnRenamed("id", "encoding")


def attack_label(ts: Column, start, end) -> Column:
    """1 inside the attack interval, ends included."""
    return ts.between(F.lit(start), F.lit(end)).cast("int")


def chunked(trace: DataFrame, order: Sequence[str], size: int = CALLS_PER_CHUNK, group_rows: int | None = None) -> DataFrame:
    """Number of the fixed-size chunk each row falls in; the last chunk may be short."""
    placed = positions(trace, [], list(order), "_p", group_rows)
    return placed.withColumn("chunk", F.floor(F.col("_p") / size)).drop("_p")


def call_bags(chunks: DataFrame, ids: Sequence[int], label: str = "label") -> DataFrame:
    """One row per chunk: a count column per dictionary id, and 1 if any row is an attack."""
    counts = [F.count_if(F.col("encoding") == i).alias(f"call_{i}") for i in ids]
    return chunks.groupBy("chunk").agg(*counts, F.max(label).alias(label))


def call_bags_long(chunks: DataFrame) -> DataFrame:
    """The same counts as (chunk, encoding, n), for dictionaries too wide for columns."""
    return chunks.groupBy("chunk", "encoding").agg(F.count(F.lit(1)).alias("n"))
