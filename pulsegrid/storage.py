"""Durable cuts of lineage: tables in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; a temporary one only in local mode."""
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to storage that every executor can reach")
    folder = tempfile.mkdtemp(prefix="pulsegrid-")
    spark.conf.set(CHECKPOINT_DIR, folder)
    return folder


def new_table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` once and read it back, so that every later use sees the same rows.

    A written table survives lost executors, and its readers still prune columns.
    """
    spark = df.sparkSession
    path = new_table_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a table that one task of a repeated pass reads at least.
PASS_ROWS = 1_000


def dealt(df: DataFrame, ids: Sequence[str], rows: int, most: int | None = None) -> DataFrame:
    """``df`` dealt evenly by ``ids`` before it is written for a computation that passes over it many times.

    A table that comes out of a window or a small shuffle is often one file, and every pass over that is one task. There is a part for every
    ``PASS_ROWS`` rows, up to one per core (or ``most``); rows of a part are in order of ``ids``. A table of one part stays as it is.
    """
    parts = min(-(-rows // PASS_ROWS), most or df.sparkSession.sparkContext.defaultParallelism)
    return df if parts <= 1 else df.repartition(parts, *ids).sortWithinPartitions(*ids)


def fits(df: DataFrame, rows: int) -> bool:
    """True when ``df`` has at most ``rows`` rows; reads no more than it must to know."""
    return df.limit(rows + 1).count() <= rows
