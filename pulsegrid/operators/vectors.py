"""Arrays of fixed length as matrices: one product per Arrow batch instead of a step per cell.

The array column must not be null, and its arrays must be of one length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEED = 32


def matrix_of(column: pa.Array) -> np.ndarray:
    """Rows of a list column as a matrix of doubles."""
    if column.null_count:
        raise ValueError("null among the arrays")
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return values.reshape(len(column), -1)


def _as_arrow(values: np.ndarray, kind: T.DataType) -> pa.Array:
    if isinstance(kind, T.ArrayType):
        n, width = values.shape
        return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width, dtype=np.int32)), pa.array(values.ravel()))
    return pa.array(values)


def with_matrix(df: DataFrame, array: str, added: str, step: Callable[[np.ndarray], tuple[np.ndarray, ...]]) -> DataFrame:
    """``df`` with the columns of the schema ``added``, which ``step`` makes of the matrix of a batch."""
    extra = T.StructType.fromDDL(added)
    schema = T.StructType([*df.schema.fields, *extra.fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = step(matrix_of(batch.column(array)))
                made = [_as_arrow(v, f.dataType) for v, f in zip(found, extra.fields)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=schema.names)

    return df.mapInArrow(work, schema)


def matrix_sums(df: DataFrame, array: str, group: str, size: int, step: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of the ``size`` numbers that ``step(group values, matrix)`` gives for a batch.

    Every task adds up its batches; Spark adds up the tasks, and the driver gets ``size`` numbers, whatever the rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += step(batch.column(group).to_numpy(zero_copy_only=False), matrix_of(batch.column(array)))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["at", "value"])

    parts = df.select(group, array).mapInArrow(work, "at int, value double")
    out = np.zeros(size)
    for row in parts.groupBy("at").agg(F.sum("value").alias("value")).collect():
        out[row["at"]] = row["value"]
    return out


class Fourier:
    """Random Fourier features: inner products of them approach the radial kernel exp(-gamma |x - y|^2)."""

    def __init__(self, width: int, features: int, gamma: float | None = None, seed: int = SEED):
        rng = np.random.default_rng(seed)
        gamma = 1.0 / width if gamma is None else gamma
        self.turn = rng.normal(size=(width, features)) * np.sqrt(2 * gamma)
        self.shift = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(2 / len(self.shift)) * np.cos(x @ self.turn + self.shift)


def fourier_features(df: DataFrame, array: str, width: int, features: int, gamma: float | None = None, seed: int = SEED, out: str = "lifted") -> DataFrame:
    lift = Fourier(width, features, gamma, seed)
    return with_matrix(df, array, f"{out} array<double>", lambda x: (lift(x),))
