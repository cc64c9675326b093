"""Texts of Arrow batches as byte arrays: words, hashes and shingles without a Python step per word.

A batch is worked through in pieces of a few megabytes, so the memory of a task does not depend on how many rows a batch holds
(one text is never cut). Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

PIECE_BYTES = 1 << 20
BATCH_ROWS = 1_000
_ROWS_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FOLD = np.uint64(0xD6E8FEB86659FD93)

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _table(inside: Iterable[int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(inside)] = True
    return table


#: Bytes of words for shingles: ASCII letters and digits, and every byte of a character beyond ASCII.
WORD = _table([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])
#: Bytes of words for counting: all but blank, tab, line feed, vertical tab, form feed, carriage return.
NOT_BLANK = _table(set(range(256)) - {0x20, *range(0x09, 0x0E)})


@dataclass(frozen=True)
class Texts:
    """Rows ``first .. first + n`` of a batch: their bytes one after the other, and where each starts (n + 1 offsets)."""

    first: int
    data: np.ndarray
    starts: np.ndarray

    @property
    def n(self) -> int:
        return len(self.starts) - 1

    def raw(self, row: int) -> bytes:
        return self.data[self.starts[row] : self.starts[row + 1]].tobytes()


@dataclass(frozen=True)
class Words:
    row: np.ndarray
    begin: np.ndarray
    end: np.ndarray


def filled(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The texts as one large_string array without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[Texts]:
    """The texts in row order, in pieces of at most ``limit`` bytes or one text."""
    column = filled(column)
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        yield Texts(first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def runs(inside: np.ndarray, starts: np.ndarray) -> Words:
    """Maximal runs of true positions that do not cross from one text into the next."""
    n = len(inside)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return Words(none, none, none)
    cut = np.zeros(n + 1, dtype=bool)
    cut[starts] = True
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | cut[1:n]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | cut[1:n]
    begin = np.flatnonzero(opens)
    return Words(np.searchsorted(starts, begin, side="right") - 1, begin, np.flatnonzero(closes) + 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values, so that sums and bit fields of them are well spread."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(n, PIECE_BYTES + 1)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        up, down = np.full(size, base, np.uint64), np.full(size, inverse, np.uint64)
        up[0] = down[0] = 1
        have = np.multiply.accumulate(up), np.multiply.accumulate(down)
        _powers[int(base)] = have
    return have[0][:n], have[1][:n]


def span_hashes(values: np.ndarray, begin: np.ndarray, end: np.ndarray, base: np.uint64 = _BASE) -> np.ndarray:
    """A 64-bit hash of ``values[begin:end]`` for every span, from one running sum; equal spans have equal hashes wherever they are."""
    up, down = _power_tables(base, len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    lengths = (end - begin).astype(np.uint64)
    return mixed((total[end] - total[begin]) * down[begin] + mixed(lengths + base))


def row_hashes(words: Words, hashes: np.ndarray, n: int) -> np.ndarray:
    """128 bits for the word sequence of each of ``n`` rows, as two columns."""
    at = np.searchsorted(words.row, np.arange(n + 1))
    return np.stack([span_hashes(hashes, at[:-1], at[1:], b) for b in (_BASE, _FOLD)], axis=1)


def shingles(words: Words, hashes: np.ndarray, size: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every ``size``-word shingle in order; a text of fewer words, but one at least, is one shingle."""
    at = np.searchsorted(words.row, np.arange(n + 1))
    count = np.diff(at)
    n_shingles = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    row = np.repeat(np.arange(n), n_shingles)
    begin = np.repeat(at[:-1] - np.concatenate([[0], np.cumsum(n_shingles)[:-1]]), n_shingles) + np.arange(len(row))
    end = np.minimum(begin + size, at[1:][row])
    return row, span_hashes(hashes, begin, end)


def lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(filled(column))


def word_hashes(texts: Texts, table: np.ndarray = WORD) -> tuple[Words, np.ndarray]:
    found = runs(table[texts.data], texts.starts)
    return found, span_hashes(texts.data, found.begin, found.end)


def over_batches(df: DataFrame, step: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema) -> DataFrame:
    """``step`` for every Arrow batch that has rows: no shuffle, one pass, a batch at a time.

    Batches are kept to ``BATCH_ROWS`` rows by the session's setting, since a batch is held on both sides of the pipe to Python; what Arrow
    has freed goes back to the system, since workers live on from stage to stage.
    """
    conf = df.sparkSession.conf
    if int(conf.get(_ROWS_SETTING)) > BATCH_ROWS:
        conf.set(_ROWS_SETTING, BATCH_ROWS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from step(batch)
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(work, schema)


def per_batch(df: DataFrame, columns: list[str], schema: str, step: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]) -> DataFrame:
    """``step`` over the Arrow batches of some columns of ``df``."""
    return over_batches(df.select(*columns), step, schema)
