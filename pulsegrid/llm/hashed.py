"""Hashed n-grams of words, and the bounded sample of labelled rows that the classifiers are fitted on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.pretokens import expand
from pulsegrid.llm.textbatch import Words

BITS = 17
ORDERS = (3, 4, 5)
MARK = 1

#: Bounds of a fit: labelled rows of either label, and bytes of a text that is used to fit (longer ones are scored, not fitted on).
FIT_ROWS = 1_500
FIT_BYTES = 1 << 16


def bucket(hashes: np.ndarray, bits: int = BITS) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of UTF-8 bytes, and for every byte the number of the character that it is part of."""
    first = (data & 0xC0) != 0x80
    at = np.flatnonzero(first)
    lead = data[at].astype(np.uint32)
    length = 1 + (lead >= 0xC0).astype(np.int64) + (lead >= 0xE0) + (lead >= 0xF0)
    value = lead & np.array([0, 0x7F, 0x1F, 0x0F, 0x07], dtype=np.uint32)[length]
    for k in range(1, 4):
        longer = np.flatnonzero(length > k)
        value[longer] = value[longer] << np.uint32(6) | data[at[longer] + k] & np.uint32(0x3F)
    return value, np.cumsum(first) - 1


def character_grams(data: np.ndarray, words: Words, orders: tuple[int, ...] = ORDERS, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: (position of the word in ``words``, bucket) of its n-grams of characters, with a mark before and after the word."""
    points, number = code_points(data)
    begin, last = (number[x] if len(x) else x for x in (words.begin, words.end - 1))
    lengths = last + 1 - begin
    at = np.cumsum(lengths + 1) - lengths  # the word's place in a copy with one mark between words
    padded = np.full(int(lengths.sum()) + len(lengths) + 1, MARK, dtype=np.uint32)
    padded[expand(at, lengths)] = points[expand(begin, lengths)]
    for order in orders:
        hashes = np.zeros(max(0, len(padded) - order + 1), dtype=np.uint32)
        for k in range(order):
            hashes = (hashes * np.uint32(0x01000193)) ^ padded[k : k + len(hashes)]
        hashes = (hashes ^ (hashes >> np.uint32(15))) * np.uint32(0x9E3779B1 + 2 * order)
        count = np.maximum(lengths + 3 - order, 0)
        yield np.repeat(np.arange(len(lengths)), count), (hashes >> np.uint32(32 - bits))[expand(at - 1, count)].astype(np.int64)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column | None = None, rows: int = FIT_ROWS) -> list[tuple[str, int]]:
    """At most ``rows`` (text, label) pairs of each label, chosen by a hash of the id: the only rows that reach the driver.

    Rows without an id, a label of 0 or 1, or a text are not used; an id with several labels or texts counts with the lowest one.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).alias("_label"))
    if usable is not None:
        known = known.where(usable)
    texts = docs.where(F.col("text").isNotNull() & (F.octet_length("text") <= FIT_BYTES)).select("doc_id")
    found = known.join(texts, "doc_id", "left_semi")
    chosen = [found.where(F.col("_label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for k in (0, 1)]
    chosen = chosen[0].unionByName(chosen[1])
    ids = docs.sparkSession.createDataFrame(chosen.collect(), chosen.schema)
    pairs = docs.select("doc_id", "text").where(F.octet_length("text") <= FIT_BYTES).join(F.broadcast(ids), "doc_id")
    one = pairs.groupBy("doc_id", "_label").agg(F.min("text").alias("text"))
    return [(row["text"], row["_label"]) for row in one.orderBy("doc_id").toLocalIterator()]


class Adam:
    """Gradient steps with running first and second moments."""

    def __init__(self, rate: float):
        self.rate, self.n, self.state = rate, 0, {}

    def step(self, **updates: tuple[np.ndarray, np.ndarray]) -> None:
        self.n += 1
        for name, (value, gradient) in updates.items():
            m, v = self.state.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
            m += 0.1 * (gradient - m)
            v += 0.01 * (gradient * gradient - v)
            value -= self.rate * (m / (1 - 0.9**self.n)) / (np.sqrt(v / (1 - 0.99**self.n)) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
