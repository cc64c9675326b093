"""Benchmark decontamination: short test items found inside long documents by size-partitioned MinHash, then exact containment.

Items are partitioned by their number of five-word shingles into classes that end at powers of two. For a class that ends at ``u``, a
document's shingles are cut into blocks of ``u``, and every two adjacent blocks are a window: a passage of an item's length lies whole in one
window, however long the document is, and its share of the window is never small. Items and windows get one-permutation MinHash registers
(the least hash per range of the hash space). A document is a candidate for an item if a register of one of its windows agrees; with a share of a
quarter and 64 registers, all of them disagree with a probability of about 1e-8. Items of up to eight shingles take all their shingles as
registers, against all of the document's. Candidates are verified: an item is contained if the document has at least 0.8 of its distinct
shingles, anywhere.

The items are the stated query set. They are measured first and worked through in blocks of a bounded size, each of which is broadcast, so
that the documents are never shuffled. A window's register can only agree if its shingle is a register of an item, so documents without such
a shingle are passed over at once.

Words are as in the near-duplicate operator. Null, empty and wordless items are contained in nothing; an item of fewer than five words is one
shingle, which only a document of just these words has. Repeated documents and items give repeated pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pulsegrid.llm.textbatch import lowered, over_batches, per_batch, pieces, shingles, word_hashes

SHINGLE = 5
CONTAINED = 0.8
REGISTER_BITS = 6
ALL_UP_TO = 8
#: Bytes of item texts in one block.
BLOCK_BYTES = 16 << 20
SCREEN_BITS = 20
_NONE = np.uint64(2**64 - 1)


@dataclass(frozen=True)
class Items:
    """A block of items: distinct shingles of each, and per size class the register values with their items; all register values, and a table that rules most others out."""

    ids: list
    shingles: list[np.ndarray]
    classes: dict[int, tuple[np.ndarray, np.ndarray]]
    values: np.ndarray
    screen: np.ndarray

    def known(self, shingle: np.ndarray) -> np.ndarray:
        """Positions of the shingles that are a register of some item."""
        at = np.flatnonzero(self.screen[_screen_at(shingle)])
        place = np.searchsorted(self.values, shingle[at])
        return at[self.values[np.minimum(place, len(self.values) - 1)] == shingle[at]] if len(self.values) else at[:0]


def _registers(values: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """The least value per group and range of the hash space."""
    least = np.full(groups << REGISTER_BITS, _NONE, dtype=np.uint64)
    np.minimum.at(least, (group << REGISTER_BITS) + (values >> np.uint64(64 - REGISTER_BITS)).astype(np.int64), values)
    return least.reshape(groups, 1 << REGISTER_BITS)


def _screen_at(values: np.ndarray) -> np.ndarray:
    return (values & np.uint64((1 << SCREEN_BITS) - 1)).astype(np.int64)


def _read_items(rows: list[tuple[object, str]]) -> Items:
    ids, sets = [], []
    for texts in pieces(lowered(pa.array([t for _, t in rows], pa.large_string()))):
        words, hashes = word_hashes(texts)
        row, shingle = shingles(words, hashes, SHINGLE, texts.n)
        cuts = np.searchsorted(row, np.arange(texts.n + 1))
        for i in range(texts.n):
            if cuts[i + 1] > cuts[i]:
                ids.append(rows[texts.first + i][0])
                sets.append(np.unique(shingle[cuts[i] : cuts[i + 1]]))
    parts: dict[int, list[tuple[np.ndarray, int]]] = {}
    for number, own in enumerate(sets):
        if len(own) <= ALL_UP_TO:
            parts.setdefault(0, []).append((own, number))
        else:
            least = _registers(own, np.zeros(len(own), dtype=np.int64), 1)[0]
            parts.setdefault(1 << int(len(own) - 1).bit_length(), []).append((least[least != _NONE], number))
    classes, screen = {}, np.zeros(1 << SCREEN_BITS, dtype=bool)
    for size, found in parts.items():
        values = np.concatenate([v for v, _ in found])
        numbers = np.repeat([n for _, n in found], [len(v) for v, _ in found])
        order = np.argsort(values, kind="stable")
        classes[size] = (values[order], numbers[order])
        screen[_screen_at(values)] = True
    every = np.unique(np.concatenate([v for v, _ in classes.values()])) if classes else np.zeros(0, np.uint64)
    return Items(ids, sets, classes, every, screen)


def _windows(shingle: np.ndarray, size: int) -> np.ndarray:
    """The register values of a document's windows of two blocks of ``size`` shingles."""
    if size == 0:
        return shingle
    block = np.arange(len(shingle)) // size
    least = _registers(shingle, block, int(block[-1]) + 1)
    return np.minimum(least[:-1], least[1:]).reshape(-1) if len(least) > 1 else least.reshape(-1)


def _candidates(items: Items, shingle: np.ndarray) -> set[int]:
    found: set[int] = set()
    for size, (values, numbers) in items.classes.items():
        own = _windows(shingle, size)
        own = np.unique(own[items.known(own)])
        low, high = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
        for a, b in zip(low[high > low].tolist(), high[high > low].tolist()):
            found.update(numbers[a:b].tolist())
    return found


def contained_in(items: Items, shingle: np.ndarray) -> list[tuple[object, int, int]]:
    """(item, its distinct shingles, those that the document has) of every item that the document contains."""
    candidates = sorted(_candidates(items, shingle))
    own = np.unique(shingle) if candidates else shingle
    found = []
    for number in candidates:
        wanted = items.shingles[number]
        at = np.searchsorted(own, wanted)
        have = int((own[np.minimum(at, len(own) - 1)] == wanted).sum())
        if have >= CONTAINED * len(wanted):
            found.append((items.ids[number], len(wanted), have))
    return found


def _blocks(benchmark: DataFrame):
    """The items in blocks of bounded size, one after the other."""
    texts = benchmark.where(F.col("text").isNotNull()).select("item_id", "text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    for k in range(blocks):
        part = texts if blocks == 1 else texts.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k)
        yield [(row["item_id"], row["text"]) for row in part.collect()]


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, n_shingles, n_shared, containment`` of every item that a document contains."""
    types = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}"
    names = ["doc_id", "item_id", "n_shingles", "n_shared"]
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)

    def of_block(rows: list) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(_read_items(rows))

        def step(batch: pa.RecordBatch):
            items = shared.value
            for texts in pieces(lowered(batch.column(1))):
                words, hashes = word_hashes(texts)
                row, shingle = shingles(words, hashes, SHINGLE, texts.n)
                at = np.searchsorted(row, np.arange(texts.n + 1))
                hit = np.unique(row[items.known(shingle)])
                found = [(texts.first + i, *x) for i in hit.tolist() for x in contained_in(items, shingle[at[i] : at[i + 1]])]
                if found:
                    rows_at, ids, n, have = map(list, zip(*found))
                    columns = [batch.column(0).take(pa.array(rows_at)), pa.array(ids, item_type), pa.array(n, pa.int64()), pa.array(have, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

        return per_batch(docs, ["doc_id", "text"], f"{types}, n_shingles bigint, n_shared bigint", step)

    found = None
    for rows in _blocks(benchmark):
        part = of_block(rows)
        found = part if found is None else found.unionByName(part)
    return found.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that contain no item, all columns as they are."""
    at_text = docs.columns.index("text")

    def of_block(docs: DataFrame, rows: list) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(_read_items(rows))

        def step(batch: pa.RecordBatch):
            items, clean = shared.value, np.ones(batch.num_rows, dtype=bool)
            for texts in pieces(lowered(batch.column(at_text))):
                words, hashes = word_hashes(texts)
                row, shingle = shingles(words, hashes, SHINGLE, texts.n)
                at = np.searchsorted(row, np.arange(texts.n + 1))
                for i in np.unique(row[items.known(shingle)]).tolist():
                    clean[texts.first + i] = not contained_in(items, shingle[at[i] : at[i + 1]])
            yield batch.filter(pa.array(clean))

        return over_batches(docs, step, docs.schema)

    for rows in _blocks(benchmark):
        docs = of_block(docs, rows)
    return docs
