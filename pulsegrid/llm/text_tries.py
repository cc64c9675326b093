"""Equal texts by compressed tries over ranges of texts.

Texts are dealt to ranges by adaptive prefixes: a hash sample of the texts is sorted, and the shortest prefix that tells a chosen text from the
one before it in the sample becomes a boundary, so boundaries are short where texts differ early and long under a passage that many texts
begin with. A range's task inserts every whole text into one compressed trie, whose terminals hold the least id of their text, and then walks
it. Equal texts meet in one range, so every task first keeps, of equal texts that it reads, those alone whose id is less than any before
them; the others are settled on the spot and travel without their text.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.storage import durable

#: Bytes of text that a range should hold, and sampled texts per range. Neither changes a result.
RANGE_BYTES = 32 << 20
SAMPLED = 8
#: First bytes of a sampled text that the driver sees at once; four times as many in every further round, for those that share them.
FIRST_BYTES = 64
BATCH = 4_096


class Node:
    """An edge's text, as ``text[start:end]`` of some inserted text, what stands below it, and the rows that end here."""

    __slots__ = ("text", "start", "end", "below", "least", "rows")

    def __init__(self, text: bytes, start: int, end: int):
        self.text, self.start, self.end = text, start, end
        self.below: dict[int, Node] = {}
        self.least = None
        self.rows: list[tuple] | None = None


def common(a: bytes, b: bytes) -> int:
    """Length of the common beginning, by comparing slices."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    step = 16
    while a[low : low + step] == b[low : low + step]:
        low, step = low + step, 2 * step
    high = min(high, low + step)
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Trie:
    def __init__(self):
        self.root = Node(b"", 0, 0)

    def insert(self, text: bytes, key, row: tuple) -> None:
        """Adds a row of ``text``; ``key`` (None: it counts as no id) may become the least of the text's terminal."""
        node, at = self.root, 0
        while at < len(text):
            below = node.below.get(text[at])
            if below is None:
                below = node.below[text[at]] = Node(text, at, len(text))
                node, at = below, len(text)
                break
            size = below.end - below.start
            same = common(text[at : at + size], below.text[below.start : below.end])
            if same < size:
                middle = Node(below.text, below.start, below.start + same)
                below.start += same
                middle.below[below.text[below.start]] = below
                node.below[text[at]] = below = middle
            node, at = below, at + same
        if node.rows is None:
            node.rows = []
        node.rows.append((key, row))
        if key is not None and (node.least is None or key < node.least):
            node.least = key

    def walk(self) -> Iterator[tuple[tuple, bool]]:
        """Every row, and whether a lesser id has its text."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            for key, row in node.rows or ():
                yield row, key is not None and node.least < key
            stack.extend(node.below.values())


def boundaries(texts: DataFrame, ranges: int) -> list[bytes]:
    """At most ``ranges - 1`` prefixes, ascending, that cut the texts (column ``text``, no nulls) into ranges of about equal bytes.

    ``texts`` is the sample. The driver holds a few bytes of each: as many as tell it from the others.
    """
    length, held = FIRST_BYTES, {}
    raw = F.col("text").cast("binary")
    open_ = texts.withColumn("_h", F.xxhash64("text")).groupBy("_h").agg(F.min(F.struct(F.octet_length("text").alias("n"), "text")).alias("s")).select("_h", "s.*")
    while True:
        for r in open_.select("_h", "n", F.substring(raw, 1, length).alias("p")).toLocalIterator():
            held[r["_h"]] = (bytes(r["p"]), r["n"])
        heads = {}
        for h, (p, n) in held.items():
            if len(p) == length and n > length:
                heads.setdefault(p, []).append(h)
        shared = [h for same in heads.values() if len(same) > 1 for h in same]
        if not shared:
            break
        length *= 4
        open_ = open_.where(F.col("_h").isin(shared))
    ordered = sorted(held.values())
    weight = sum(n for _, n in ordered) / ranges or 1
    cuts, filled = [], 0
    for (before, n), (p, _) in zip(ordered, ordered[1:]):
        filled += n
        if filled >= weight * (len(cuts) + 1) and p != before:
            cuts.append(p[: common(before, p) + 1])
    return cuts


def sample_of(rows: DataFrame, n_rows: int, wanted: int) -> DataFrame:
    """About ``wanted`` of the texts, by their hash: all copies of a text or none."""
    share = min(1.0, wanted / max(n_rows, 1))
    return rows.select("text").where(F.pmod(F.xxhash64("text", F.lit(7)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)


def repeated(rows: DataFrame, id_column: str, payload: Sequence[str]) -> DataFrame:
    """The payload of every row and ``repeated``: whether a row with a lesser id has the same text.

    ``rows`` has the id, ``text`` (no nulls) and the payload. A null id is neither less nor greater than another.
    """
    n_rows, n_bytes = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    ranges = max(1, -(-(n_bytes or 0) // RANGE_BYTES))
    cuts = boundaries(durable(sample_of(rows, n_rows, SAMPLED * ranges), "sample"), ranges) if ranges > 1 else []
    kept = list(dict.fromkeys([id_column, *payload]))
    fields = [f for f in rows.schema.fields if f.name in kept]
    names = [f.name for f in fields]
    flags = T.StructType([*fields, T.StructField("repeated", T.BooleanType())])
    dealt = T.StructType([*flags.fields, T.StructField("text", T.StringType()), T.StructField("_range", T.IntegerType())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[bytes, object] = {}
        for batch in batches:
            keys, texts = batch.column(id_column).to_pylist(), batch.column("text").to_pylist()
            raw = [t.encode() for t in texts]
            marks = [hashlib.blake2b(t, digest_size=16).digest() for t in raw]
            for key, mark in zip(keys, marks):
                if key is not None and (mark not in least or key < least[mark]):
                    least[mark] = key
            settled, to = [], []
            for i, (key, mark) in enumerate(zip(keys, marks)):
                done = key is not None and least[mark] < key
                settled.append(True if done else None)
                # A settled row goes anywhere: its text's range may be full of its copies.
                to.append(i % ranges if done else bisect_right(cuts, raw[i]))
            texts = [None if s else t for s, t in zip(settled, texts)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array(settled, pa.bool_()), pa.array(texts, pa.string()), pa.array(to, pa.int32())],
                names=dealt.names,
            )

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, schema = Trie(), None
        for batch in batches:
            schema = batch.select(names).schema
            texts, columns = batch.column("text"), [batch.column(n).to_pylist() for n in names]
            keys, done = batch.column(id_column).to_pylist(), []
            for i, row in enumerate(zip(*columns)):
                if texts[i].is_valid:
                    trie.insert(texts[i].as_py().encode(), keys[i], row)
                else:
                    done.append((row, True))
            if done:
                yield out(done, schema)
        held = []
        for found in trie.walk():
            held.append(found)
            if len(held) == BATCH:
                yield out(held, schema)
                held = []
        if held:
            yield out(held, schema)

    def out(found: list[tuple[tuple, bool]], schema: pa.Schema) -> pa.RecordBatch:
        columns = [pa.array([row[i] for row, _ in found], schema.field(n).type) for i, n in enumerate(names)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([flag for _, flag in found], pa.bool_())], names=flags.names)

    parts = rows.select(*names, "text").mapInArrow(deal, dealt)
    return parts.repartitionById(ranges, "_range").mapInArrow(settle, flags)
