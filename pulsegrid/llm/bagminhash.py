"""Near-duplicates by weighted Jaccard similarity of bags of five-word shingles.

Words are lower-cased runs of ASCII letters, ASCII digits and characters beyond ASCII; a text of fewer than five words is one shingle. The
similarity of two texts is the sum of the lesser counts of their shingles over the sum of the greater ones; 0.8 or more is a link, and
classes are what links connect.

**Signatures.** Weights are discretised in dyadic blocks, [0,1), [1,2), [2,4), [4,8) and so on. On each block of each shingle runs a Poisson
process whose rate is the block's size: its points have a time, a register and a place in the block, all from a hash of shingle, block and
number of the point. A text owns the points that lie below its count, and a register keeps the earliest time. Registers of two texts then
agree with a probability of exactly their weighted Jaccard similarity. Points are made in order of time, for all shingles of a piece of
texts at once, and a shingle is done when its next point is later than the latest register of its text; for counts of 1 that is one or two
points per shingle.

**Candidates.** Texts with the same words in order are one node from the start. Registers are taken in bands of four; nodes that agree on a
band share a bucket. In each bucket all others are compared with one pivot, the node whose buckets are largest. What that leaves
unconnected is compared between classes (not within them), apart from pairs that two bounds rule out. One minus this similarity is a
metric, so two texts whose distances to the pivot differ by more than 0.2 are no link. And what a bag has of shingles that no other class has
cannot overlap outside of its class; the rest is counted in cells of the hash space, and the sum of the lesser counts bounds the overlap. A
copy that was edited too much to be near the pivot is nearly always out by that bound, for its edits are its own. Copies are not expanded into all pairs, and a bucket loses no link. A link of similarity 0.8
shares no bucket with a probability of 4e-6.

**Verification** is exact on the bags, up to collisions of 64-bit shingle hashes. Null, empty and wordless texts are one class, by equal words.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.components import components
from pulsegrid.llm.textbatch import Texts, lowered, mixed, per_batch, pieces, row_hashes, shingles, span_hashes, word_hashes
from pulsegrid.storage import durable, new_table_path

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 24, 4
REGISTERS = BANDS * ROWS
#: Cells of the counts that bound an overlap.
CELLS = 128
#: Pairs of one node that go to one task.
PARTNERS = 256
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _times(number: int) -> np.uint64:
    return np.uint64(number * int(_STEP) & (1 << 64) - 1)


def bags(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(128-bit keys of the word sequences, then row, shingle and count of each distinct shingle of each row)."""
    words, hashes = word_hashes(texts)
    row, shingle = shingles(words, hashes, SHINGLE, texts.n)
    own = mixed(shingle ^ (row.astype(np.uint64) * _STEP))  # the same shingle in another row is another value
    _, first, count = np.unique(own, return_index=True, return_counts=True)
    return row_hashes(words, hashes, texts.n), row[first], shingle[first], count


def _blocks(row: np.ndarray, shingle: np.ndarray, count: np.ndarray):
    """(row, seed, block size, share of the block below the count) of every block that a count reaches."""
    parts, block, size, below = [], 0, 1, 0
    while True:
        reach = np.flatnonzero(count > below)
        if not len(reach):
            return [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, t) for t in (np.int64, np.uint64, float, float)]
        share = np.minimum((count[reach] - below) / size, 1.0)
        parts.append((row[reach], mixed(shingle[reach] + _times(block)), np.full(len(reach), float(size)), share))
        below += size
        size, block = max(1, below), block + 1


def _uniform(bits: np.ndarray) -> np.ndarray:
    return ((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def registers(n: int, row: np.ndarray, shingle: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The earliest time per row and register; infinite for rows without a shingle."""
    first = np.full(n * REGISTERS, np.inf)
    row, seed, size, share = _blocks(row, shingle, count)
    time, number = np.zeros(len(row)), 0
    latest = np.full(n, np.inf)
    while len(row):
        number += 1
        bits = mixed(seed + _times(number))
        time = time - np.log(_uniform(bits)) / size
        going = time < latest[row]
        row, seed, size, share, time, bits = (x[going] for x in (row, seed, size, share, time, bits))
        place = mixed(bits ^ _STEP)
        inside = (share >= 1.0) | (_uniform(place) < share)
        register = (mixed(bits + _STEP) % np.uint64(REGISTERS)).astype(np.int64)
        np.minimum.at(first, (row * REGISTERS + register)[inside], time[inside])
        rows = np.flatnonzero(np.bincount(row, minlength=n))
        latest[rows] = first.reshape(n, REGISTERS)[rows].max(axis=1)
    return first.reshape(n, REGISTERS)


def bands(times: np.ndarray) -> np.ndarray:
    """A hash per row and band; times count to the precision of 32-bit floats, so that machines agree."""
    n = len(times)
    bits = mixed(times.astype(np.float32).view(np.uint32).astype(np.uint64).reshape(-1) + np.uint64(1))
    at = np.arange(0, n * REGISTERS, ROWS)
    hashes = span_hashes(bits, at, at + ROWS).reshape(n, BANDS)
    return mixed(hashes + np.arange(BANDS, dtype=np.uint64) * _STEP)


def _keys(pairs: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(pairs), [None, pa.py_buffer(np.ascontiguousarray(pairs).tobytes())]).cast(pa.binary())


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``row_id`` and ``text_hash`` (the row's identity), ``key`` of the words, and ``bands`` (none without a word)."""
    types = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, row_id {_row_id_type(docs)}, text_hash bigint, key binary, bands array<bigint>"

    def step(batch: pa.RecordBatch):
        for texts in pieces(lowered(batch.column(3))):
            keys, row, shingle, count = bags(texts)
            times = registers(texts.n, row, shingle, count)
            values = pa.array(bands(times).view(np.int64).reshape(-1))
            ends = np.concatenate([[0], np.cumsum(np.where(np.isfinite(times[:, 0]), BANDS, 0))])
            values = values.filter(pa.array(np.repeat(np.isfinite(times[:, 0]), BANDS)))
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)
            ids = [batch.column(i).slice(texts.first, texts.n) for i in (0, 1, 2)]
            yield pa.RecordBatch.from_arrays([*ids, _keys(keys), lists], names=["doc_id", "row_id", "text_hash", "key", "bands"])

    names = ["doc_id", "row_id", "text_hash", "text"]
    return per_batch(docs.select("doc_id", *_identity(docs), "text"), names, types, step)


def _bag_table(docs: DataFrame) -> DataFrame:
    """``key, bag``: the shingles of each row in order, each as often as it occurs, as 64-bit values."""

    def step(batch: pa.RecordBatch):
        for texts in pieces(lowered(batch.column(0))):
            keys, row, shingle, count = bags(texts)
            order = np.lexsort((shingle, row))
            each = np.repeat(shingle[order], count[order])
            at = 8 * np.concatenate([[0], np.cumsum(np.bincount(row, weights=count, minlength=texts.n).astype(np.int64))])
            bag = pa.LargeBinaryArray.from_buffers(pa.large_binary(), texts.n, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(each)])
            yield pa.RecordBatch.from_arrays([_keys(keys), bag.cast(pa.binary())], names=["key", "bag"])

    return per_batch(docs, ["text"], "key binary, bag binary", step)


def _overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted bags."""
    together = np.concatenate([a, b])
    order = np.argsort(together, kind="stable")
    values, right = together[order], order >= len(a)
    starts = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    of_b = np.add.reduceat(right.astype(np.int64), starts)
    both = np.minimum(of_b, np.diff(np.append(starts, len(values))) - of_b).sum()
    return both / (len(together) - both)


def _bucketed(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` written in buckets of a column, so that later joins on it move the other side only."""
    spark = df.sparkSession
    path, buckets = new_table_path(spark, name), int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(buckets, column).sortBy(column).option("path", path).saveAsTable(table)
    return spark.table(table)


def _with_bag(rows: DataFrame, end: str, many: DataFrame | None, active: DataFrame, bag_table: DataFrame) -> DataFrame:
    """``rows`` with ``bag_<end>``, the bag of the node in that column.

    Rows are sent to the buckets of the bags. Nodes of ``many`` (the end and its number ``_n`` of pairs) would fill one task each: their rows are
    dealt to as many groups as it takes, each with a copy of the one bag.
    """
    key, bag = f"key_{end}", f"bag_{end}"
    keys = active.select(F.col("id").alias(end), F.col("key").alias(key))
    bags_ = bag_table.select(F.col("key").alias(key), F.col("bag").alias(bag))
    if many is None:
        return rows.join(keys, end).join(bags_, key).drop(key)
    groups = F.expr(f"_n div {PARTNERS} + 1")
    copies = many.join(keys, end).join(bags_, key).select(end, bag, F.explode(F.sequence(F.lit(1).cast("bigint"), groups)).alias("_group"))
    other = "b" if end == "a" else "a"
    dealt = rows.join(many, end).withColumn("_group", F.pmod(F.xxhash64(other), groups) + 1).drop("_n")
    return dealt.join(copies, [end, "_group"]).drop("_group")


def similarities(pairs: DataFrame, active: DataFrame, bag_table: DataFrame) -> DataFrame:
    """``a, b, similar`` of pairs of nodes; one bag of a pair is sent to the other."""
    pairs = durable(pairs.select("a", "b"), "pairs")
    parts: list[tuple[DataFrame, dict[str, DataFrame]]] = [(pairs, {})]
    for end in ("a", "b"):
        many = durable(pairs.groupBy(end).agg(F.count("*").alias("_n")).where(F.col("_n") > PARTNERS), "many")
        if not many.isEmpty():
            split = [[(rows.join(many, end, "left_anti"), known), (rows.join(many, end, "left_semi"), known | {end: many})] for rows, known in parts]
            parts = [part for both in split for part in both]
    joined = None
    for rows, known in parts:
        for end in ("a", "b"):
            rows = _with_bag(rows, end, known.get(end), active, bag_table)
        rows = rows.select("a", "b", "bag_a", "bag_b")
        joined = rows if joined is None else joined.unionByName(rows)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bag = lambda column, i: np.frombuffer(column[i].as_buffer(), dtype=np.uint64)
            found = [_overlap(bag(batch.column(2), i), bag(batch.column(3), i)) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], names=["a", "b", "similar"])

    return joined.mapInArrow(step, "a bigint, b bigint, similar double")


def _own_shingles(bag_table: DataFrame) -> DataFrame:
    """``id, total, others, sketch`` of bags with their class ``label``: a bag's size, how much of it are shingles that another class has too,
    and how that part falls into ``CELLS`` cells of the hash space.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                values, count = np.unique(np.frombuffer(batch.column(2)[i].as_buffer(), dtype=np.uint64), return_counts=True)
                ids, labels = (np.full(len(values), batch.column(k)[i].as_py(), dtype=np.int64) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([*map(pa.array, (ids, labels, values.view(np.int64), count))], names=["id", "label", "shingle", "n"])

    rows = bag_table.select("id", "label", "bag").mapInArrow(step, "id bigint, label bigint, shingle bigint, n bigint")
    shared = rows.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("shingle")
    cell = F.pmod("shingle", F.lit(CELLS)).cast("int").alias("cell")
    cells = rows.join(shared, "shingle", "left_semi").groupBy("id", cell).agg(F.sum("n").alias("n"))
    filled = F.map_from_entries(F.collect_list(F.struct("cell", F.col("n").cast("int"))))
    sketch = F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda k: F.coalesce(F.try_element_at("cells", k), F.lit(0)))
    found = cells.groupBy("id").agg(filled.alias("cells"), F.sum("n").alias("others")).select("id", "others", sketch.alias("sketch"))
    return bag_table.select("id", "total").join(found, "id")


def _between_classes(member: DataFrame, near: DataFrame, labels: DataFrame, active: DataFrame, bag_table: DataFrame) -> DataFrame:
    """Pairs of one bucket and two classes that the comparison with the pivot has left open and that may be links."""
    known = member.join(labels, member["id"] == labels["node"], "left").select("bucket", "id", "pivot", F.coalesce("label", "id").alias("label"))
    known = known.join(near.select(F.col("a").alias("id"), F.col("b").alias("pivot"), "similar"), ["id", "pivot"], "left")
    known = durable(known.withColumn("far", 1 - F.coalesce("similar", F.lit(1.0))), "known")
    per_class = known.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    main = per_class.groupBy("bucket").agg(F.count("*").alias("classes"), F.max_by("label", F.struct("n", "label")).alias("main"))
    rows = durable(known.where("id <> pivot").join(main.where("classes > 1"), "bucket").select("bucket", "id", "label", "main", "far"), "open")

    wanted = durable(rows.select("id", "label").distinct().join(active.select("id", "key"), "id"), "wanted")
    sizes = _own_shingles(bag_table.join(wanted, "key"))
    possible = sizes.where(F.col("others") >= SIMILAR * F.col("total"))
    rows = durable(rows.join(possible, "id"), "possible")
    width = 1 - SIMILAR
    few = rows.where("label <> main").select(*(F.col(c).alias(f"{c}_a") for c in ("id", "label", "far", "total", "others", "sketch")), "bucket")
    few = few.withColumn("step", F.explode(F.array(*(F.floor(F.col("far_a") / width).cast("int") + k for k in (-1, 0, 1)))))
    every = rows.withColumn("step", F.floor(F.col("far") / width).cast("int"))
    most = F.least("others_a", "others")
    closer = F.aggregate(F.zip_with("sketch_a", "sketch", lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
    crossed = few.join(every, ["bucket", "step"]).where(
        (F.col("label_a") != F.col("label"))
        & (F.abs(F.col("far_a") - F.col("far")) <= width + 1e-9)
        & ((F.col("label") == F.col("main")) | (F.col("id_a") < F.col("id")))
        & (most >= SIMILAR * (F.col("total_a") + F.col("total") - most))
        & (closer >= SIMILAR * (F.col("total_a") + F.col("total") - closer))
    )
    return crossed.select(F.col("id_a").alias("a"), F.col("id").alias("b")).distinct()


def _classes_of(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """``node, label`` of the nodes that have a link: what similar texts connect has one label."""
    member = nodes.where("size(bands) > 0").select("id", F.explode("bands").alias("bucket"))
    shared = member.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    member = durable(member.join(shared, "bucket"), "buckets")
    central = member.groupBy("id").agg(F.sum("n").alias("central"))
    pivot = member.join(central, "id").groupBy("bucket").agg(F.max_by("id", F.struct("central", "id")).alias("pivot"))
    member = durable(member.select("bucket", "id").join(pivot, "bucket"), "members")

    active = durable(nodes.join(central.select("id"), "id", "left_semi").select("id", "key", "row_id"), "active")
    texts = docs.select("text", *_identity(docs)).select("text", "row_id").join(active.select("row_id"), "row_id", "left_semi")
    found = _bag_table(texts).groupBy("key").agg(F.first("bag").alias("bag"))
    bag_table = _bucketed(found.withColumn("total", F.octet_length("bag") / 8), "key", "bags")

    starred = member.where("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct()
    near = durable(similarities(starred, active, bag_table), "similar")
    labels = durable(components(near.where(F.col("similar") >= SIMILAR)), "labels")

    rest = similarities(_between_classes(member, near, labels, active, bag_table), active, bag_table).where(F.col("similar") >= SIMILAR)
    rest = durable(rest.select("a", "b"), "links")
    if rest.isEmpty():
        return labels
    class_of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"class_{c}"))
    joined = rest.join(class_of("a"), "a", "left").join(class_of("b"), "b", "left")
    ends = joined.select("a", "b", F.coalesce("class_a", "a").alias("class_a"), F.coalesce("class_b", "b").alias("class_b"))
    merged = components(ends.select(F.col("class_a").alias("a"), F.col("class_b").alias("b"))).select(F.col("node").alias("label"), F.col("label").alias("merged"))
    lone = [ends.select(F.col(c).alias("node"), F.col(f"class_{c}").alias("label")) for c in ("a", "b")]
    every = labels.unionByName(lone[0]).unionByName(lone[1]).distinct()
    return every.join(merged, "label", "left").select("node", F.coalesce("merged", "label").alias("label"))


def _identity(docs: DataFrame, names: tuple[str, str] = ("row_id", "text_hash")) -> list[Column]:
    """A row's id and a hash of its text: rows that share both are the same row repeated.

    A null id becomes the least one; ids other than whole numbers are taken as text, with a mark before it that null lacks.
    """
    doc_id = docs["doc_id"]
    if _row_id_type(docs) == "bigint":
        row_id = F.coalesce(doc_id.cast("bigint"), F.lit(-(2**63)))
    else:
        row_id = F.when(doc_id.isNull(), "").otherwise(F.concat(F.lit("="), doc_id.cast("string")))
    return [row_id.alias(names[0]), F.xxhash64(docs["text"]).alias(names[1])]


def _row_id_type(docs: DataFrame) -> str:
    return "bigint" if isinstance(docs.schema["doc_id"].dataType, T.IntegralType) else "string"


def _labelled(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The signatures of all rows, and per node ``key`` its class ``label`` and its aggregates."""
    rows = durable(signatures(docs), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "row_id", "text_hash")).alias("first")
    nodes = rows.groupBy("key").agg(F.min("row_id").alias("row_id"), first, F.min("doc_id").alias("least"), F.count("*").alias("n"), F.first("bands").alias("bands"))
    nodes = durable(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    labels = _classes_of(nodes, docs)
    named = nodes.join(labels, F.col("id") == F.col("node"), "left").select("key", "first", "least", "n", F.coalesce("label", "id").alias("label"))
    return rows, durable(named, "named")


def classes(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``class_id`` (the least doc_id of its class; null if all are null), ``class_size`` in rows."""
    rows, named = _labelled(docs)
    sums = named.groupBy("label").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"))
    of_key = named.select("key", "label").join(sums, "label").select("key", "class_id", "class_size")
    return rows.select("doc_id", "key").join(of_key, "key").select("doc_id", "class_id", "class_size")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of every class with all columns as they are: the one of the least doc_id (null ids last), and of its texts the least hash."""
    rows, named = _labelled(docs)
    firsts = named.groupBy("label").agg(F.min("first").alias("first")).select("first.row_id", "first.text_hash")
    copies = rows.join(firsts, ["row_id", "text_hash"], "left_semi").groupBy("row_id", "text_hash").agg(F.count("*").alias("n"))
    copies = durable(copies, "kept")
    mark = "_" * (1 + max(len(c) for c in docs.columns))  # longer than any column's name, so that none is hidden
    names = [f"{mark}row_id", f"{mark}text_hash"]
    marked = docs.select("*", *_identity(docs, tuple(names)))
    once, more = (copies.where(c).select(*[F.col(a).alias(b) for a, b in zip(("row_id", "text_hash"), names)]) for c in ("n = 1", "n > 1"))
    kept = marked.join(once, names, "left_semi")
    if not more.isEmpty():
        kept = kept.unionByName(marked.join(more, names, "left_semi").dropDuplicates(names))
    return kept.select(*docs.columns)
