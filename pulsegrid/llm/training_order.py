"""Token ids as fixed-stride binary shards in training order.

Every document is encoded and cut into sequences of ``LENGTH`` ids, the last one shorter. Sequences are numbered 0 to N - 1 in the order in which
Spark reads the table, and a keyed Feistel permutation of the next power of four, walked along its cycle until it is below N, gives each
its global slot. The permutation is a bijection, so slots are dense and need no sort of a random number, and any slot can be traced back.

Numbers need the counts of what comes before. They are taken in a first pass that keeps one count per input partition, and the second pass
encodes again: that costs CPU time, but neither a stored copy of all ids nor a shuffle of texts. Both passes see the same partitions, since
they read the same files; a partition whose count differs in the second pass ends the job, for the slots would not be dense.

A shard holds ``per_shard`` consecutive slots. Rows are sent to the partition of their shard by number, sorted by slot there, and written as records
of one stride: doc_id (64 bits; the least for null), part and number of ids (32 bits each), then the ids (16 bits each if the vocabulary allows,
else 32), zero behind the last one. So slot s is at byte ``(s - first) * stride`` of its shard, shards read sequentially, and a run resumes at any
slot. Shards are written under a name of the task's own, and the manifest names those of the tasks that ended: what a lost executor has left
is in no manifest.

Null and empty texts have no sequence. Repeated documents are separate sequences.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.pretokens import IdCache, expand, spans
from pulsegrid.llm.textbatch import Texts
from pulsegrid.llm.warc import uri_of

VOCABULARY = "byte_bpe_50k.tiktoken"
LENGTH = 128
PER_SHARD = 1 << 17
ROUNDS = 6
SEED = 20240131
HEAD = np.dtype([("doc_id", "<i8"), ("part", "<u4"), ("n_ids", "<u4")])
MANIFEST = "shard bigint, file string, first_slot bigint, n_slots bigint"
CHUNK = 1 << 12


@cache
def _encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


# --- the permutation ------------------------------------------------------------------------------


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    x = x ^ np.uint64(key)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@dataclass(frozen=True)
class Permutation:
    """A keyed bijection of 0 .. n - 1."""

    n: int
    seed: int = SEED

    @property
    def half(self) -> int:
        """Bits of either half: the smallest square domain that holds n."""
        return max(1, (max(self.n - 1, 1).bit_length() + 1) // 2)

    def _keys(self) -> list[int]:
        return [int(_mixed(np.array([k + 1], np.uint64), self.seed & (1 << 64) - 1)[0]) for k in range(ROUNDS)]

    def _pass(self, x: np.ndarray, keys: list[int], back: bool) -> np.ndarray:
        bits, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> bits, x & mask
        for key in keys:
            if back:
                left, right = right ^ (_mixed(left, key) & mask), left
            else:
                left, right = right, left ^ (_mixed(right, key) & mask)
        return left << bits | right

    def _walk(self, x: np.ndarray, keys: list[int], back: bool) -> np.ndarray:
        y = self._pass(np.asarray(x, dtype=np.uint64), keys, back)
        while len(out := np.flatnonzero(y >= np.uint64(self.n))):
            y[out] = self._pass(y[out], keys, back)
        return y.astype(np.int64)

    def slot(self, number: np.ndarray) -> np.ndarray:
        return self._walk(number, self._keys(), False)

    def number(self, slot: np.ndarray) -> np.ndarray:
        """The number whose slot this is."""
        return self._walk(slot, self._keys()[::-1], True)


# --- encoding and numbering -------------------------------------------------------------------------


def _parts(lengths: np.ndarray) -> np.ndarray:
    return -(-lengths // LENGTH)


def _input(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


@cache
def _cache(path: str) -> IdCache:
    """One per worker process."""
    encode = _encoding(path).encode_ordinary
    return IdCache(lambda form: encode(form.decode()), id_type(path))


def _found(batch: pa.RecordBatch, path: str) -> Iterator[tuple[Texts, np.ndarray, np.ndarray, np.ndarray]]:
    """(piece of texts, its rows' numbers of ids, place and length of each pre-token's ids)."""
    for texts, begin, end in spans(batch.column(1)):
        at, length = _cache(path).find(texts, begin, end)
        total = np.append(0, np.cumsum(length))
        yield texts, np.diff(total[np.searchsorted(begin, texts.starts)]), at, length


def partition_counts(docs: DataFrame, path: str) -> dict[int, int]:
    """Sequences per input partition: a row per task reaches the driver, however many documents there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(int(_parts(lengths).sum()) for batch in batches if batch.num_rows for _, lengths, _, _ in _found(batch, path))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([total])], names=["partition", "n"])

    return {row["partition"]: row["n"] for row in _input(docs).mapInArrow(count, "partition bigint, n bigint").collect()}


def sequences(docs: DataFrame, counts: dict[int, int], path: str, seed: int = SEED) -> DataFrame:
    """``slot, doc_id, part, ids`` (16- or 32-bit values as binary) of every sequence."""
    order = sorted(counts)
    starts = dict(zip(order, (np.cumsum([counts[p] for p in order]) - [counts[p] for p in order]).tolist()))
    shared = docs.sparkSession.sparkContext.broadcast((starts, counts))
    permutation = Permutation(sum(counts.values()), seed)
    kind = np.dtype(id_type(path))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition = TaskContext.get().partitionId()
        starts, counts = shared.value
        number = first = starts.get(partition, 0)
        for batch in batches:
            for texts, lengths, at, length in _found(batch, path) if batch.num_rows else ():
                flat = _cache(path).ids[expand(at, length)]
                parts = _parts(lengths)
                n = int(parts.sum())
                part = np.arange(n) - np.repeat(np.cumsum(parts) - parts, parts)
                size = np.minimum(np.repeat(lengths, parts) - part * LENGTH, LENGTH)
                ends = np.append(0, np.cumsum(size * kind.itemsize)).astype(np.int32)
                binary = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(flat)])
                slot = permutation.slot(np.arange(number, number + n)) if n else np.zeros(0, np.int64)
                number += n
                doc = np.repeat(batch.column(0).slice(texts.first, texts.n).to_numpy(), parts)
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(doc), pa.array(part), binary], names=["slot", "doc_id", "part", "ids"])
        if number - first != counts.get(partition, 0):
            raise RuntimeError(f"input partition {partition} gave {number - first} sequences, {counts.get(partition, 0)} when they were counted")

    return _input(docs).mapInArrow(step, "slot bigint, doc_id bigint, part bigint, ids binary")


def id_type(path: str) -> str:
    return "<u2" if _encoding(path).max_token_value < 1 << 16 else "<u4"


def record_type(path: str) -> np.dtype:
    return np.dtype([*HEAD.descr, ("ids", id_type(path), (LENGTH,))])


# --- shards -----------------------------------------------------------------------------------------


def write_shards(rows: DataFrame, total: int, folder: str, path: str, per_shard: int = PER_SHARD) -> DataFrame:
    """The shards of all slots in ``folder``; their manifest, written beside them, as a table."""
    spark = rows.sparkSession
    target = uri_of(f"{folder}/shards")
    files, place = FileSystem.from_uri(target)
    files.create_dir(place)
    record = record_type(path)
    shards = max(1, -(-total // per_shard))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, place = FileSystem.from_uri(target)
        out, done = None, []
        for batch in batches:
            slot = batch.column(0).to_numpy()
            ids = batch.column(3)
            ends = np.frombuffer(ids.buffers()[1], dtype=np.int32)[ids.offset : ids.offset + len(ids) + 1]
            raw = np.frombuffer(ids.buffers()[2] or b"", dtype=np.uint8)
            for begin, end in _groups(slot // per_shard):
                shard = int(slot[begin] // per_shard)
                if not done or done[-1][0] != shard:
                    if out is not None:
                        out.close()
                    name = f"shard-{shard:08d}-{uuid.uuid4().hex[:12]}.bin"
                    out = files.open_output_stream(f"{place}/{name}", compression=None)
                    done.append([shard, name, shard * per_shard, 0])
                for at in range(begin, end, CHUNK):
                    to = min(at + CHUNK, end)
                    if (slot[at:to] != done[-1][2] + done[-1][3] + np.arange(to - at)).any():
                        raise RuntimeError(f"slots of shard {shard} are not dense")
                    block = np.zeros(to - at, dtype=record)
                    size = np.diff(ends[at : to + 1]) // record["ids"].base.itemsize
                    block["doc_id"], block["part"], block["n_ids"] = batch.column(1).to_numpy()[at:to], batch.column(2).to_numpy()[at:to], size
                    block["ids"][np.arange(LENGTH) < size[:, None]] = raw[ends[at] : ends[to]].view(record["ids"].base)
                    out.write(block.tobytes())
                    done[-1][3] += to - at
        if out is not None:
            out.close()
        columns = [list(c) for c in zip(*done)] or [[]] * 4
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["shard", "file", "first_slot", "n_slots"])

    partitions = min(shards, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 << 14))
    target_of = F.expr(f"cast((slot div {per_shard}) * {partitions} div {shards} as int)")
    placed = rows.repartitionById(partitions, target_of).sortWithinPartitions("slot")
    placed.mapInArrow(step, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def _groups(values: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
    yield from zip(cuts.tolist(), np.append(cuts[1:], len(values)).tolist())


def read_shards(manifest: DataFrame, folder: str, path: str, from_slot: int = 0) -> DataFrame:
    """Every record from a slot on, each shard read sequentially from that slot's offset: ``slot, doc_id, part, n_ids, ids, shard, offset``."""
    target, record = uri_of(f"{folder}/shards"), record_type(path)
    names = ["slot", "doc_id", "part", "n_ids", "ids", "shard", "offset"]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, place = FileSystem.from_uri(target)
        for batch in batches:
            for shard, file, first, n in zip(*(c.to_pylist() for c in batch.columns)):
                skip = max(0, from_slot - first)
                with files.open_input_file(f"{place}/{file}") as source:
                    source.seek(skip * record.itemsize)
                    while skip < n:
                        block = np.frombuffer(source.read(min(CHUNK, n - skip) * record.itemsize), dtype=record)
                        slot = np.arange(first + skip, first + skip + len(block))
                        ends = np.append(0, np.cumsum(block["n_ids"].astype(np.int64) * record["ids"].base.itemsize)).astype(np.int32)
                        flat = np.ascontiguousarray(block["ids"])[np.arange(LENGTH) < block["n_ids"][:, None]]
                        binary = pa.BinaryArray.from_buffers(pa.binary(), len(block), [None, pa.py_buffer(ends), pa.py_buffer(flat)])
                        numbers = [slot, *(block[c].astype(np.int64) for c in ("doc_id", "part", "n_ids"))]
                        place_of = [np.full(len(block), shard), (slot - first) * record.itemsize]
                        yield pa.RecordBatch.from_arrays([*map(pa.array, numbers), binary, *map(pa.array, place_of)], names=names)
                        skip += len(block)

    wanted = manifest.where(F.col("first_slot") + F.col("n_slots") > from_slot)
    spread = wanted.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard")
    return spread.mapInArrow(step, "slot bigint, doc_id bigint, part bigint, n_ids bigint, ids binary, shard bigint, offset bigint")


def materialise(docs: DataFrame, folder: str, path: str | None = None, seed: int = SEED, per_shard: int = PER_SHARD) -> DataFrame:
    """Encode, number, permute and write all sequences; the manifest of the shards."""
    path = path or public_tokenizers.path(VOCABULARY)
    counts = partition_counts(docs, path)
    return write_shards(sequences(docs, counts, path, seed), sum(counts.values()), folder, path, per_shard)


def placed_sequences(spark: SparkSession, docs: DataFrame, folder: str, path: str | None = None, per_shard: int = PER_SHARD) -> DataFrame:
    """Write the shards and read them back: where each sequence is, and the CRC-32 of its ids as they are stored."""
    path = path or public_tokenizers.path(VOCABULARY)
    found = read_shards(materialise(docs, folder, path, per_shard=per_shard), folder, path)
    return found.select("slot", F.nullif("doc_id", F.lit(-(2**63))).alias("doc_id"), "part", "n_ids", "shard", "offset", F.crc32("ids").alias("ids_crc32"))
