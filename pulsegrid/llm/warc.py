"""WARC archives: written as whole-file gzip streams, normalised to a gzip member per record with an index, and read by offset.

A response holds the payload; a later record with an equal payload of ``MIN_REVISIT`` bytes or more is a revisit, which names the response.
Equal payloads are found by their SHA-256, aggregated before the shuffle; the digests that occur more than once are joined back with a salt, so
that a page copied a million times is no hot key.

``write_archives`` uses Spark's text writer, which compresses each file as one gzip stream: only the whole file can be inflated. ``normalise``
inflates every file once, as a stream of lines (so neither the file nor its text is ever held whole; a record is), and writes each record as a
member of its own. The members go to the folder through ``pyarrow.fs``, under a name of the task's own, and the index rows that the task
returns name that file: after a lost executor the task runs again, and what the lost one wrote is in no index. ``read_records`` opens each
record alone by offset and length.

Null html is an empty payload. Pages with one id are separate records, told apart by the order of their digests; null ids are kept.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_REVISIT = 100
SALTS = 32
RECORDS_PER_FILE = 20_000
#: Fast compression of members; readers do not care.
LEVEL = 3
END = b"\r\n\r\n"
INDEX = "archive string, offset bigint, length bigint, record_id string"


def with_types(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload`` (string), its digest and size, the record type, and what a revisit refers to."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload.cast("binary"), 256).alias("digest"))
    rows = rows.withColumn("size", F.octet_length("payload").cast("bigint"))
    first = rows.where(F.col("size") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n"))
    copied = first.where(F.col("_n") > 1).select("digest", "_first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    found = salted.join(copied, ["digest", "_salt"], "left").drop("_salt")
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return found.withColumns({"revisit": revisit, "refers_to": F.when(revisit, F.col("_first"))}).drop("_first")


def _record() -> Column:
    """The record as text, without the blank lines that end it; lines end as the format wants."""
    body = F.when(F.col("revisit"), F.lit("")).otherwise(F.col("payload"))
    named = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    identity = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        named("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        named("WARC-Record-ID", identity(F.col("page_id"))),
        F.coalesce(named("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", " ")), F.lit("")),
        named("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        named("X-Payload-Length", F.col("size").cast("string")),
        F.when(F.col("revisit"), named("WARC-Refers-To", identity(F.col("refers_to")))).otherwise(F.lit("")),
        named("Content-Type", F.lit("text/html; charset=utf-8")),
        named("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"),
        body,
    )


def write_archives(typed: DataFrame, folder: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """One gzip stream per file of up to so many records, in the folder (any that Spark can write)."""
    lines = typed.select(_record().alias("value"))
    lines.write.option("compression", "gzip").option("lineSep", END.decode()).option("maxRecordsPerFile", records_per_file).text(folder)


def _headers(raw: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in raw.decode().split("\r\n") if ": " in line)


def _records(lines: Iterator[tuple[str, bytes]]) -> Iterator[tuple[str, dict[str, str], bytes, bytes]]:
    """(file, headers, raw headers, payload) of each record in a stream of (file, line without line feed)."""
    lines = iter(lines)
    for file, line in lines:
        if not line.startswith(b"WARC/"):
            if line.strip():
                raise ValueError(f"no record starts at this line of {file}: {line[:80]!r}")
            continue
        head = [line]
        while head[-1] not in (b"\r", b""):
            head.append(next(lines)[1])
        raw = b"\n".join(head) + b"\n"
        headers = _headers(raw)
        left, body = int(headers["Content-Length"]), []
        while left > 0:
            piece = next(lines)[1] + b"\n"
            body.append(piece)
            left -= len(piece)
        payload = b"".join(body)
        rest = payload[len(payload) + left :] if left < 0 else b""
        if rest.strip():
            raise ValueError(f"a record of {file} is longer than it says")
        yield file, headers, raw, payload[: len(payload) + left] if left < 0 else payload


class _Members:
    """Writes records of one archive as gzip members, and the index rows of what was written."""

    def __init__(self, folder: str, name: str):
        files, path = FileSystem.from_uri(folder)
        self.name, self.offset, self.rows = f"{name}-{uuid.uuid4().hex[:12]}.warc.gz", 0, []
        self.out = files.open_output_stream(f"{path}/{self.name}", compression=None)

    def add(self, record_id: str, record: bytes) -> None:
        member = gzip.compress(record, LEVEL, mtime=0)
        self.out.write(member)
        self.rows.append((self.name, self.offset, len(member), record_id))
        self.offset += len(member)

    def taken(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = [list(c) for c in zip(*rows)] or [[], [], [], []]
        types = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["archive", "offset", "length", "record_id"])


def normalise(spark, folder: str, target: str) -> DataFrame:
    """Rewrite the archives in ``folder`` record by record into ``target``; its index, written beside the members, as a table."""
    members = f"{target}/members"
    files, path = FileSystem.from_uri(uri_of(members))
    files.create_dir(path)
    uri = uri_of(members)
    lines = spark.read.option("lineSep", "\n").text(folder).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = ((f, x) for batch in batches for f, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        source = out = None
        for file, headers, raw, payload in _records(stream):
            if file != source:
                if out is not None:
                    out.out.close()
                    yield out.taken()
                source, out = file, _Members(uri, file.rsplit("/", 1)[-1].split(".")[0])
            out.add(headers["WARC-Record-ID"], raw + payload + END)
            if len(out.rows) >= 1_000:
                yield out.taken()
        if out is not None:
            out.out.close()
            yield out.taken()

    lines.mapInArrow(step, INDEX).write.parquet(f"{target}/index")
    return spark.read.schema(INDEX).parquet(f"{target}/index")


def uri_of(folder: str) -> str:
    return folder if "://" in folder else f"file://{folder[5:] if folder.startswith('file:') else folder}"


def read_records(index: DataFrame, target: str) -> DataFrame:
    """Each indexed record, read alone by its offset: identity, type, payload digest and size, and what it refers to."""
    uri = uri_of(f"{target}/members")
    names = ["record_id", "record_type", "payload_bytes", "payload_digest", "refers_to_id"]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = FileSystem.from_uri(uri)
        name = file = None
        for batch in batches:
            rows = []
            for archive, offset, length, record_id in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if archive != name:
                    name, file = archive, files.open_input_file(f"{path}/{archive}")
                file.seek(offset)
                record = zlib.decompress(file.read(length), wbits=31)
                raw, _, rest = record.partition(END)
                headers = _headers(raw)
                payload = rest[: int(headers["Content-Length"])]
                if headers["WARC-Record-ID"] != record_id or rest[len(payload) :] != END:
                    raise ValueError(f"no whole record at {offset} of {archive}")
                kind = headers["WARC-Type"]
                size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                if kind == "revisit":
                    size, digest = int(headers["X-Payload-Length"]), headers["WARC-Payload-Digest"].removeprefix("sha256:")
                rows.append((record_id, kind, size, digest, headers.get("WARC-Refers-To")))
            types = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
            columns = [list(c) for c in zip(*rows)] or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    partitions = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = index.repartitionByRange(partitions, "archive", "offset").sortWithinPartitions("archive", "offset")
    return spread.mapInArrow(step, "record_id string, record_type string, payload_bytes bigint, payload_digest string, refers_to_id string")


def _page_of(c: str, kind: T.DataType) -> Column:
    return F.nullif(F.regexp_extract(c, "<urn:page:(.*)>", 1), F.lit("none")).cast(kind)


def roundtrip(pages: DataFrame, folder: str) -> DataFrame:
    """Archive every page, normalise the archives, and read every record back through the index."""
    write_archives(with_types(pages), f"{folder}/whole")
    index = normalise(pages.sparkSession, f"{folder}/whole", f"{folder}/records")
    found = read_records(index, f"{folder}/records")
    kind = pages.schema["page_id"].dataType
    return found.select(_page_of("record_id", kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", _page_of("refers_to_id", kind).alias("refers_to"))
