"""WARC archives as seekable Zstandard bundles.

A bundle holds WARC records in independent frames of about a megabyte; a skippable frame at its end is the seek table (sizes and
checksums of all frames, the public seekable format), so any Zstandard tool decodes the whole and a reader can begin at any frame.
Every task writes bundles of its own and returns one index row a record: record id, file, frame, and the place inside the frame.
The written index is the commit: what a failed attempt has left is named by no row. Reading starts from the bundles' seek tables
and deals out frames, not files.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.scratch import Scratch

# Fixed values of the seekable format: skippable frame, footer, and the flag of checksums.
SKIPPABLE, SEEKABLE, CHECKED = 0x184D2A5E, 0x8F92EAB1, 0x80
# Fixed value: the profile of records whose payload stands in another one.
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_LINE = b"\r\n"
INDEX = "record_id string, page_id long, file string, frame int, frame_offset long, frame_size long, at long, length long"
RECORD = "record_id string, page_id long, uri string, record_type string, refers_to string, payload_digest string, payload binary"
FRAME = "file string, frame int, frame_offset long, frame_size long, size long, checksum long"


class BundleWriter:
    """Frames of whole records, then the seek table."""

    def __init__(self, out, frame: int = 1 << 20, level: int = 3):
        self.out, self.frame, self.level = out, frame, level
        self.frames: list[tuple[int, int, int]] = []  # compressed size, size, checksum
        self.waiting: list[bytes] = []
        self.size = self.offset = 0

    def add(self, record: bytes) -> tuple[int, int]:
        """The frame and the place in it of a record. A frame ends with the record that fills it; large records have their own."""
        if self.waiting and self.size + len(record) > self.frame:
            self.flush()
        where = len(self.frames), self.size
        self.waiting.append(record)
        self.size += len(record)
        return where

    def flush(self) -> None:
        if self.waiting:
            data = b"".join(self.waiting)
            packed = zstandard.ZstdCompressor(level=self.level).compress(data)
            self.out.write(packed)
            self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
            self.offset += len(packed)
            self.waiting, self.size = [], 0

    def close(self) -> None:
        self.flush()
        entries = b"".join(struct.pack("<III", *f) for f in self.frames)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(self.frames), CHECKED, SEEKABLE))
        self.out.close()


def seek_table(f) -> list[tuple[int, int, int, int]]:
    """(offset, compressed size, size, checksum) of each frame of an open bundle, read from its end."""
    size = f.size()
    n, flags, magic = struct.unpack("<IBI", f.read_at(9, size - 9))
    if magic != SEEKABLE or not flags & CHECKED:
        raise ValueError("no seek table")
    entries, at, out = f.read_at(12 * n, size - 9 - 12 * n), 0, []
    for packed, whole, check in struct.iter_unpack("<III", entries):
        out.append((at, packed, whole, check))
        at += packed
    return out


def read_frame(f, offset: int, packed: int, check: int | None = None) -> bytes:
    """The records of one frame of an open bundle; nothing else of it is read."""
    data = zstandard.ZstdDecompressor().decompress(f.read_at(packed, offset))
    if check is not None and xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
        raise ValueError("a frame's checksum is wrong")
    return data


def record_id(page_id: int | None, digest: str) -> str:
    """The same for the same page and payload in any task, so that a revisit can name its response."""
    return f"urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page_id}:{digest}'.encode()).digest()[:16])}"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> tuple[str, bytes]:
    """Id and bytes of a response, or of a revisit of page ``refers_to``, which has the headers and no payload."""
    own = record_id(page_id, digest)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{own}>"), ("WARC-Date", date)]
    if page_id is not None:
        fields.append(("Page-ID", str(page_id)))
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    fields.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if refers_to is not None:
        fields += [("WARC-Profile", IDENTICAL), ("WARC-Refers-To", f"<{record_id(refers_to, digest)}>")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields)
    return own, b"".join([head.encode(), _LINE, block, _LINE * 2])


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (by lower-case name) and payload of the records in some bytes."""
    at = 0
    while at < len(data):
        end = data.index(_LINE * 2, at)
        version, *lines = data[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("no record where one should begin")
        fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
        begin, size = end + 4, int(fields["content-length"])
        body = data.index(_LINE * 2, begin) + 4
        yield fields, data[body : begin + size]
        at = begin + size + 4


def _bare(name: str | None) -> str | None:
    return name and name.strip("<>")


def originals(pages: DataFrame, least: int) -> DataFrame:
    """(digest, first): of payloads of at least ``least`` bytes that several records share, the smallest page_id."""
    rows = pages.select("page_id", _digest().alias("digest")).where(F.octet_length(_payload()) >= least)
    found = rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    return found.where("n > 1 and first is not null").select("digest", "first")


def _payload() -> Column:
    return F.coalesce(F.col("html"), F.lit(""))


def _digest() -> Column:
    return F.sha2(_payload(), 256)


def write_bundles(
    pages: DataFrame, folder: str, *, least: int = 100, frame: int = 1 << 20, bundle: int = 256 << 20, small: int = 100_000, date: str = "1970-01-01T00:00:00Z"
) -> DataFrame:
    """Archives the rows of (page_id, url, html) below ``folder``; the index, one row a record, is written there, too.

    Of records with equal payloads of at least ``least`` bytes that with the smallest page_id is a response and the others are revisits
    of it. Rows that repeat that page_id are responses, too, under the same record id; a null page_id is never the smallest, and
    payloads that only such rows have are all responses. Null html is an empty payload. Other columns are ignored.

    Only the payloads that are shared meet the rows again: up to ``small`` of them are broadcast (some 10 MB), more are joined by
    digest. The folder is any that pyarrow's file systems open. frame: bytes of records in a frame; bundle: compressed bytes of a file.
    """
    spark = pages.sparkSession
    rows = pages.select(*(F.col(c).cast(t).alias(c) for c, t in (("page_id", "long"), ("url", "string"), ("html", "string"))))
    scratch = Scratch(spark, "warc")
    shared = scratch.save(originals(rows, least))
    n = shared.count()
    rows = rows.select("page_id", "url", _payload().alias("html"), _digest().alias("digest"))
    if n:
        rows = rows.join(F.broadcast(shared) if n <= small else shared, "digest", "left")
        again = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first")))
        rows = rows.select("page_id", "url", "html", "digest", F.when(again, F.col("first")).alias("refers_to"))
    else:
        rows = rows.withColumn("refers_to", F.lit(None).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(f"{root}/bundles", recursive=True)
        out, name, index = None, "", []

        def done() -> pa.RecordBatch:
            out.close()
            offset = [0]
            for packed, _, _ in out.frames:
                offset.append(offset[-1] + packed)
            cols = list(zip(*((i, p, name, f, offset[f], out.frames[f][0], at, size) for i, p, f, at, size in index)))
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int32(), *[pa.int64()] * 4)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[c.split()[0] for c in INDEX.split(", ")])

        for b in batches:
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    name, index = f"{uuid.uuid4().hex}.warc.zst", []
                    out = BundleWriter(store.open_output_stream(f"{root}/bundles/{name}", compression=None), frame)
                own, data = record(page_id, url, html.encode(), digest, refers_to, date)
                index.append((own, page_id, *out.add(data), len(data)))
                if out.offset >= bundle:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    path = f"{folder}/index"
    rows.mapInArrow(run, INDEX).write.option("compression", "zstd").parquet(path)
    scratch.drop(shared)
    return spark.read.schema(INDEX).parquet(path)


def frames(spark: SparkSession, folder: str, index: DataFrame) -> DataFrame:
    """Every frame of the indexed bundles, from their seek tables."""
    files = index.select("file").distinct()
    files = files.repartition(max(1, files.count() // 64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for b in batches:
            out = []
            for name in b.column(0).to_pylist():
                with store.open_input_file(f"{root}/bundles/{name}") as f:
                    out += [(name, i, *x) for i, x in enumerate(seek_table(f))]
            kinds = (pa.string(), pa.int32(), *[pa.int64()] * 4)
            cols = list(zip(*out)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[c.split()[0] for c in FRAME.split(", ")])

    return files.mapInArrow(run, FRAME)


def _each(folder: str, wanted, schema: str, make):
    """Opens each file once in a row; ``wanted`` of a batch gives (file, offset, packed size, checksum or None, what else), ``make`` rows of a frame."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        opened, f = None, None
        for b in batches:
            for name, offset, packed, check, more in wanted(b):
                if name != opened:
                    if f is not None:
                        f.close()
                    opened, f = name, store.open_input_file(f"{root}/bundles/{name}")
                rows = list(make(read_frame(f, offset, packed, check), more))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names=names)
        if f is not None:
            f.close()

    return run


def _row(fields: dict[str, str], payload: bytes, digest: bool = False) -> tuple:
    page = fields.get("page-id")
    head = _bare(fields["warc-record-id"]), None if page is None else int(page)
    kind, refers = fields["warc-type"], _bare(fields.get("warc-refers-to"))
    if digest:
        return *head, kind, refers, len(payload), hashlib.sha256(payload).hexdigest()
    return *head, fields.get("warc-target-uri"), kind, refers, fields["warc-payload-digest"].removeprefix("sha256:"), None if kind == "revisit" else payload


def _from_frames(spark: SparkSession, folder: str, index: DataFrame, schema: str, make, task: int = 32 << 20) -> DataFrame:
    every = frames(spark, folder, index)
    total = index.agg(F.sum("length").alias("n")).first()["n"] or 0
    dealt = every.select("file", "frame_offset", "frame_size", "checksum").repartition(max(1, -(-total // task)), "file", "frame_offset").sortWithinPartitions("file", "frame_offset")
    wanted = lambda b: ((*x, None) for x in zip(*(c.to_pylist() for c in b.columns)))
    return dealt.mapInArrow(_each(folder, wanted, schema, make), schema)


def read_records(spark: SparkSession, folder: str, index: DataFrame) -> DataFrame:
    """All records as the archives have them: record_id, page_id, uri, record_type, refers_to (a record id), payload_digest as its header says, and
    payload, which is null in revisits. A task reads frames of about 32 MB, wherever they lie, and checks them."""
    return _from_frames(spark, folder, index, RECORD, lambda data, _: (_row(*r) for r in parsed(data)))


def read_digests(spark: SparkSession, folder: str, index: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (a page_id) of all records, as measured on the payloads read.

    A revisit has what its response measures. Responses that share an id are equal, so one of them stands for all.
    """
    schema = "record_id string, page_id long, record_type string, refers string, n long, digest string"
    rows = _from_frames(spark, folder, index, schema, lambda data, _: (_row(*r, digest=True) for r in parsed(data)))
    rows = Scratch(spark, "warc").save(rows)
    first = rows.where("record_type = 'response'").groupBy("record_id").agg(F.min("page_id").alias("first"), F.min("n").alias("n"), F.min("digest").alias("digest"))
    again = rows.where("record_type = 'revisit'").select("page_id", F.col("refers").alias("record_id"))
    again = again.join(first, "record_id").select("page_id", F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.lit("revisit").alias("record_type"), F.col("first").alias("refers_to"))
    own = rows.where("record_type = 'response'").select("page_id", F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    return own.unionByName(again)


def fetch(index: DataFrame, ids: DataFrame, folder: str) -> DataFrame:
    """The records of (record_id) as ``read_records`` gives them, by their places in the index: only the frames that hold some are read, each once."""
    found = index.join(ids.select("record_id").distinct(), "record_id")
    groups = found.groupBy("file", "frame_offset", "frame_size").agg(F.collect_list(F.struct("at", "length")).alias("places"))  # of one frame

    def wanted(b: pa.RecordBatch):
        for name, offset, packed, places in zip(*(c.to_pylist() for c in b.columns)):
            yield name, offset, packed, None, [(p["at"], p["length"]) for p in places]

    def make(data: bytes, places: list[tuple[int, int]]):
        for at, size in sorted(places):
            yield from (_row(*r) for r in parsed(data[at : at + size]))

    return groups.mapInArrow(_each(folder, wanted, RECORD, make), RECORD)
