"""WARC archives as seekable Zstandard bundles.

A bundle is one file: records grouped into independent Zstandard frames, then a skippable frame
with the seek table (every frame's compressed and decompressed size) whose last nine bytes name it,
so that any Zstandard reader can read the file from the start and a seeking one can open one frame
alone. The index, a Parquet table beside the bundles, maps every record id to its bundle, frame and
the record's offset and length in the frame.

Each task writes its own bundles through the file system that the folder's URI names, under names of
its own attempt; only bundles in the committed index count, so lost or repeated tasks do no harm.

Of records with equal payloads of at least ``min_revisit`` bytes the one with the smallest id is the
response; others are revisit records that refer to it and carry no payload.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwise.llm.common import map_arrow

#: Fixed values of the seekable Zstandard format and of WARC.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEK_TABLE_MAGIC = 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 64 << 20
WARC_DATE = "2020-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_INDEX = "record_id string, bundle string, frame int, offset int, length int"


def record_id(key) -> str:
    """The id of a page's record, made from its key."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{key}')}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record. Revisits name their response and the length and digest of the payload that
    they leave out."""
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", WARC_DATE), ("X-Page-Id", "" if page_id is None else str(page_id)),
        ("WARC-Target-URI", quote(url or "", safe=":/?#[]@!$&'()*+,;=%~")),
        ("WARC-Payload-Digest", "sha256:" + hashlib.sha256(payload).hexdigest()),
        ("X-Payload-Length", str(len(payload))), ("Content-Type", "application/http; msgtype=response")]
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to)),
                   ("X-Refers-To-Page-Id", str(refers_to))]
    body = _HTTP if revisit else _HTTP + payload
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(body)))])
    return head.encode() + b"\r\n" + body + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """(header fields, payload, offset, length) of the records in a frame's bytes."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no record at byte {at}")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        body = data[end + 4:end + 4 + int(fields["Content-Length"])]
        stop = end + 4 + len(body) + 4
        yield fields, body[body.index(b"\r\n\r\n") + 4:], at, stop - at
        at = stop


class BundleWriter:
    """Writes one bundle to a binary stream."""

    def __init__(self, stream, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self._stream, self._frame_bytes = stream, frame_bytes
        self._compressor = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self._open = io.BytesIO()
        self._frames: list[tuple[int, int]] = []
        self.size = 0

    def add(self, record: bytes) -> tuple[int, int, int]:
        """(frame, offset in the decompressed frame, length) of the record. A frame takes records
        until it is full; a long record has a frame of its own."""
        if self._open.tell() and self._open.tell() + len(record) > self._frame_bytes:
            self._flush()
        at = self._open.tell()
        self._open.write(record)
        return len(self._frames), at, len(record)

    def _flush(self) -> None:
        data = self._open.getvalue()
        packed = self._compressor.compress(data)
        self._stream.write(packed)
        self._frames.append((len(packed), len(data)))
        self.size += len(packed)
        self._open = io.BytesIO()

    def close(self) -> None:
        if self._open.tell():
            self._flush()
        table = b"".join(struct.pack("<II", *f) for f in self._frames)
        footer = struct.pack("<IBI", len(self._frames), 0, SEEK_TABLE_MAGIC)
        self._stream.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table) + len(footer)) + table + footer)
        self._stream.close()


class BundleReader:
    """Reads frames of a bundle by number, from a seekable binary stream."""

    def __init__(self, stream):
        self._stream = stream
        stream.seek(-9, io.SEEK_END)
        n, _, magic = struct.unpack("<IBI", stream.read(9))
        if magic != SEEK_TABLE_MAGIC:
            raise ValueError("no seek table")
        stream.seek(-9 - 8 * n, io.SEEK_END)
        table = stream.read(8 * n)
        self._frames, at = [], 0
        for packed, plain in struct.iter_unpack("<II", table):
            self._frames.append((at, packed, plain))
            at += packed
        self._decompressor = zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self._frames)

    def frame(self, k: int) -> bytes:
        at, packed, plain = self._frames[k]
        self._stream.seek(at)
        data = self._decompressor.decompress(self._stream.read(packed))
        if len(data) != plain:
            raise ValueError(f"frame {k} has {len(data)} bytes, not {plain}")
        return data


def _file_system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _uri(folder: str) -> str:
    """Spark's spelling file:/x as file:///x."""
    return "file://" + folder[5:] if folder.startswith("file:/") and not folder.startswith("file://") else folder


def with_revisits(pages: DataFrame, min_revisit: int = 100) -> DataFrame:
    """(page_id, url, payload, refers_to): ``refers_to`` is the smallest id of the same payload where
    the row is not itself that one. Ids of repeated payloads only are joined; rows that repeat the
    smallest id are all responses; rows without an id are never referred to."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select("page_id", "url", html.cast("binary").alias("payload"))
    long = F.octet_length("payload") >= min_revisit
    digest = F.when(long & F.col("page_id").isNotNull(), F.sha2("payload", 256))
    first = (rows.select(digest.alias("_digest"), "page_id").where("_digest is not null")
             .groupBy("_digest").agg(F.min("page_id").alias("_first"), F.max("page_id").alias("_last"))
             .where("_first <> _last").drop("_last").checkpoint())
    ids = (rows.select(digest.alias("_digest"), "page_id").join(first, "_digest")
           .where("page_id <> _first").select("page_id", F.col("_first").alias("refers_to"), "_digest"))
    revisits = ids.distinct().checkpoint()
    few = revisits.count() <= MAX_BROADCAST_REVISITS
    side = revisits.withColumnsRenamed({"page_id": "_page", "_digest": "_same"})
    return (rows.withColumn("_digest", digest)
            .join(F.broadcast(side) if few else side,
                  (F.col("page_id") == F.col("_page")) & (F.col("_digest") == F.col("_same")), "left")
            .select("page_id", "url", "payload", "refers_to"))


#: Up to so many revisits (about 100 bytes each) their list is broadcast; more are joined by id.
MAX_BROADCAST_REVISITS = 200_000


def write_archives(pages: DataFrame, folder: str, min_revisit: int = 100, frame_bytes: int = FRAME_BYTES,
                   bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write a record for every row of ``pages`` (``page_id``, ``url``, ``html``) into bundles under
    ``folder`` (a URI that all executors reach) and return the committed index (record_id, bundle,
    frame, offset, length).

    NULL html is an empty payload, NULL url an empty target; rows that repeat a page id give one
    record each under one record id; an empty table gives no bundle and an empty index.
    """
    spark = pages.sparkSession
    target = _uri(folder).rstrip("/")

    def run(batches):
        store, base = _file_system(target)
        writer, name, rows = None, "", []
        for batch in batches:
            page, url, payload, refers = batch.columns
            for i in range(batch.num_rows):
                if writer is None:
                    name = f"bundle-{uuid.uuid4().hex}.warc.zst"
                    store.create_dir(f"{base}/bundles", recursive=True)
                    stream = store.open_output_stream(f"{base}/bundles/{name}", compression=None)
                    writer = BundleWriter(stream, frame_bytes)
                key, to = page[i].as_py(), refers[i].as_py()
                record = make_record(key, url[i].as_py(), payload[i].as_py(), to, to is not None)
                rows.append((record_id(key), name, *writer.add(record)))
                if writer.size >= bundle_bytes:
                    writer.close()
                    writer = None
            if len(rows) > 10_000:
                yield _index_batch(rows)
                rows = []
        if writer is not None:
            writer.close()
        yield _index_batch(rows)

    map_arrow(with_revisits(pages, min_revisit), run, _INDEX).write.parquet(f"{target}/index")
    return spark.read.schema(_INDEX).parquet(f"{target}/index")


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 5
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                      names=["record_id", "bundle", "frame", "offset", "length"])


_RECORD = "record_id string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"


#: Bytes of records that a task reads back, about.
READ_BYTES = 32 << 20


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the committed bundles, frame by frame, by tasks of about :data:`READ_BYTES` bytes of
    records (runs of frames of a bundle, so large bundles are read by several): id, page, target, type, and the length
    and SHA-256 of the full payload (computed from a response's payload and held against its header;
    a revisit's from its header) and the page that a revisit refers to."""
    target = _uri(folder).rstrip("/")
    index = spark.read.schema(_INDEX).parquet(f"{target}/index")
    size = index.agg(F.sum(F.col("length").cast("long"))).first()[0] or 0
    frames = index.select("bundle", "frame").distinct().repartitionByRange(max(1, -(-size // READ_BYTES)), "bundle", "frame")

    def run(batches):
        store, base = _file_system(target)
        reader, opened = None, None
        for batch in batches:
            for bundle, frame in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bundle != opened:
                    reader, opened = BundleReader(store.open_input_file(f"{base}/bundles/{bundle}")), bundle
                yield _record_batch([_facts(f, body) for f, body, _, _ in parse_records(reader.frame(frame))])

    return map_arrow(frames.sortWithinPartitions("bundle", "frame"), run, _RECORD)


def _facts(fields: dict[str, str], body: bytes) -> tuple:
    digest, size = fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["X-Payload-Length"])
    if fields["WARC-Type"] == "response":
        found = hashlib.sha256(body).hexdigest()
        if (found, len(body)) != (digest, size):
            raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    page, to = fields["X-Page-Id"], fields.get("X-Refers-To-Page-Id")
    return (fields["WARC-Record-ID"], int(page) if page else None, fields["WARC-Target-URI"], fields["WARC-Type"],
            size, digest, int(to) if to else None)


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = [c.split()[0] for c in _RECORD.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def read_record(folder: str, bundle: str, frame: int, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of one record by its index entry: opens one frame only."""
    store, base = _file_system(_uri(folder).rstrip("/"))
    with store.open_input_file(f"{base}/bundles/{bundle}") as stream:
        data = BundleReader(stream).frame(frame)[offset:offset + length]
    fields, payload, _, _ = next(parse_records(data))
    return fields, payload
