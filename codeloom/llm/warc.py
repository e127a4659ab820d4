"""WARC records in seekable Zstandard bundles: independent frames, a footer seek table, record offsets in an index.

A bundle is one file of the shared folder. Records are grouped into frames of
about FRAME_BYTES; each frame is compressed by itself; a skippable frame at the
end holds the seek table (the public "seekable format"), so a reader needs the
footer and one frame to fetch a record. The index maps a record's identifier to
its bundle, frame and the offset within the frame's plain bytes.

Of the rows with equal payloads of MIN_REVISIT bytes or more, that with the
largest id is written as a ``response``; the others are ``revisit`` records that
name it and hold no payload. Smaller payloads are always responses.

Cases: a null payload is empty; a null target is an empty WARC-Target-URI; a null id
is written as "None"; rows of one id each get their record, with their own payload, so
that a record is one of several of its name; an empty table writes
no bundle; payloads of any length are written whole, in a frame of their own if
long; further columns are not read, whatever their names. A task that is run again writes a bundle of
another name; the index only names bundles of the tasks that counted.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from codeloom.llm._spark import Scratch, new_path, parts, salted_join

MIN_REVISIT = 1000
FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 28
LEVEL = 3

#: Fixed values of the seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
DATE = "2024-01-01T00:00:00Z"


def record_bytes(record_id: str, kind: str, uri: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC/1.1 record; the payload's length and digest are those of the full payload."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:record:{record_id}>",
        f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + uri.replace("\r", " ").replace("\n", " "),
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:record:{refers_to}>"]
        payload = b""
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, where the next record begins) of the record at a position."""
    end = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:end].decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"no WARC record at {at}")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    size = int(headers["Content-Length"])
    block = data[end + 4 : end + 4 + size]
    if len(block) != size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
        raise ValueError(f"record at {at} is cut short")
    return headers, block, end + 8 + size


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable footer frame for (compressed, plain) sizes."""
    entries = b"".join(struct.pack("<II", *f) for f in frames)
    body = entries + struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and name of a path; one without a scheme is of the local file system, which must then be shared by all hosts."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Bundle:
    """Reads a bundle: frames, and records by frame and offset."""

    def __init__(self, path: str):
        files, name = open_path(path)
        self.file = files.open_input_file(name)
        size = self.file.size()
        count, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"{path} has no seek table")
        table = self.file.read_at(8 * count, size - 9 - 8 * count)
        self.frames, at = [], 0
        for i in range(count):
            packed, plain = struct.unpack_from("<II", table, 8 * i)
            self.frames.append((at, packed, plain))
            at += packed
        self._decoder = zstandard.ZstdDecompressor()

    def frame(self, number: int) -> bytes:
        at, packed, plain = self.frames[number]
        return self._decoder.decompress(self.file.read_at(packed, at), max_output_size=plain)

    def record(self, number: int, offset: int) -> tuple[dict[str, str], bytes]:
        headers, block, _ = parse_record(self.frame(number), offset)
        return headers, block

    def close(self) -> None:
        self.file.close()


class _Writer:
    def __init__(self, folder: str):
        self.folder, self.out, self.path = folder, None, ""

    def _open(self) -> None:
        self.path = f"{self.folder}/{uuid.uuid4().hex}.warc.zst"
        files, name = open_path(self.path)
        files.create_dir(name.rsplit("/", 1)[0], recursive=True)
        self.out, self.frames, self.plain, self.size = files.open_output_stream(name, compression=None), [], bytearray(), 0

    def add(self, record: bytes) -> tuple[str, int, int]:
        """(bundle, frame, offset) of the record."""
        if self.out is None:
            self._open()
        elif self.plain and len(self.plain) + len(record) > FRAME_BYTES:
            self._frame()
            if self.size > BUNDLE_BYTES:
                self.close()
                self._open()
        at = self.path, len(self.frames), len(self.plain)
        self.plain += record
        return at

    def _frame(self) -> None:
        packed = zstandard.ZstdCompressor(level=LEVEL).compress(bytes(self.plain))
        self.out.write(packed)
        self.frames.append((len(packed), len(self.plain)))
        self.size += len(packed)
        self.plain = bytearray()

    def close(self) -> None:
        if self.out is not None:
            if self.plain:
                self._frame()
            self.out.write(seek_table(self.frames))
            self.out.close()
            self.out = None


def plan(s: Scratch, pages: DataFrame, id_col: str, payload_col: str, uri_col: str) -> DataFrame:
    """(id, uri, payload, refers_to): what each record will hold; refers_to is null for responses."""
    payload = F.coalesce(F.encode(F.col(payload_col), "UTF-8"), F.lit("").cast("binary"))
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(uri_col), F.lit("")).alias("uri"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.when(F.octet_length("payload") >= MIN_REVISIT, F.unhex(F.sha1("payload"))))
    digests = s.cut(rows.where("digest is not null").select("id", "digest"), "digests")
    repeated = digests.groupBy("digest").agg(F.max("id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # By id and payload: rows of one id may hold several payloads.
    revisits = salted_join(digests, repeated, ["digest"], "id").where("id <> first_id").select("id", "digest", F.col("first_id").alias("refers_to")).distinct()
    return rows.join(s.cut(revisits, "revisits"), ["id", "digest"], "left").select("id", "uri", "payload", "refers_to")


def write(pages: DataFrame, folder: str, id_col: str = "page_id", payload_col: str = "html", uri_col: str = "url") -> DataFrame:
    """Writes the bundles; the index: id, bundle, frame, offset, length of each record."""
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = _Writer(folder)
        for batch in batches:
            got = []
            for record, uri, payload, refers in zip(*(c.to_pylist() for c in batch.columns)):
                digest = hashlib.sha1(payload).hexdigest()
                made = record_bytes(str(record), "response" if refers is None else "revisit", uri, payload, digest, None if refers is None else str(refers))
                got.append((*writer.add(made), len(made)))
            if got:
                bundle, frame, offset, length = zip(*got)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bundle), pa.array(frame, pa.int32()), pa.array(offset, pa.int64()), pa.array(length, pa.int64())], ["id", "bundle", "frame", "offset", "length"])
        writer.close()

    with Scratch() as s:
        planned = plan(s, pages, id_col, payload_col, uri_col)
        index = planned.mapInArrow(run, f"id {kind}, bundle string, frame int, offset long, length long")
        return s.keep(s.cut(index, "warc-index")).withColumnRenamed("id", id_col)


def read(index: DataFrame, id_col: str = "page_id") -> DataFrame:
    """The records of an index, read from their bundles: id, record_type, uri, payload_digest, payload_bytes, refers_to, payload.

    payload is null for revisits. Each frame is read once: the index is dealt out
    by bundle and frame.
    """
    kind = index.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, path, number, plain = None, None, None, b""
        for batch in batches:
            rows = []
            for record, at, frame, offset in zip(*(c.to_pylist() for c in batch.columns)):
                if at != path:
                    if bundle:
                        bundle.close()
                    bundle, path, number = Bundle(at), at, None
                if frame != number:
                    number, plain = frame, bundle.frame(frame)
                headers, block, _ = parse_record(plain, offset)
                if headers["WARC-Record-ID"] != f"<urn:record:{record}>":
                    raise ValueError(f"{at}: frame {frame}, offset {offset} is not record {record}")
                revisit = headers["WARC-Type"] == "revisit"
                digest, size = headers["WARC-Payload-Digest"].removeprefix("sha1:"), int(headers["WARC-Payload-Length"])
                if not revisit and (len(block) != size or hashlib.sha1(block).hexdigest() != digest):
                    raise ValueError(f"{at}: record {record} does not match its digest")
                rows.append((record, headers["WARC-Type"], headers["WARC-Target-URI"], digest, size, headers["WARC-Refers-To"][12:-1] if revisit else None, None if revisit else block))
            if rows:
                columns = list(zip(*rows))
                kinds = [batch.column(0).type, pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["id", "record_type", "uri", "payload_digest", "payload_bytes", "refers_to", "payload"])
        if bundle:
            bundle.close()

    rows = index.select(F.col(id_col).alias("id"), "bundle", "frame", "offset")
    dealt = rows.repartition(parts(index), "bundle", F.expr("frame div 16")).sortWithinPartitions("bundle", "frame", "offset")
    schema = f"id {kind}, record_type string, uri string, payload_digest string, payload_bytes long, refers_to string, payload binary"
    return dealt.mapInArrow(run, schema).withColumn("refers_to", F.col("refers_to").cast(kind)).withColumnRenamed("id", id_col)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes pages as bundles under folder (by default a new one of the shared folder) and reads them back."""
    return read(write(pages, folder or new_path(pages.sparkSession, "warc")))
