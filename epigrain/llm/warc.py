"""WARC archives as a Spark data source: reading with pushed-down header predicates, and writing with revisit records.

``spark.read.format("warc").option("path", folder)`` plans partitions from the archive files (small files share one). Predicates
on record_type, target_uri, refers_to, record_id and date are pushed to the reader, which parses a record's
headers first and leaves the payload of an unwanted record undecoded: each record is a gzip member of its own whose header
states the member's length (extra field "sl"), so such a member is stepped over; without that field it is inflated and dropped.
With ``option("payload", "false")`` payload bytes are hashed and counted but not returned.

``df.write.format("warc")`` writes one file per task and moves the files into place when the job commits; a repeated task leaves
only an uncommitted file that the commit does not name.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from .shared import new_folder, open_filesystem

READ_SCHEMA = (
    "record_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, "
    "payload_length long, payload binary"
)
WRITE_SCHEMA = "record_type string, record_id string, target_uri string, refers_to string, digest_hex string, payload_length long, payload binary"
#: Files below this many bytes are read together by one task.
PARTITION_BYTES = 64 << 20
CAPTURE_DATE = "2024-01-01T00:00:00Z"
_UNSAFE = re.compile(r"[^\x21-\x7e]")
_HEADERS = ("record_type", "record_id", "target_uri", "date", "refers_to", "payload_digest")


def bare_digest(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def quoted(text: str) -> str:
    """Characters that must not stand in a header line, as percent escapes of their UTF-8 bytes."""
    return _UNSAFE.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), text)


def member(data: bytes, level: int = 1) -> bytes:
    """A gzip member whose extra field "sl" holds its packed and plain lengths."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    total = 10 + 2 + 12 + len(body) + 8
    extra = struct.pack("<HccHII", 12, b"s", b"l", 8, total & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\x04\xff" + extra + body + tail


def record(record_type, record_id, target_uri, refers_to, digest_hex, payload_length, payload) -> bytes:
    """The bytes of one record. A revisit keeps the HTTP headers, whose Content-Length is that of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_length}\r\n\r\n".encode()
    block = http + (bytes(payload) if record_type == "response" and payload is not None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {CAPTURE_DATE}"]
    if target_uri is not None:
        lines.append(f"WARC-Target-URI: {quoted(target_uri)}")
    if refers_to is not None:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: {refers_to}")
    lines.append("Content-Type: application/http; msgtype=response")
    lines.append(f"WARC-Payload-Digest: sha1:{bare_digest(bytes.fromhex(digest_hex))}")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class WarcFiles(InputPartition):
    uris: tuple[str, ...]


def wanted(filters, header: dict) -> bool:
    """Whether a record's headers satisfy every pushed predicate (a null never does, but for IsNull and null-safe equality)."""
    for f in filters:
        x = header.get(f.attribute[0])
        if isinstance(f, EqualTo):
            ok = x is not None and x == f.value
        elif isinstance(f, EqualNullSafe):
            ok = x == f.value
        elif isinstance(f, In):
            ok = x is not None and x in f.value
        elif isinstance(f, IsNull):
            ok = x is None
        elif isinstance(f, IsNotNull):
            ok = x is not None
        else:
            ok = x is not None and x.startswith(f.value)
        if not ok:
            return False
    return True


def _header(head: bytes) -> tuple[dict, int]:
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    digest = fields.get("warc-payload-digest")
    out = {
        "record_type": fields.get("warc-type"),
        "record_id": fields.get("warc-record-id"),
        "target_uri": fields.get("warc-target-uri"),
        "date": fields.get("warc-date"),
        "refers_to": fields.get("warc-refers-to"),
        "payload_digest": digest.removeprefix("sha1:") if digest else None,
    }
    return out, int(fields.get("content-length", 0))


class _Members:
    """The gzip members of a file, with a window of it in memory."""

    def __init__(self, uri: str, window: int = 1 << 20):
        system, path = open_filesystem(uri)
        self.file = system.open_input_file(path)
        self.size, self.window, self.buffer, self.at = self.file.size(), window, b"", 0
        self.inflated = 0

    def _need(self, offset: int, n: int) -> bytes:
        """At least n bytes from offset, where the file has them."""
        end = self.at + len(self.buffer)
        if offset < self.at or min(offset + n, self.size) > end:
            self.buffer, self.at = self.file.read_at(max(n, self.window), offset), offset
        return self.buffer[offset - self.at :] if offset != self.at else self.buffer

    def records(self, filters) -> Iterator[tuple[dict, bytes]]:
        offset = 0
        while offset < self.size:
            start = self._need(offset, 32)
            if start[:3] != b"\x1f\x8b\x08":
                raise ValueError("not a gzip member; records must be compressed one by one")
            stated = struct.unpack_from("<I", start, 16)[0] if start[3] & 4 and start[12:14] == b"sl" else 0
            inflate = zlib.decompressobj(31)
            got, taken, plain = self._need(offset, stated or self.window), 0, b""
            while b"\r\n\r\n" not in plain and not inflate.eof:
                plain += inflate.decompress(inflate.unconsumed_tail or got, 2048)
                if not inflate.eof and not inflate.unconsumed_tail and b"\r\n\r\n" not in plain:
                    taken += len(got)
                    got = self.file.read_at(self.window, offset + taken)
                    if not got:
                        raise ValueError("the last record is cut short")
            head, _, block = plain.partition(b"\r\n\r\n")
            header, length = _header(head)
            keep = wanted(filters, header)
            if stated and not keep:
                offset += stated
                continue
            parts, kept = [block], len(block)
            while not inflate.eof:
                feed = inflate.unconsumed_tail or got
                part = inflate.decompress(feed, 1 << 20)
                if not inflate.eof and not inflate.unconsumed_tail:
                    taken += len(got)
                    got = self.file.read_at(self.window, offset + taken)
                    if not got and not part:
                        raise ValueError("the last record is cut short")
                if keep and kept < length:
                    parts.append(part)
                    kept += len(part)
            offset += stated or taken + len(got) - len(inflate.unused_data)
            if keep:
                self.inflated += 1
                yield header, b"".join(parts)[:length]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.with_payload = options.get("payload", "true").lower() == "true"
        self.filters: list = []

    def pushFilters(self, filters):
        for f in filters:
            simple = isinstance(f, (EqualTo, EqualNullSafe, In, IsNull, IsNotNull, StringStartsWith))
            # a response's digest is computed, so what its header says cannot decide
            if simple and f.attribute[0] in _HEADERS and f.attribute[0] != "payload_digest":
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        system, path = open_filesystem(self.path)
        scheme = self.path[: len(self.path) - len(path)] if "://" in self.path else ""
        found = system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
        files = sorted((f.path, f.size) for f in found if f.is_file and f.base_name.endswith(".warc.gz") and f.base_name[0] not in "_.")
        out, group, size = [], [], 0
        for name, n in files:
            if group and size + n > PARTITION_BYTES:
                out.append(WarcFiles(tuple(group)))
                group, size = [], 0
            group.append(scheme + name)
            size += n
        return [*out, WarcFiles(tuple(group))]

    def read(self, partition):
        names = [c.split()[0] for c in READ_SCHEMA.split(", ")]
        types = [pa.string()] * 6 + [pa.int64(), pa.binary()]
        rows: list[tuple] = []
        held = 0

        def batch():
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for uri in partition.uris:
            for header, block in _Members(uri).records(self.filters):
                http, _, payload = block.partition(b"\r\n\r\n")
                if header["record_type"] == "revisit":
                    stated = re.search(rb"(?im)^Content-Length:\s*(\d+)", http)
                    length, payload = int(stated[1]) if stated else None, None
                else:
                    length, digest = len(payload), bare_digest(hashlib.sha1(payload).digest())
                    said = header["payload_digest"] or ""
                    if re.fullmatch("[A-Z2-7]{32}", said) and said != digest:
                        raise ValueError(f"{uri}: {header['record_id']} does not match its digest")
                    header["payload_digest"] = digest
                rows.append((*[header[h] for h in _HEADERS], length, payload if self.with_payload else None))
                held += len(payload) if payload and self.with_payload else 100
                if held > 4_000_000:
                    yield batch()
                    rows.clear()
                    held = 0
        if rows:
            yield batch()


@dataclass
class WarcFile(WriterCommitMessage):
    partial: str | None
    final: str


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, batches):
        context = TaskContext.get()
        system, folder = open_filesystem(self.path)
        system.create_dir(folder, recursive=True)
        final = f"{folder}/records-{context.partitionId():06d}.warc.gz"
        partial = f"{folder}/_partial-{context.taskAttemptId()}-{uuid.uuid4().hex}"
        wrote = False
        with system.open_output_stream(partial, compression=None) as out:
            for batch in batches:
                columns = [batch.column(c.split()[0]).to_pylist() for c in WRITE_SCHEMA.split(", ")]
                for row in zip(*columns, strict=True):
                    out.write(member(record(*row)))
                    wrote = True
        if not wrote:
            system.delete_file(partial)
        return WarcFile(partial if wrote else None, final)

    def commit(self, messages):
        system, _ = open_filesystem(self.path)
        for m in messages:
            if m is not None and m.partial:
                system.move(m.partial, m.final)

    def abort(self, messages):
        system, _ = open_filesystem(self.path)
        for m in messages:
            if m is not None and m.partial:
                system.delete_file(m.partial)


class WarcDataSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return READ_SCHEMA

    def reader(self, schema: StructType):
        return WarcReader(self.options)

    def writer(self, schema: StructType, overwrite: bool):
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def page_records(pages: DataFrame, least: int = 0) -> DataFrame:
    """The record of each page row, in the writer's columns.

    Of equal payloads of at least ``least`` bytes the one with the smallest page_id is the response, the others revisit it; a
    revisit row carries no payload, so a payload that a third of all pages share is moved once. Null html is an empty payload;
    a null page_id counts as the largest; rows that repeat the smallest page_id and its payload are all responses; other columns
    are ignored. An empty table gives no record.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")
    )
    light = rows.select("page_id", "url", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("bytes"))
    firsts = (
        light.where(F.col("bytes") >= least)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
        .select("digest", "first_id")
    )
    revisits = light.join(firsts, "digest").where(~F.col("page_id").eqNullSafe(F.col("first_id")))
    again = revisits.select(F.coalesce(F.col("page_id").cast("string"), F.lit("null")).alias("key"), F.col("digest").alias("same")).distinct()
    keyed = rows.withColumn("digest", F.sha1("payload")).withColumn("key", F.coalesce(F.col("page_id").cast("string"), F.lit("null")))
    responses = keyed.join(again, (keyed.key == again.key) & (keyed.digest == again.same), "left_anti")

    def urn(c):
        return F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))

    first = responses.select(
        F.lit("response").alias("record_type"), urn(F.col("page_id")).alias("record_id"), F.col("url").alias("target_uri"),
        F.lit(None).cast("string").alias("refers_to"), F.col("digest").alias("digest_hex"),
        F.octet_length("payload").cast("long").alias("payload_length"), "payload",
    )
    later = revisits.select(
        F.lit("revisit").alias("record_type"), urn(F.col("page_id")).alias("record_id"), F.col("url").alias("target_uri"),
        urn(F.col("first_id")).alias("refers_to"), F.col("digest").alias("digest_hex"),
        F.col("bytes").alias("payload_length"), F.lit(None).cast("binary").alias("payload"),
    )
    return first.unionByName(later)


def write_warc(pages: DataFrame, folder: str, least: int = 0) -> None:
    register(pages.sparkSession)
    page_records(pages, least).write.format("warc").option("path", folder).mode("append").save()


def read_warc(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("path", folder).option("payload", str(payload).lower()).load()


def page_round_trip(pages: DataFrame) -> DataFrame:
    """Write archives below the shared folder and return what reading them back gives, one row per page."""
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    write_warc(pages, folder)

    def page_of(c):
        return F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")

    return read_warc(spark, folder, payload=False).select(
        page_of(F.col("record_id")).alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        page_of(F.col("refers_to")).alias("refers_to"),
    )
