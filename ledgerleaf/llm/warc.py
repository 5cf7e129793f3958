"""WARC archives as a Spark data source, read and written.

Reading plans one partition for each range of files of about split_bytes. Headers are parsed first: what the pushed
filters on them rule out is skipped, and its payload is never decoded. Each record is a gzip member of its own whose
extra field `sl` tells its length, so that a reader can seek over it; archives without that field are read through.
"""

from __future__ import annotations

import base64
import hashlib
import json
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

from ledgerleaf.llm.scratch import new_path

READ_SCHEMA = "record_type string, record_id string, uri string, date string, content_type string, payload_digest string, refers_to string, declared_bytes long, payload_bytes long, payload_sha1 string, payload binary"
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "uri": "warc-target-uri", "date": "warc-date", "content_type": "content-type", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to", "declared_bytes": "warc-payload-length"}
MANIFEST = "_manifest.json"
ROWS = 256


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


# ---- records ----


def record(kind: str, record_id: str, uri: str | None, date: str, payload: bytes | None, digest: str | None, length: int | None, refers_to: str | None) -> bytes:
    """A response with its payload after an HTTP header, or a revisit with the HTTP header alone."""
    n = length if length is not None else len(payload or b"")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode() + (payload or b"" if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {date}"]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {' '.join(uri.split())}")
    if digest is not None:
        lines.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {refers_to}"]
    lines += [f"WARC-Payload-Length: {n}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    """data as a gzip member that tells its own length and data's; the field is left out where 32 bits don't hold them."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    whole = 10 + 2 + 12 + len(body) + 8
    tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    if max(whole, len(data)) >> 32:
        return b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff" + body + tail
    return b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H2sHII", 12, b"sl", 8, whole, len(data)) + body + tail


def parsed(head: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    last = None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            out[last] = value.strip()
    return out


class Source:
    """A file's bytes from a place on, read in large steps."""

    def __init__(self, file: pa.NativeFile, at: int, step: int = 1 << 20):
        self.file, self.step, self.size = file, step, file.size()
        self.start, self.held = at, b""

    def peek(self, at: int, n: int) -> bytes:
        if at < self.start or at + n > self.start + len(self.held):
            if at + n > self.size:
                n = max(0, self.size - at)
            if not (self.start <= at and at + n <= self.start + len(self.held)):
                self.file.seek(at)
                self.start, self.held = at, self.file.read(max(n, self.step))
        return self.held[at - self.start : at - self.start + n]


def skip_length(head: bytes) -> int | None:
    """A member's whole length by its extra field, if it has one."""
    if len(head) < 12 or not head[3] & 4:
        return None
    at, end = 12, 12 + struct.unpack_from("<H", head, 10)[0]
    while at + 4 <= min(end, len(head)):
        name, n = head[at : at + 2], struct.unpack_from("<H", head, at + 2)[0]
        if name == b"sl" and n >= 4:
            return struct.unpack_from("<I", head, at + 4)[0]
        at += 4 + n
    return None


def head_of(data: bytes) -> int:
    """Where the header's text ends; -1 if it doesn't yet."""
    return data.find(b"\r\n\r\n")


def gzip_records(source: Source, at: int, end: int, wanted) -> Iterator[tuple[dict[str, str], bytes | None]]:  # noqa: ANN001
    """(headers, block) of the wanted records of members that start in [at, end)."""
    while at < min(end, source.size):
        window = source.peek(at, 1 << 14)
        inflate, data, fed = zlib.decompressobj(31), b"", 0
        while (cut := head_of(data)) < 0 and not inflate.eof:
            chunk = inflate.unconsumed_tail or source.peek(at + fed, 1 << 14)
            if not inflate.unconsumed_tail:
                fed += len(chunk)
            if not chunk:
                break
            data += inflate.decompress(chunk, 1 << 13)
        if cut < 0 or not data.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = parsed(data[:cut])
        known = skip_length(window)
        need = wanted(headers)
        if need or known is None:  # else the member is left undecoded
            parts = [data]
            while not inflate.eof:
                chunk = inflate.unconsumed_tail or source.peek(at + fed, 1 << 18)
                if not inflate.unconsumed_tail:
                    fed += len(chunk)
                if not chunk:
                    raise ValueError(f"the record at byte {at} is cut short")
                piece = inflate.decompress(chunk, 1 << 20)
                if need:
                    parts.append(piece)
            if need:
                yield headers, b"".join(parts)[cut + 4 :][: int(headers.get("content-length", 0))]
        at += known if known is not None else fed - len(inflate.unused_data)


def plain_records(source: Source, at: int, end: int, wanted) -> Iterator[tuple[dict[str, str], bytes | None]]:  # noqa: ANN001
    while at < min(end, source.size):
        n = 1 << 12
        while (cut := head_of(data := source.peek(at, n))) < 0 and len(data) == n:
            n *= 2
        if cut < 0 or not data.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = parsed(data[:cut])
        length = int(headers.get("content-length", 0))
        if wanted(headers):
            yield headers, source.peek(at + cut + 4, length)
        at += cut + 4 + length + 4


def first_member(source: Source, at: int, end: int) -> int:
    """The first place from `at` on where a gzip member with a WARC record starts; end if there is none before it."""
    while at < min(end, source.size):
        window = source.peek(at, 1 << 16)
        found = window.find(b"\x1f\x8b\x08")
        if found < 0:
            at += max(1, len(window) - 2)
            continue
        at += found
        try:
            if zlib.decompressobj(31).decompress(source.peek(at, 1 << 12), 16).startswith(b"WARC/"):
                return at
        except zlib.error:
            pass
        at += 1
    return end


# ---- reading ----


@dataclass
class Ranges(InputPartition):
    files: list[tuple[str, int, int, int]]  # path, first and last byte, its size


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload = options["path"], options.get("payload", "full")
        self.split = int(options.get("split_bytes", 64 << 20))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):  # noqa: ANN001, ANN201, N802
        """Takes what headers alone decide; the rest stays with Spark."""
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column in HEADERS and column != "declared_bytes" and isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith, StringContains, IsNotNull)):
                self.tests.append((column, type(f).__name__, None if isinstance(f, IsNotNull) else list(f.value) if isinstance(f, In) else f.value))
            else:
                yield f

    def wanted(self, headers: dict[str, str]) -> bool:
        for column, kind, value in self.tests:
            own = header(headers, column)
            if own is None or not {"IsNotNull": lambda: True, "EqualTo": lambda: own == value, "In": lambda: own in value, "StringStartsWith": lambda: own.startswith(value), "StringEndsWith": lambda: own.endswith(value), "StringContains": lambda: value in own}[kind]():
                return False
        return True

    def partitions(self) -> list[Ranges]:
        system, path = opened(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.Directory:
            listed = [i for i in system.get_file_info(fs.FileSelector(path, recursive=True)) if i.is_file and posixpath.basename(i.path)[:1] not in "_."]
            manifest = system.get_file_info(posixpath.join(path, MANIFEST))
            if manifest.is_file:  # files of failed attempts aren't in it
                with system.open_input_file(manifest.path) as f:
                    own = set(json.loads(f.read()))
                listed = [i for i in listed if posixpath.basename(i.path) in own]
        else:
            listed = [info] if info.is_file else []
        ranges, held, size = [], [], 0
        for i in sorted(listed, key=lambda i: i.path):
            cuts = range(0, i.size, self.split) if i.path.endswith(".gz") else [0] if i.size else []
            for lo in cuts:
                hi = min(i.size, lo + self.split) if i.path.endswith(".gz") else i.size
                if held and size + hi - lo > self.split:
                    ranges.append(Ranges(held))
                    held, size = [], 0
                held.append((i.path, lo, hi, i.size))
                size += hi - lo
        return [*ranges, Ranges(held)] if held else ranges or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.path)
        rows: list[tuple] = []
        held = 0
        for path, lo, hi, _ in partition.files:
            with system.open_input_file(path) as file:
                source = Source(file, lo)
                if path.endswith(".gz"):
                    found = gzip_records(source, first_member(source, lo, hi) if lo else 0, hi, self.wanted)
                else:
                    found = plain_records(source, lo, hi, self.wanted)
                for headers, block in found:
                    rows.append(self.row(headers, block or b""))
                    held += len(rows[-1][-1] or b"")
                    if len(rows) >= ROWS or held > 8 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
        if rows:
            yield batch_of(rows)

    def row(self, headers: dict[str, str], block: bytes) -> tuple:
        payload = n = sha1 = None
        if headers.get("warc-type") != "revisit" and self.payload != "none":
            if "application/http" in headers.get("content-type", ""):
                block = block[block.find(b"\r\n\r\n") + 4 :]
            payload, n, sha1 = block if self.payload == "full" else None, len(block), hashlib.sha1(block).hexdigest()
        return (*(header(headers, c) for c in HEADERS), n, sha1, payload)


def header(headers: dict[str, str], column: str) -> str | int | None:
    value = headers.get(HEADERS[column])
    if value is None:
        return None
    if column == "declared_bytes":
        return int(value)
    if column == "payload_digest" and value.startswith("sha1:") and len(value) == 37:
        return base64.b32decode(value[5:]).hex()
    return value


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
    kinds = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in READ_SCHEMA.split(", ")]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


# ---- writing ----


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class Writer(DataSourceArrowWriter):
    """Rows (record_type, record_id, uri, date, payload, payload_digest, payload_bytes, refers_to). Each attempt writes files
    of its own; the manifest that the driver writes at the end names those of the attempts that count."""

    def __init__(self, options: dict):
        self.path, self.level = options["path"], int(options.get("level", 5))
        self.most = int(options.get("file_bytes", 256 << 20))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, path = opened(self.path)
        system.create_dir(path, recursive=True)
        files: list[str] = []
        out = None
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None or out.tell() > self.most:
                        if out:
                            out.close()
                        files.append(f"part-{uuid.uuid4().hex}.warc.gz")
                        out = system.open_output_stream(posixpath.join(path, files[-1]), compression=None)
                        info = b"software: ledgerleaf\r\nformat: WARC file version 1.1\r\n"
                        head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
                        out.write(member(head.encode() + info + b"\r\n\r\n", self.level))
                    data = record(row["record_type"], row["record_id"], row["uri"], row["date"], row["payload"], row["payload_digest"], row["payload_bytes"], row["refers_to"])
                    out.write(member(data, self.level))
        finally:
            if out:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, path = opened(self.path)
        system.create_dir(path, recursive=True)
        with system.open_output_stream(posixpath.join(path, MANIFEST), compression=None) as f:
            f.write(json.dumps(sorted(x for m in messages if m for x in m.files)).encode())

    def abort(self, messages: list[Written | None]) -> None:
        system, path = opened(self.path)
        for m in messages:
            for x in m.files if m else []:
                system.delete_file(posixpath.join(path, x))


class Warc(DataSource):
    """format("warc"). Options: path; reading: payload (full, digest or none), split_bytes; writing: level, file_bytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema) -> Reader:  # noqa: ANN001
        return Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> Writer:  # noqa: ANN001
        return Writer(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Warc)


def write_warc(records: DataFrame, path: str, **options: object) -> None:
    """Rows of (record_type, record_id, uri, date, payload, payload_digest, payload_bytes, refers_to) as archives in path."""
    register(records.sparkSession)
    records.select("record_type", "record_id", "uri", "date", "payload", "payload_digest", "payload_bytes", "refers_to").write.format("warc").options(path=path, **options).mode("append").save()


def read_warc(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """READ_SCHEMA rows of the archives in path. A revisit has no payload; with payload="digest" only its length and hash are kept."""
    register(spark)
    return spark.read.format("warc").options(path=path, **options).load()


def page_records(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Records for write_warc of pages (page_id, url, html): of equal payloads of at least `least` bytes that with the largest
    page_id is a response, the others revisit it.

    Null html is an empty payload. A page whose id is null, and pages that repeat the largest id, are responses."""
    base = pages.select("page_id", F.col("url").alias("uri"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    base = base.withColumn("payload_bytes", F.length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    narrow = base.select("page_id", "payload_bytes", "payload_digest").where(F.col("payload_bytes") >= least)
    kept = narrow.groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # only ids and hashes meet by hash, where a page of many copies is hot; pages meet them by id
    again = narrow.join(kept, ["payload_digest", "payload_bytes"]).where("page_id < kept").select("page_id", "payload_digest", "kept").distinct()
    out = base.join(again, ["page_id", "payload_digest"], "left")
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    revisit = F.col("kept").isNotNull()
    return out.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), name("page_id").alias("record_id"), "uri", F.lit("1970-01-01T00:00:00Z").alias("date"),
        F.when(~revisit, F.col("payload")).alias("payload"), "payload_digest", "payload_bytes", F.when(revisit, name("kept")).alias("refers_to"),
    )


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_warc(page_records(spark.read.parquet(f"{sf_dir}/pages.parquet")), path)
    found = read_warc(spark, path, payload="digest", split_bytes=16 << 20).where(F.col("record_type").isin("response", "revisit"))
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, 'urn:page:(-?[0-9]+)', 1) AS long)")
    return found.select(number("record_id").alias("page_id"), F.coalesce("payload_bytes", "declared_bytes").alias("payload_bytes"), F.coalesce("payload_sha1", "payload_digest").alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
k AS (SELECT page_id, html, octet_length(encode(html)) AS n, sha1(html) AS d FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id < max(page_id) OVER (PARTITION BY d, n) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id < max(page_id) OVER (PARTITION BY d, n) THEN max(page_id) OVER (PARTITION BY d, n) END AS refers_to
FROM k
"""
