"""WARC archives as a Spark data source: ``warc`` reads and writes folders of ``.warc.gz`` files.

Every record is a gzip member of its own that states its packed size in the header's
extra field, so a reader can go on to the next record without unpacking this one.
The reader plans one partition for each file, unpacks a record up to the end of its
headers, applies the predicates that Spark pushed down (equality and ``IN`` on
``record_type`` and the header columns) and unpacks the payload only if the record
passes and the schema that was asked for has the payload. Files roll at
``file_bytes``, so a partition has a bounded size.

``write_pages`` stores equal payloads once: the record with the largest id is the
response and the others are revisits that refer to it. Null payloads count as empty,
rows without an id and payloads under ``least_bytes`` are always responses, and rows
that repeat the id of the response are responses too. Control characters in a url are
percent-encoded; a null url leaves its header out.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In,
                                    InputPartition, WriterCommitMessage)
from pyspark.sql.types import StructType

from sparkgauge.llm.common import column, hot_keys, join_by_key, stored

FILE_BYTES = 64 << 20
BATCH_BYTES = 4 << 20
MANIFEST = "_manifest.json"
SCHEMA = ("record_id string, record_type string, target_uri string, refers_to string, payload_digest string, "
          "payload_bytes long, payload binary")
# Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri",
           "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
GZIP_START = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff"
BLANK = b"\r\n\r\n"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(record_id: str, record_type: str, uri: str | None, refers_to: str | None, payload: bytes, date: str) -> bytes:
    """A WARC record; a revisit keeps the HTTP headers of the payload and leaves the payload out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if record_type == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}",
            f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", "Content-Type: application/http; msgtype=response"]
    if uri is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri))
    if record_type == "revisit":
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}"]).encode() + BLANK + block + BLANK


def packed(content: bytes, level: int) -> bytes:
    """A gzip member whose extra field SL holds its own size and the size of its content."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(content) + squeeze.flush()
    extra = b"SL" + struct.pack("<HQ", 8, len(GZIP_START) + 14 + len(body) + 8)
    return GZIP_START + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(content), len(content) & 0xFFFFFFFF)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


@dataclass
class FilePart(InputPartition):
    path: str


class WarcSource(DataSource):
    """Options: ``path``; for writing ``file_bytes``, ``level`` and ``date``; for reading ``verify``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options)


class WarcWriter(DataSourceArrowWriter):
    """Each task writes files with names of its own; the manifest of the commit names those that count."""

    def __init__(self, options):
        self.path = options["path"]
        self.file_bytes = int(options.get("file_bytes", FILE_BYTES))
        self.level = int(options.get("level", 6))
        self.date = options.get("date", "1970-01-01T00:00:00Z")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        where, root = arrow_fs.FileSystem.from_uri(self.path)
        where.create_dir(root, recursive=True)
        files, out, size = [], None, 0
        for batch in iterator:
            for row in _rows(batch):
                if out is None:
                    files.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, size = where.open_output_stream(f"{root}/{files[-1]}", compression=None), 0
                size += out.write(packed(record(row["record_id"], row["record_type"], row["target_uri"], row["refers_to"],
                                                row["payload"] or b"", self.date), self.level))
                if size >= self.file_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages) -> None:
        where, root = arrow_fs.FileSystem.from_uri(self.path)
        where.create_dir(root, recursive=True)
        with where.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps(sorted(f for m in messages if m for f in m.files)).encode())

    def abort(self, messages) -> None:
        where, root = arrow_fs.FileSystem.from_uri(self.path)
        for name in (f for m in messages if m for f in m.files):
            where.delete_file(f"{root}/{name}")


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for at in range(0, batch.num_rows, 64):
        yield from batch.slice(at, 64).to_pylist()


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options):
        self.path = options["path"]
        self.names = [f.name for f in schema.fields]
        self.verify = options.get("verify", "false").lower() == "true"
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Keep equality and IN on header columns; Spark applies the rest."""
        for f in filters:
            values = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else None
            if values is None or len(f.attribute) != 1 or f.attribute[0] not in HEADERS:
                yield f
            else:
                name = f.attribute[0]
                self.wanted[name] = set(values) & self.wanted.get(name, set(values))

    def partitions(self) -> list[FilePart]:
        where, root = arrow_fs.FileSystem.from_uri(self.path)
        if where.get_file_info(f"{root}/{MANIFEST}").type == arrow_fs.FileType.File:
            with where.open_input_stream(f"{root}/{MANIFEST}") as f:
                names = json.loads(f.read())
        else:
            names = sorted(x.base_name for x in where.get_file_info(arrow_fs.FileSelector(root)) if x.base_name.endswith(".warc.gz"))
        return [FilePart(f"{root}/{n}") for n in names] or [FilePart("")]

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        where, _ = arrow_fs.FileSystem.from_uri(self.path)
        rows, held = [], 0
        with where.open_input_file(partition.path) as f:
            for row in self._records(f):
                rows.append(row)
                held += 200 + len(row.get("payload") or b"")
                if held >= BATCH_BYTES:
                    yield self._batch(rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds.get(n, pa.string())) for n in self.names], self.names)

    def _records(self, f) -> Iterator[dict]:
        at, end = 0, f.size()
        while at < end:
            f.seek(at)
            unpack, got = zlib.decompressobj(31), b""
            piece = f.read(4096)
            start, size = piece[:24], _member_size(piece)
            while BLANK not in got and piece:  # headers first
                got += unpack.decompress(piece, 8192)
                piece = unpack.unconsumed_tail or (f.read(4096) if not unpack.eof else b"")
            head, block = got.split(BLANK, 1) if BLANK in got else (got, b"")
            fields = _fields(head)
            row = {name: _bare(fields.get(header)) for name, header in HEADERS.items()}
            passes = all(row[name] in values for name, values in self.wanted.items())
            whole = passes and ("payload" in self.names or self.verify) and row["record_type"] != "revisit"
            if not start.startswith(b"\x1f\x8b"):
                raise ValueError(f"no gzip member at byte {at}")
            while (whole or not size or BLANK not in block and not unpack.eof) and not unpack.eof:
                if not piece and not (piece := f.read(1 << 16)):
                    raise ValueError(f"the record at byte {at} is cut short")
                block += unpack.decompress(piece)
                piece = unpack.unconsumed_tail
            at = at + size if size else f.tell() - len(unpack.unused_data)
            if passes:
                http, _, payload = block.partition(BLANK)
                row["payload_bytes"] = int(_fields(http).get("content-length", 0))
                if whole:
                    row["payload"] = payload[:row["payload_bytes"]]
                    if self.verify and sha1_base32(row["payload"]) != row["payload_digest"]:
                        raise ValueError(f"the payload of {row['record_id']} doesn't have the digest in its header")
                yield row


def _member_size(start: bytes) -> int:
    """Size of the gzip member from its extra field; 0 for archives without it."""
    if len(start) >= 24 and start[3] & 4 and start[12:14] == b"SL":
        return struct.unpack_from("<Q", start, 16)[0]
    return 0


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _bare(value: str | None) -> str | None:
    """A header's value without angle brackets or the name of the hash."""
    if value is None:
        return None
    return value[1:-1] if value.startswith("<") and value.endswith(">") else value.removeprefix("sha1:")


def write_pages(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> None:
    """Write one record for each page; equal payloads of at least ``least_bytes`` are stored once."""
    spark = pages.sparkSession
    spark.dataSource.register(WarcSource)
    payload = F.coalesce(column(html).cast("binary"), F.lit(b""))
    rows = pages.select(column(page_id).alias("page_id"), column(url).alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumn("same", F.when(F.length("payload") >= least_bytes, F.unhex(F.sha1("payload"))))
    keys = stored(rows.select("page_id", "same"), "warc-keys")
    groups = keys.filter("same is not null").groupBy("same").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    hot = stored(hot_keys(keys, "same"), "warc-hot")
    found = join_by_key(rows, groups.select("same", "first_id"), "same", hot)
    revisit = F.coalesce(F.col("page_id") != F.col("first_id"), F.lit(False))
    found.select(
        F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none"))).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), "target_uri",
        F.when(revisit, F.concat(F.lit("urn:page:"), F.col("first_id").cast("string"))).alias("refers_to"), "payload",
    ).write.format("warc").mode("append").save(path)


def read_archives(spark: SparkSession, path: str, payload: bool = True, verify: bool = False) -> DataFrame:
    """Records of a folder; without ``payload`` none is unpacked beyond its headers."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    schema = SCHEMA if payload else SCHEMA.rpartition(",")[0]
    return spark.read.format("warc").schema(schema).option("verify", str(verify).lower()).load(path)
