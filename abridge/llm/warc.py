"""WARC archives as a PySpark data source: writer with revisit records, header-first reader.

``spark.read.format("warc").load(folder)`` plans a partition for each archive file and takes equality
filters on the record type and on header columns. Headers are parsed first: a record that fails a filter, or
whose payload no column asks for, is skipped by the length in its gzip header without being inflated further.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In,
                                    InputPartition, WriterCommitMessage)

from abridge.llm.common import text_of

SCHEMA = ("record_type string, record_id string, target_uri string, date string, payload_digest string, "
          "refers_to string, payload_length long, payload binary")
HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI",
           "date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ROLL_BYTES = 64 << 20  # an archive file is closed when it is larger
READ_BYTES = 1 << 20
HEAD_BYTES = 4096      # inflated at first, for the headers


def _filesystem(path: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def make_record(row: dict) -> bytes:
    """One record as a gzip member whose header holds the member's length (extra field "sl")."""
    payload = row["payload"] or b""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {row['payload_length']}\r\n\r\n").encode()
    block = http + (payload if row["record_type"] == "response" else b"")
    head = ["WARC/1.1"] + [f"{h}: {_clean(row[c])}" for c, h in HEADERS.items() if row[c] is not None]
    if row["record_type"] == "revisit":
        head.append(f"WARC-Profile: {PROFILE}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    data = "\r\n".join(head).encode() + block + b"\r\n\r\n"
    z = zlib.compressobj(4, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    start = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, 24 + len(body) + 8, len(data))
    return start + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _headers(data: bytes) -> tuple[dict[str, str], int] | None:
    """Header fields, and the place where the block begins; None if ``data`` is too short."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    lines = data[:end].decode("utf-8").split("\r\n")
    return dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:]), end + 4


def _inflate(member: bytes, least: int) -> bytes:
    """At least ``least`` bytes of a member (all of it if it is shorter)."""
    return zlib.decompressobj(31).decompress(member, least)


@dataclass
class ArchiveFile(InputPartition):
    path: str


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema):
        self.path, self.columns = path, [f.name for f in schema.fields]
        self.tests: list[tuple[str, frozenset]] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.tests.append((HEADERS[f.attribute[0]], frozenset(f.value if isinstance(f, In) else [f.value])))
            else:
                yield f

    def partitions(self):
        from pyarrow import fs
        store, root = _filesystem(self.path)
        files = store.get_file_info(fs.FileSelector(root, recursive=False))
        return [ArchiveFile(f.path) for f in sorted(files, key=lambda f: f.path) if f.path.endswith(".warc.gz")]

    def read(self, partition: ArchiveFile | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        store, _ = _filesystem(self.path)
        rows: list[dict] = []
        held = 0
        with store.open_input_stream(partition.path, compression=None, buffer_size=READ_BYTES) as f:
            while head := f.read(24):
                if head[:4] != b"\x1f\x8b\x08\x04" or head[12:14] != b"sl":
                    raise ValueError(f"{partition.path}: a member without the length field")
                member = head + f.read(struct.unpack("<I", head[16:20])[0] - 24)
                row = self._row(member)
                if row is not None:
                    rows.append(row)
                    held += len(row.get("payload") or b"")
                if len(rows) >= 4096 or held >= READ_BYTES * 8:
                    yield self._batch(rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _row(self, member: bytes) -> dict | None:
        data, size = b"", HEAD_BYTES
        while (found := _headers(data)) is None:
            data, size = _inflate(member, size), size * 4
        h, at = found
        if any(h.get(name) not in values for name, values in self.tests):
            return None
        row = {c: h.get(name) for c, name in HEADERS.items()}
        block = int(h["Content-Length"])
        if {"payload", "payload_length"} & set(self.columns):
            while (http := _headers(data[at:])) is None:
                data, size = _inflate(member, size), size * 4
            row["payload_length"] = int(http[0]["Content-Length"])
            if "payload" in self.columns and h["WARC-Type"] == "response":
                data = _inflate(member, at + block)
                row["payload"] = data[at + http[1]:at + block]
        return row

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        types = {"payload": pa.binary(), "payload_length": pa.int64()}
        return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], types.get(c, pa.string()))
                                           for c in self.columns], names=self.columns)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Tasks write under temporary names; the commit renames what the successful attempts wrote."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = _filesystem(self.path)
        store.create_dir(root, recursive=True)
        files: list[str] = []
        out, size = None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    files.append(f"{root}/{uuid.uuid4().hex}.warc.gz")
                    out, size = store.open_output_stream(files[-1] + ".tmp", compression=None), 0
                data = make_record(row)
                out.write(data)
                size += len(data)
                if size >= ROLL_BYTES:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list[Written]) -> None:
        store, root = _filesystem(self.path)
        store.create_dir(root, recursive=True)
        for m in messages:
            for f in m.files if m else []:
                store.move(f + ".tmp", f)

    def abort(self, messages: list[Written]) -> None:
        store, _ = _filesystem(self.path)
        for m in messages:
            for f in m.files if m else []:
                store.delete_file(f + ".tmp")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], schema)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


def warc_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                 least_bytes: int = 1000, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Pages as records of :data:`SCHEMA`.

    Of pages with equal payloads (SHA-1 and length) of at least ``least_bytes``, the one with the largest id is a
    response and the others are revisits of it; smaller payloads are always responses. Null html is an empty
    payload, a null url is left out. Repeated ids stay records of their own; those that bear the kept id are all
    responses. Only digests are grouped; an empty table gives no record.
    """
    p = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("target_uri"),
                     text_of(html_col).cast("binary").alias("payload"))
    p = p.withColumns({"payload_length": F.octet_length("payload").cast("long"), "sha1": F.sha1("payload")})
    large = F.col("payload_length") >= least_bytes
    kept = (p.where(large).groupBy(F.col("sha1").alias("_s"), F.col("payload_length").alias("_l"))
            .agg(F.max("id").alias("kept"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"))
    p = p.join(kept, (F.col("sha1") == F.col("_s")) & (F.col("payload_length") == F.col("_l")), "left")
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    again = F.col("kept").isNotNull() & ~F.col("kept").eqNullSafe(F.col("id"))
    return p.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"), urn(F.col("id")).alias("record_id"),
        "target_uri", F.lit(date).alias("date"), F.concat(F.lit("sha1:"), "sha1").alias("payload_digest"),
        F.when(again, urn(F.col("kept"))).alias("refers_to"), "payload_length",
        F.when(~again, F.col("payload")).alias("payload"))


def write_warc(records: DataFrame, folder: str) -> None:
    """Write records of :data:`SCHEMA`; null payloads only for revisits."""
    records.sparkSession.dataSource.register(WarcSource)
    records.write.format("warc").mode("append").save(folder)


def read_warc(spark: SparkSession, folder: str, columns: str = SCHEMA) -> DataFrame:
    """Read archives; ``columns`` (a part of :data:`SCHEMA`) says what is parsed."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").schema(columns).load(folder)


def page_id(record_id: Column) -> Column:
    """The page id in a record id, null for none."""
    return F.nullif(F.regexp_extract(record_id, r"^<urn:page:(.*)>$", 1), F.lit("null")).cast("long")
