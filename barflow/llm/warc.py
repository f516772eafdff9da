"""WARC archives as a Spark data source (operator 1).

``spark.read.format("warc")`` plans one partition for each file range that the writer's index
lists, or each whole file where there is none; it takes predicates on ``record_type`` and on header
columns, parses a record's headers first, and neither inflates nor decodes a payload that no kept
row or selected column needs. ``df.write.format("warc")`` writes one gzip member for each record.
"""

from __future__ import annotations

import base64
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage,
)

from .common import open_uri, shared_dir, written

SCHEMA = "record_id string, record_type string, target_uri string, payload_digest string, payload_bytes long, refers_to string, payload binary"
_ARROW = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.string()), ("payload", pa.binary())])
#: Header fields of the columns; the length field is an extension, as a revisit carries no payload.
FIELDS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "payload_digest": "WARC-Payload-Digest", "payload_bytes": "X-Payload-Length", "refers_to": "WARC-Refers-To"}
#: Compressed bytes of one file range at most (one record at least), and records of an Arrow batch.
FILE_BYTES, BATCH_ROWS, BATCH_BYTES = 64 << 20, 512, 8 << 20
_GZIP = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"


def _clean(value: str) -> str:
    """A header value cannot hold line ends."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def member(record: dict, level: int = 3) -> bytes:
    """One record as a gzip member whose extra field tells both its lengths, so readers can step over it."""
    payload = record["payload"] if record["record_type"] != "revisit" else None
    body = payload or b""
    head = ["WARC/1.1", f"WARC-Date: {_DATE}"]
    for column, field in FIELDS.items():
        if record.get(column) is not None:
            v = str(record[column])
            head.append(f"{field}: " + ("sha1:" + base64.b32encode(bytes.fromhex(v)).decode() if column == "payload_digest" else _clean(v)))
    if payload is None and record["record_type"] == "revisit":
        head.append(f"WARC-Profile: {_PROFILE}")
    head += ["Content-Type: application/octet-stream", f"Content-Length: {len(body)}", "", ""]
    plain = "\r\n".join(head).encode() + body + b"\r\n\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    packed = z.compress(plain) + z.flush()
    size = len(_GZIP) + 2 + 12 + len(packed) + 8
    return _GZIP + struct.pack("<H2sHII", 12, b"sl", 8, size & 0xFFFFFFFF, len(plain) & 0xFFFFFFFF) + packed + struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF)


def parse_head(plain: bytes) -> tuple[dict, int] | None:
    """Header fields by column and where the block starts; None if the head is not all there."""
    end = plain.find(b"\r\n\r\n")
    if end < 0:
        return None
    got = {}
    for line in plain[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        got[name.strip().lower()] = value.strip()
    row = {c: got.get(f.lower()) for c, f in FIELDS.items()}
    if (d := row["payload_digest"]) and d.startswith("sha1:"):
        try:
            row["payload_digest"] = base64.b32decode(d[5:]).hex()
        except ValueError:
            pass
    row["payload_bytes"] = int(row["payload_bytes"]) if row["payload_bytes"] else None
    row["content_length"] = int(got.get("content-length", 0))
    return row, end + 4


@dataclass
class FilePart(InputPartition):
    path: str
    start: int
    stop: int  # -1: the file's end


class WarcReader(DataSourceReader):
    def __init__(self, schema, options):
        self.columns = [f.name for f in schema.fields]
        self.path = options["path"]
        self.wants_payload = str(options.get("payload", "true")).lower() != "false"
        self.tests: list = []

    def pushFilters(self, filters):
        for f in filters:
            at = getattr(f, "attribute", None)
            if at and len(at) == 1 and at[0] in FIELDS and isinstance(f, (EqualTo, In, IsNotNull, StringStartsWith)):
                self.tests.append(f)
            else:
                yield f

    def _keeps(self, row: dict) -> bool:
        for f in self.tests:
            v = row[f.attribute[0]]
            if v is None or isinstance(f, EqualTo) and v != f.value or isinstance(f, In) and v not in f.value or isinstance(f, StringStartsWith) and not v.startswith(f.value):
                return False
        return True

    def partitions(self):
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path.removeprefix("file:"))
        found = where.get_file_info(fs.FileSelector(root, recursive=True)) if where.get_file_info(root).type == fs.FileType.Directory else [where.get_file_info(root)]
        scheme = self.path.split("://")[0] + "://" if "://" in self.path else ""
        files = {f.path: f.size for f in found if f.path.endswith((".warc", ".warc.gz"))}
        # The commit lists the files that count and where their records start.
        listed = [f for f in found if f.path.endswith(".committed")]
        if listed:
            out = []
            for f in listed:
                with where.open_input_file(f.path) as h:
                    for line in h.read().decode().splitlines():
                        name, *cuts = line.split("\t")
                        out += [FilePart(f"{scheme}{root.rstrip('/')}/{name}", int(a), int(b)) for a, b in zip(cuts, cuts[1:])]
            return out or [FilePart("", 0, 0)]
        return [FilePart(scheme + p, 0, -1) for p in sorted(files)] or [FilePart("", 0, 0)]

    def read(self, part: FilePart) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        rows, size = [], 0
        with open_uri(part.path, "rb") as f:
            for row in (self._packed(f, part) if part.path.endswith(".gz") else self._plain(f, part)):
                rows.append(row)
                size += len(row["payload"] or b"")
                if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield self._batch(rows)
                    rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        schema = pa.schema([_ARROW.field(c) for c in self.columns])
        return pa.RecordBatch.from_pydict({c: [r[c] for r in rows] for c in self.columns}, schema=schema)

    def _row(self, head: dict, payload) -> dict:
        return head | {"payload": payload}

    def _plain(self, f, part: FilePart):
        """Uncompressed records: unwanted blocks are stepped over by seeking."""
        at, buf = part.start, b""
        f.seek(at)
        while part.stop < 0 or at < part.stop:
            while (got := parse_head(buf)) is None:
                more = f.read(1 << 16)
                if not more:
                    return
                buf += more
                buf = buf.lstrip(b"\r\n") if not buf.startswith(b"WARC") else buf
            head, start = got
            n = head["content_length"]
            payload = None
            if self._keeps(head) and self.wants_payload and "payload" in self.columns and head["record_type"] != "revisit":
                while len(buf) < start + n:
                    buf += f.read(max(1 << 16, start + n - len(buf)))
                payload = buf[start:start + n]
            if len(buf) >= start + n:
                buf = buf[start + n:].lstrip(b"\r\n")
            else:
                f.seek(start + n - len(buf), 1)
                buf = b""
            at += start + n + 4
            if self._keeps(head):
                yield self._row(head, payload)

    def _packed(self, f, part: FilePart):
        """Gzip members: the head is inflated alone; a member's own length field leads to the next."""
        at = part.start
        while part.stop < 0 or at < part.stop:
            f.seek(at)
            fixed = f.read(24)
            if len(fixed) < 18:
                return
            known = fixed[:4] == _GZIP[:4] and fixed[12:14] == b"sl"
            size = struct.unpack("<I", fixed[16:20])[0] if known else 0
            z = zlib.decompressobj(31)
            plain, got, raw = b"", None, fixed
            while got is None:
                chunk = raw or f.read(4096)
                raw = b""
                if not chunk:
                    return
                plain += z.decompress(chunk)
                got = parse_head(plain)
                if got is None and z.eof:
                    return
            head, start = got
            keep = self._keeps(head)
            want = keep and self.wants_payload and "payload" in self.columns and head["record_type"] != "revisit"
            if want or not size:
                parts = [plain]
                while not z.eof:
                    chunk = f.read(1 << 16)
                    if not chunk:
                        break
                    parts.append(z.decompress(chunk))
                plain = b"".join(parts) if want else plain
                if not size:
                    at = f.tell() - len(z.unused_data)
            if size:
                at += size
            if keep:
                yield self._row(head, plain[start:start + head["content_length"]] if want else None)


@dataclass
class Files(WriterCommitMessage):
    lines: list


class WarcWriter(DataSourceArrowWriter):
    """One file for each task, under a name of the attempt's own; the commit lists those that count."""

    def __init__(self, options):
        self.path = options["path"].rstrip("/")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Files:
        name, f, at, cuts, last = f"part-{uuid.uuid4().hex}.warc.gz", None, 0, [0], 0
        for b in batches:
            for record in b.to_pylist():
                f = f or open_uri(f"{self.path}/{name}", "wb")
                at += f.write(member(record))
                if at - last >= FILE_BYTES:
                    cuts.append(at)
                    last = at
        if f:
            f.close()
        return Files(["\t".join(map(str, [name, *cuts, *([at] if at > cuts[-1] else [])]))] if f else [])

    def commit(self, messages) -> None:
        with open_uri(f"{self.path}/{uuid.uuid4().hex}.committed", "wb") as f:
            f.write("\n".join(x for m in messages if m for x in m.lines).encode())

    def abort(self, messages) -> None:
        """Files that no commit lists are not read."""


class WarcSource(DataSource):
    """Options: ``path``; ``payload`` = false leaves payloads out (null) whatever is selected."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return WarcReader(schema, self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    """Make format("warc") known to a session, with predicates pushed to the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def page_records(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Records to write for pages (page_id, url, html): first copies whole, further ones as revisits.

    Of pages whose payloads are equal and at least ``least_bytes`` long, that with the largest
    page_id is the response; rows that repeat this page_id are responses too. Pages without a
    page_id have records without an id and are responses. Null html is an empty payload. Copies
    are counted by digest before payloads move; hot digests are summed map-side.
    """
    p = pages.select("page_id", F.col("url").alias("target_uri"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("payload_digest", F.sha1("payload")).withColumn("payload_bytes", F.length("payload").cast("long"))
    many = (p.filter((F.col("payload_bytes") >= least_bytes) & F.col("page_id").isNotNull()).groupBy("payload_digest")
            .agg(F.max("page_id").alias("first_page"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    # Only ids and digests meet the copies' table; the payload is read in place, by a second scan.
    copies = written(p.select("page_id", "payload_digest", "payload_bytes").filter((F.col("payload_bytes") >= least_bytes) & F.col("page_id").isNotNull())
                     .join(many, "payload_digest").filter("page_id < first_page").select("page_id", "payload_digest", "first_page").distinct(), "warc-revisits")
    joined = p.join(copies, ["page_id", "payload_digest"], "left")
    revisit = F.col("first_page").isNotNull()
    uri = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    return joined.select(
        uri(F.col("page_id")).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), "target_uri",
        "payload_digest", "payload_bytes", F.when(revisit, uri(F.col("first_page"))).alias("refers_to"), F.when(~revisit, F.col("payload")).alias("payload"))


def archive_pages(pages: DataFrame, path: str | None = None, least_bytes: int = 1000) -> str:
    """Write pages as WARC files; returns their folder."""
    spark = pages.sparkSession
    register(spark)
    path = path or shared_dir(spark, "warc")
    page_records(pages, least_bytes).write.format("warc").mode("append").save(path)
    return path


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Records of an archive by page, with lengths and digests taken from the payloads where they are."""
    register(spark)
    r = spark.read.format("warc").load(path)
    number = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1).try_cast("long")
    whole = F.col("record_type") == "response"
    return r.select(
        number(F.col("record_id")).alias("page_id"), F.when(whole, F.length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(whole, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", number(F.col("refers_to")).alias("refers_to"))
