"""WARC archives as a data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

The reader plans partitions of whole files, parses a record's headers first, tests the pushed filters
on them and decodes a payload only if the record passes and the query asks for the column. Archives
are written with one gzip member per record whose extra field ``sl`` holds the member's lengths, so
that what isn't wanted is skipped without being inflated; archives of others, compressed by record or
not, are read, too.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
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

from .common import scratch_path, table

#: Columns of a record and the headers they come from; ``payload_length`` is the HTTP header Content-Length.
HEADERS = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
}
SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in HEADERS]
    + [
        T.StructField("payload_length", T.LongType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("digest_matches", T.BooleanType()),
    ]
)
#: Columns for which a record's block has to be decoded to its end.
DEEP = frozenset(("payload", "digest_matches"))
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEAD = 1 << 14  # bytes read of a record before it is known whether more is wanted


def file_system(path: str):
    from pyarrow import fs

    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def sha1_base32(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


#: Lengths from here on don't fit into the extra field of a member.
LENGTH_LIMIT = 1 << 32


def member(record: bytes, level: int = 6) -> bytes:
    """A gzip member with its own and the record's length in the extra field ``sl``, if they fit into it."""
    press = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = press.compress(record) + press.flush()
    size = 24 + len(body) + 8
    if max(size, len(record)) < LENGTH_LIMIT:
        head = struct.pack("<4BIBBH2sHII", 31, 139, 8, 4, 0, 0, 255, 12, b"sl", 8, size, len(record))
    else:
        head = struct.pack("<4BIBB", 31, 139, 8, 0, 0, 0, 255)
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(row: dict) -> bytes:
    """A response with its payload, or a revisit with the HTTP headers alone."""
    payload = (row["payload"] or b"") if row["record_type"] == "response" else b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_length']}\r\n\r\n"
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {_clean(row['record_id'])}"]
    if row["target_uri"] is not None:
        lines.append(f"WARC-Target-URI: {_clean(row['target_uri'])}")
    lines += [f"WARC-Date: {row['date']}", f"WARC-Payload-Digest: sha1:{row['payload_digest']}"]
    if row["record_type"] == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_clean(row['refers_to'])}"]
    block = http.encode() + payload
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_headers(raw: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in raw.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            out.setdefault(name.strip().lower().decode("latin-1"), value.strip().decode("utf-8", "replace"))
    return out


class _Plain:
    """The record that begins here in an archive that isn't compressed."""

    def __init__(self, f, begin: int):
        self.f, self.begin, self.raw = f, begin, b""

    def upto(self, n: int) -> bytes:
        if n > len(self.raw):
            self.f.seek(self.begin + len(self.raw))
            self.raw += self.f.read(n - len(self.raw))
        return self.raw

    def end(self, length: int) -> int:
        return self.begin + length


class _Member:
    """The record in the gzip member that begins here; inflated as far as it is asked for."""

    def __init__(self, f, begin: int, head: bytes):
        self.f, self.begin, self.at = f, begin, begin
        self.zip, self.rest, self.parts, self.size = zlib.decompressobj(31), b"", [], 0
        has_length = len(head) >= 24 and head[3] & 4 and head[12:14] == b"sl"
        self.length = struct.unpack("<I", head[16:20])[0] if has_length else 0

    def _more(self, most: int) -> bool:
        if self.zip.eof:
            return False
        if not self.rest:
            self.f.seek(self.at)
            self.rest = self.f.read(_HEAD)
            self.at += len(self.rest)
            if not self.rest:
                raise ValueError(f"the archive ends inside the record at byte {self.begin}")
        part = self.zip.decompress(self.rest, most)
        self.rest = self.zip.unconsumed_tail
        self.parts.append(part)
        self.size += len(part)
        return True

    def upto(self, n: int) -> bytes:
        while self.size < n and self._more(max(1 << 12, n - self.size)):
            pass
        if len(self.parts) > 1:
            self.parts = [b"".join(self.parts)]
        return self.parts[0] if self.parts else b""

    def end(self, length: int) -> int:
        if self.length:
            return self.begin + self.length
        while self._more(1 << 20):
            self.parts, self.size = [], 0
        return self.at - len(self.zip.unused_data)


def read_records(f, wanted, deep: bool):
    """``headers, http, payload`` of the records of a file for whose headers wanted(headers) holds.

    http and payload are None, and the block isn't read to its end, unless deep.
    """
    f.seek(0)
    at, size = 0, f.size()
    while at < size:
        f.seek(at)
        head = f.read(24)
        if not head.strip(b"\r\n"):
            at += len(head)
            continue
        at += len(head) - len(head.lstrip(b"\r\n"))
        f.seek(at)
        head = f.read(24)
        source = _Member(f, at, head) if head[:2] == b"\x1f\x8b" else _Plain(f, at)
        n = 1 << 10
        while (cut := source.upto(n).find(b"\r\n\r\n")) < 0:
            if len(source.upto(n)) < n:
                raise ValueError(f"no end of the headers of the record at byte {at}")
            n *= 2
        headers = parse_headers(source.upto(n)[:cut])
        begin, length = cut + 4, int(headers.get("content-length", 0))
        if wanted(headers):
            http, payload = {}, None
            if headers.get("content-type", "").startswith("application/http"):
                n = begin + min(length, 1 << 10)
                while (cut := source.upto(n).find(b"\r\n\r\n", begin, begin + length)) < 0 and n < begin + length:
                    n = min(2 * n, begin + length)
                http = parse_headers(source.upto(n)[begin : cut if cut >= 0 else n])
                start = cut + 4 if cut >= 0 else begin + length
            else:
                start = begin
            if deep:
                payload = source.upto(begin + length)[start : begin + length]
            yield headers, http, payload
        at = source.end(begin + length)


@dataclass
class Files(InputPartition):
    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.columns = [f.name for f in schema.fields]
        self.schema, self.path = schema, options["path"]
        self.most = int(options.get("maxpartitionbytes", 64 << 20))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name not in HEADERS:
                yield f
            elif isinstance(f, EqualTo | EqualNullSafe):
                self.tests.append((name, "in", (f.value,)))
            elif isinstance(f, In):
                self.tests.append((name, "in", tuple(x for x in f.value if x is not None)))
            elif isinstance(f, StringStartsWith):
                self.tests.append((name, "starts", f.value))
            elif isinstance(f, IsNotNull | IsNull):
                self.tests.append((name, "null", isinstance(f, IsNull)))
            else:
                yield f

    def partitions(self):
        """Whole files, small ones together, the largest first."""
        from pyarrow import fs

        system, base = file_system(self.path)
        if system.get_file_info(base).type == fs.FileType.File:
            found = [system.get_file_info(base)]
        else:
            found = system.get_file_info(fs.FileSelector(base, recursive=True))
        found = [x for x in found if x.is_file and x.path.endswith((".warc", ".warc.gz"))]
        found = [x for x in found if not any(p[:1] in "._" for p in x.path[len(base) :].split("/") if p)]
        out, size = [], 0
        for x in sorted(found, key=lambda x: (-x.size, x.path)):
            if not out or size + x.size > self.most:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(x.path)
            size += x.size
        return out or [Files([])]

    def wanted(self, headers: dict[str, str]) -> bool:
        for name, how, value in self.tests:
            x = column(headers, name)
            if how == "null":
                if (x is None) != value:
                    return False
            elif how == "in":
                if x not in value:
                    return False
            elif x is None or not x.startswith(value):
                return False
        return True

    def read(self, partition):
        system, _ = file_system(self.path)
        deep = bool(DEEP & set(self.columns))
        kinds = {"payload_length": pa.int64(), "payload": pa.binary(), "digest_matches": pa.bool_()}
        schema = pa.schema([(c, kinds.get(c, pa.string())) for c in self.columns])
        rows, size = [], 0
        for path in partition.paths:
            with system.open_input_file(path) as f:
                for headers, http, payload in read_records(f, self.wanted, deep):
                    rows.append(row(headers, http, payload))
                    size += len(payload or b"")
                    if len(rows) >= 2000 or size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema)


def column(headers: dict[str, str], name: str) -> str | None:
    value = headers.get(HEADERS[name])
    return value.removeprefix("sha1:") if name == "payload_digest" and value else value


def row(headers: dict, http: dict, payload: bytes | None) -> dict:
    out = {name: column(headers, name) for name in HEADERS}
    length = http.get("content-length", "")
    out["payload_length"] = int(length) if length.isdigit() else None
    if payload is not None:
        out["payload"] = payload
        if out["record_type"] == "response":
            out["digest_matches"] = sha1_base32(payload) == out["payload_digest"]
    return out


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    """A file per task, a new one beyond maxfilebytes; files get their places when all tasks are done."""

    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("maxfilebytes", 1 << 30))
        self.job = uuid.uuid4().hex

    def write(self, iterator):
        system, base = file_system(self.path)
        system.create_dir(posixpath.join(base, "_temporary", self.job), recursive=True)
        names, out, size = [], None, 0
        try:
            for whole in iterator:
                for k in range(0, whole.num_rows, 256):
                    for r in whole.slice(k, 256).to_pylist():
                        if out is None or size > self.most:
                            if out is not None:
                                out.close()
                            names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                            place = posixpath.join(base, "_temporary", self.job, names[-1])
                            out, size = system.open_output_stream(place, compression=None), 0
                        raw = member(record(r))
                        out.write(raw)
                        size += len(raw)
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages):
        system, base = file_system(self.path)
        system.create_dir(base, recursive=True)
        for name in (n for m in messages if m for n in m.names):
            system.move(posixpath.join(base, "_temporary", self.job, name), posixpath.join(base, name))
        self._clear(system, base)

    def abort(self, messages):
        self._clear(*file_system(self.path))

    def _clear(self, system, base):
        from pyarrow import fs

        place = posixpath.join(base, "_temporary", self.job)
        if system.get_file_info(place).type == fs.FileType.Directory:
            system.delete_dir(place)


class WarcDataSource(DataSource):
    """Options: path; maxpartitionbytes (of the files read by a task); maxfilebytes (of a file written)."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(schema, self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


#: Repeated payloads whose digests are broadcast to the pages at most.
BROADCAST_ROWS = 500_000


def write_pages(pages: DataFrame, path: str, least: int = 0, date: str = "2000-01-01T00:00:00Z") -> None:
    """A record for each row of pages (``page_id, url, html``); the payload is html in UTF-8, empty for null.

    Of the records with equal payloads of at least ``least`` bytes that with the largest page_id is the
    response, the others revisit it. Rows that repeat this page_id are responses, too. A null page_id
    is smaller than any other; if all of the payload are null, all are responses.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "utf-8")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    pages = pages.withColumns({"sha1": F.unhex(F.sha1("payload")), "n": F.octet_length("payload").cast("long")})
    repeated = pages.where(F.col("n") >= least).groupBy("sha1", "n")
    repeated = repeated.agg(F.max("page_id").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    if repeated.count() <= BROADCAST_ROWS:  # else both sides are shuffled
        repeated = F.broadcast(repeated)
    rows = pages.join(repeated, ["sha1", "n"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    rows = rows.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        name("page_id").alias("record_id"),
        F.col("url").cast("string").alias("target_uri"),
        F.lit(date).alias("date"),
        F.col("sha1").alias("digest"),
        F.when(revisit, name("first")).alias("refers_to"),
        F.col("n").alias("payload_length"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )
    rows = rows.withColumn("payload_digest", _base32("digest")).drop("digest")
    rows.write.format("warc").mode("append").save(path)


def _base32(name: str):
    """Upper-case base32 of a 20-byte digest: a letter for each five bits, by groups of five bytes."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    parts = []
    for k in range(4):
        number = F.conv(F.hex(F.substring(F.col(name), 5 * k + 1, 5)), 16, 10).cast("long")
        for shift in range(35, -5, -5):
            at = F.shiftright(number, shift).bitwiseAND(F.lit(31)).cast("int") + 1
            parts.append(F.substring(F.lit(letters), at, F.lit(1)))
    return F.concat(*parts)


def page_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of write_pages: payloads are read and checked for responses, skipped for revisits."""
    register(spark)
    number = lambda c: F.nullif(F.regexp_extract(c, r"<urn:page:(-?\d*)>", 1), F.lit("")).cast("long")
    archive = spark.read.format("warc")
    shallow = T.StructType([f for f in SCHEMA.fields if f.name not in DEEP])
    responses = archive.schema(SCHEMA).load(path).where(F.col("record_type") == "response")
    responses = responses.withColumn("payload_length", F.octet_length("payload").cast("long"))
    revisits = archive.schema(shallow).load(path).where(F.col("record_type") == "revisit")
    both = responses.drop("payload").unionByName(revisits, allowMissingColumns=True)
    return both.select(
        number("record_id").alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        number("refers_to").alias("refers_to"),
        "digest_matches",
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    path = scratch_path(spark, "warc")
    write_pages(table(spark, sf_dir, "pages"), path)
    return page_records(spark, path)
