"""WARC archives as a Spark data source.

Writing. Each task writes its own files (a record a gzip member, rolled over at a size) under names of its own; the commit
writes a manifest of the files of successful tasks, and readers of a folder with manifests see these files alone. So a task
that is repeated, or dies, leaves nothing that is read.

Reading. The driver plans partitions of whole files by size. Record-type and header predicates (=, IN, prefix) are pushed
down. A task parses a record's headers first; where they are turned down, or the payload isn't wanted, it goes on to the
next record: by Content-Length in a plain file, by the length that the gzip member states (the `sl` field of the format's
annex on compression) in a compressed one, without decoding the payload. Members without that field are decoded in pieces.

A revisit record keeps the HTTP header of the page, whose Content-Length tells the length of the payload it doesn't hold.

Files are opened through pyarrow's file systems (local paths, file://, hdfs://, s3://, gs://).

Defined cases: a null payload is an empty one; an empty table gives a manifest without files; equal payloads have one
response, the largest id, and rows that repeat this id with this payload are responses too; a null id takes no part in
choosing, and is a response; columns that aren't named in SCHEMA are ignored on writing."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage

from millrace.llm.common import table
from millrace.session import materialize, scratch_path
from millrace.sources.files import commit_manifest, committed, file_system

SCHEMA = "record_id string, record_type string, target_uri string, date string, content_type string, payload_digest string, refers_to string, payload_length long, payload binary"
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "content_type": "Content-Type", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
DATE = "1970-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEAD = 1 << 14
_CHUNK = 1 << 20


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _clean(s: str | None) -> str:
    return (s or "").replace("\r", " ").replace("\n", " ")


def record(row: dict) -> bytes:
    """The bytes of one response, revisit or resource record."""
    payload, kind = row.get("payload") or b"", row.get("record_type") or "response"
    length = len(payload) if kind != "revisit" or row.get("payload_length") is None else row["payload_length"]
    block = payload
    if kind in ("response", "revisit"):
        http = f"HTTP/1.1 200 OK\r\nContent-Type: {_clean(row.get('content_type')) or 'text/html'}\r\nContent-Length: {length}\r\n\r\n".encode()
        block = http + (payload if kind == "response" else b"")
    digest = row.get("payload_digest") or sha1_base32(payload)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_clean(row.get('record_id'))}>", f"WARC-Date: {row.get('date') or DATE}"]
    if row.get("target_uri") is not None:
        lines.append(f"WARC-Target-URI: {_clean(row['target_uri'])}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <{_clean(row.get('refers_to'))}>"]
    own = "application/http; msgtype=response" if kind in ("response", "revisit") else _clean(row.get("content_type")) or "application/octet-stream"
    lines += [f"Content-Type: {own}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    """One gzip member that states its own length."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    whole = 10 + 2 + 12 + len(body) + 8
    if whole < 1 << 32 and len(data) < 1 << 32:
        extra = struct.pack("<H2sHII", 12, b"sl", 8, whole, len(data))
        return struct.pack("<2sBBIBB", b"\x1f\x8b", 8, 4, 0, 0, 255) + extra + body + tail
    return struct.pack("<2sBBIBB", b"\x1f\x8b", 8, 0, 0, 0, 255) + body + tail


@dataclass
class Written(WriterCommitMessage):
    files: list[str] = field(default_factory=list)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.roll = int(options.get("rollbytes", 64 << 20))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = file_system(self.path)
        fs.create_dir(root, recursive=True)
        done, out, size = [], None, 0
        try:
            for batch in iterator:
                names = batch.schema.names
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    for values in zip(*(part.column(i).to_pylist() for i in range(len(names)))):
                        data = member(record(dict(zip(names, values))))
                        if out is None or size + len(data) > self.roll and size:
                            if out is not None:
                                out.close()
                            done.append(f"part-{uuid.uuid4().hex}.warc.gz")
                            out, size = fs.open_output_stream(f"{root}/{done[-1]}", compression=None), 0
                        out.write(data)
                        size += len(data)
        finally:
            if out is not None:
                out.close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        commit_manifest(self.path, [f for m in messages if m for f in m.files])

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = file_system(self.path)
        for f in (f for m in messages if m for f in m.files):
            fs.delete_file(f"{root}/{f}")


@dataclass
class Files(InputPartition):
    paths: list[str]

    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


class Plain:
    """Records of an uncompressed file: headers, then the block or a seek over it."""

    def __init__(self, handle):
        self.handle, self.buffer, self.at = handle, b"", 0  # at: place in the file of the buffer's first byte

    def _need(self, n: int) -> bool:
        while len(self.buffer) < n:
            more = self.handle.read(max(_CHUNK if n > _HEAD else _HEAD, n - len(self.buffer)))
            if not more:
                return False
            self.buffer += more
        return True

    def head(self) -> bytes | None:
        n = _HEAD
        while True:
            full = self._need(n)
            self.buffer, cut = self.buffer.lstrip(b"\r\n"), len(self.buffer)
            self.at += cut - len(self.buffer)
            end = self.buffer.find(b"\r\n\r\n")
            if end >= 0:
                out, self.buffer = self.buffer[:end], self.buffer[end + 4 :]
                self.at += end + 4
                return out
            if not full:
                if self.buffer.strip():
                    raise ValueError("a record's header doesn't end")
                return None
            n += _CHUNK

    def block(self, length: int, wanted: bool) -> bytes | None:
        if wanted:
            if not self._need(length):
                raise ValueError("a record is cut short")
            out = self.buffer[:length]
        else:
            out = None
        if length <= len(self.buffer):
            self.buffer = self.buffer[length:]
        else:
            self.handle.seek(self.at + length)
            self.buffer = b""
        self.at += length
        return out


class Gzipped:
    """Records of a file of gzip members, a record a member."""

    def __init__(self, handle):
        self.handle, self.start, self.size = handle, 0, handle.size()

    def head(self) -> bytes | None:
        if self.start >= self.size:
            return None
        self.handle.seek(self.start)
        raw = self.handle.read(_HEAD)
        if raw[:3] != b"\x1f\x8b\x08":
            raise ValueError("not a gzip member")
        flags, at, self.length = raw[3], 10, None
        if flags & 4:
            n = struct.unpack_from("<H", raw, at)[0]
            extra, at = raw[at + 2 : at + 2 + n], at + 2 + n
            if extra[:2] == b"sl" and len(extra) >= 12:
                self.length = struct.unpack_from("<I", extra, 4)[0]
        for bit in (8, 16):
            if flags & bit:
                at = raw.index(b"\0", at) + 1
        at += 2 if flags & 2 else 0
        self.inflate = zlib.decompressobj(-15)
        self.text, self.feed = b"", raw[at:]
        while (end := self.text.find(b"\r\n\r\n")) < 0:
            if not self._more(_HEAD):
                raise ValueError("a record's header doesn't end")
        out, self.text = self.text[:end].lstrip(b"\r\n"), self.text[end + 4 :]
        return out

    def _more(self, most: int) -> bool:
        """Decode up to `most` further bytes; False at the member's end."""
        while not self.inflate.eof:
            if not self.feed:
                self.feed = self.handle.read(_CHUNK)
                if not self.feed:
                    raise ValueError("a gzip member is cut short")
            new = self.inflate.decompress(self.feed, most)
            self.feed = self.inflate.unconsumed_tail
            if new:
                self.text += new
                return True
        return False

    def block(self, length: int, wanted: bool) -> bytes | None:
        if wanted:
            parts = [self.text]
            have, self.text = len(self.text), b""
            while have < length and self._more(max(_CHUNK, length)):
                parts.append(self.text)
                have += len(self.text)
                self.text = b""
            if have < length:
                raise ValueError("a record is cut short")
            out = b"".join(parts)[:length]
        else:
            out = None
        if self.length:
            self.start += self.length
        else:
            while self._more(_CHUNK):
                self.text = b""
            self.start = self.handle.tell() - len(self.inflate.unused_data) + 8
        return out


def headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    out: dict[str, str] = {}
    last = None
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            last = name.strip().lower()
            out[last] = value.strip()
    return out


class WarcReader(DataSourceReader):
    """Options: payload = bytes (default), verify (decode and check the digest, give no bytes) or none; splitbytes."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "bytes")
        self.split = int(options.get("splitbytes", 32 << 20))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None
            if name not in HEADERS:
                yield f
            elif isinstance(f, EqualTo):
                self.tests.append((name, "in", (f.value,)))
            elif isinstance(f, In):
                self.tests.append((name, "in", tuple(f.value)))
            elif isinstance(f, StringStartsWith):
                self.tests.append((name, "prefix", f.value))
            else:
                yield f

    def partitions(self) -> list[Files]:
        out: list[Files] = []
        held, size = [], 0
        for p, s in committed(self.path, (".warc", ".warc.gz")).items():
            if held and size + s > self.split:
                out.append(Files(held))
                held, size = [], 0
            held.append(p)
            size += s
        return [*out, Files(held)]

    def _passes(self, row: dict) -> bool:
        for name, kind, value in self.tests:
            x = row[name]
            if x is None or not (x in value if kind == "in" else x.startswith(value)):
                return False
        return True

    def rows(self, path: str, fs) -> Iterator[tuple]:
        with fs.open_input_file(path) as handle:
            source = (Gzipped if handle.read(2) == b"\x1f\x8b" else Plain)(handle)
            handle.seek(0)
            while (head := source.head()) is not None:
                own = headers(head)
                row = {c: own.get(h.lower()) for c, h in HEADERS.items()}
                for c in ("record_id", "refers_to"):
                    row[c] = row[c].strip("<>") if row[c] else row[c]
                digest = row["payload_digest"]
                row["payload_digest"] = digest.removeprefix("sha1:") if digest else digest
                length = int(own.get("content-length", 0))
                if not self._passes(row):
                    source.block(length, False)
                    continue
                http = (row["content_type"] or "").startswith("application/http")
                revisit = row["record_type"] == "revisit"
                block = source.block(length, revisit or self.payload != "none")
                payload, size = block, None if block is None else len(block)
                if http and block is not None:
                    top, _, payload = block.partition(b"\r\n\r\n")
                    size = len(payload)
                    if revisit:
                        said = [x.split(b":", 1)[1] for x in top.split(b"\r\n") if x.lower().startswith(b"content-length:")]
                        size, payload = (int(said[0]) if said else None), None
                if self.payload == "verify" and payload is not None and digest and digest.startswith("sha1:") and row["payload_digest"] != sha1_base32(payload):
                    raise ValueError(f"{path}: the payload of {row['record_id']} doesn't match its digest")
                yield (*row.values(), size, payload if self.payload == "bytes" else None)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        names = [*HEADERS, "payload_length", "payload"]
        kinds = [*[pa.string()] * len(HEADERS), pa.int64(), pa.binary()]
        fs, _ = file_system(self.path)
        held, size = [], 0
        order = [x.split()[0] for x in SCHEMA.split(", ")]

        def batch() -> pa.RecordBatch:
            columns = dict(zip(names, (pa.array(v, k) for v, k in zip(zip(*held), kinds))))
            return pa.RecordBatch.from_arrays([columns[n] for n in order], order)

        for path in partition.paths:
            for row in self.rows(path, fs):
                held.append(row)
                size += len(row[-1] or b"") + 200
                if size > 4 << 20 or len(held) >= 10_000:
                    yield batch()
                    held, size = [], 0
        if held:
            yield batch()


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are only added to: use mode append")
        return WarcWriter(self.options)


def write_warc(records: DataFrame, path: str, **options) -> None:
    """records: columns of SCHEMA by name (payload_digest: base32 SHA-1, made from the payload if absent)."""
    records.sparkSession.dataSource.register(WarcSource)
    known = [x.split()[0] for x in SCHEMA.split(", ")]
    records.select(*(c for c in records.columns if c in known)).write.format("warc").options(**options).mode("append").save(path)


def read_warc(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").options(**options).load(path)


def with_revisits(records: DataFrame, order: str, least: int = 0) -> DataFrame:
    """records (record_id, payload, and a long that orders them) with record_type, refers_to and payload_length: of equal
    payloads of `least` bytes or more that with the largest `order` is the response, the others revisit it.

    Only digests are grouped (with partial sums before the shuffle), and only groups of several records are joined back: a
    table whose size Spark knows before it chooses the join."""
    key = F.sha1(F.coalesce("payload", F.lit(b"")))
    long_enough = F.coalesce(F.length("payload"), F.lit(0)) >= least
    own = records.where(long_enough & F.col(order).isNotNull())
    groups = own.groupBy(key.alias("_key")).agg(F.max_by(F.col("record_id"), F.col(order)).alias("_first"), F.max(order).alias("_most"), F.count("*").alias("_n"))
    several = materialize(groups.where("_n > 1").drop("_n"), "payload-groups")
    joined = records.join(several, (key == F.col("_key")) & long_enough & F.col(order).isNotNull(), "left")
    again = F.col("_most").isNotNull() & (F.col(order) != F.col("_most"))
    return joined.select(
        *records.columns,
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("_first")).alias("refers_to"),
        F.coalesce(F.length("payload"), F.lit(0)).cast("long").alias("payload_length"),
    )


_PREFIX = "urn:page:"


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    records = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.concat(F.lit(_PREFIX), F.coalesce(F.col("page_id").cast("string"), F.lit(""))).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.coalesce("html", F.lit("")).cast("binary").alias("payload"),
    )
    # a revisit's digest comes from its payload, which the record itself leaves out
    path = scratch_path(spark, "warc")
    write_warc(with_revisits(records, "page_id").drop("page_id"), path)
    number = lambda c: F.expr(f"try_cast(substr({c}, {len(_PREFIX) + 1}) AS BIGINT)")
    back = read_warc(spark, path, payload="verify")
    return back.select(
        number("record_id").alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        number("refers_to").alias("refers_to"),
    )


OP3_SQL = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), bits AS (
    SELECT *, list_aggregate(list_transform(range(1, 41), lambda i:
        substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (strpos('0123456789abcdef', substr(hex, i, 1)) - 1) + 1, 4)), 'string_agg', '') AS b
    FROM p
), digests AS (
    SELECT page_id, html, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        16 * CAST(substr(b, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(b, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(b, 5 * i + 3, 1) AS INT)
        + 2 * CAST(substr(b, 5 * i + 4, 1) AS INT) + CAST(substr(b, 5 * i + 5, 1) AS INT) + 1, 1)), 'string_agg', '') AS payload_digest
    FROM bits
), firsts AS (
    SELECT *, max(page_id) OVER (PARTITION BY html) AS first_id FROM digests
)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, payload_digest,
    CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM firsts
"""
