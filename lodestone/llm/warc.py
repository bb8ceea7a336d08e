"""WARC archives as a Spark data source, and archiving of pages with revisit records.

Reading plans one partition per group of whole files, takes filters on record_type, record_id and target_uri (pushed down
by Spark, or as options), and parses a record's headers first. A record that no filter wants is passed over without decoding
its payload: each gzip member carries its compressed length in an extra field 'sl', so the reader seeks to the next; members of
other writers, without that field, are inflated and dropped. Option payload=false skips payloads of wanted records too.
A member may hold several records (an archive compressed as one stream); then they are read one after the other.
Writing puts each task's records in a file of its own; only files named in a manifest are read, of which the driver writes one
on each commit, so failed or repeated task attempts leave nothing behind that counts, and appending keeps what is there.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import most_frequent, new_path, slices, table

MANIFEST = re.compile(r"_manifest-\w+\.json$")
SCHEMA = "record_id string, record_type string, target_uri string, payload binary, payload_length long, payload_digest string, refers_to string, headers map<string,string>, file string, offset long"
#: Bytes of archives that one partition reads, and rows in a batch.
PARTITION_BYTES, BATCH_BYTES = 64 << 20, 8 << 20
#: Rows of equal payloads that stay together, and larger groups that are dealt out (any other is a 4096th of all rows at most).
GROUP, HOT = 1024, 4096
_PUSHED = ("record_type", "record_id", "target_uri")


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def clean(value: str | None) -> str:
    """A header's value on one line."""
    return re.sub(r"[\r\n]+", " ", value or "")


def member(raw: bytes, level: int = 6) -> bytes:
    """One gzip member whose extra field 'sl' holds its compressed and uncompressed lengths."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(raw) + packer.flush()
    form, size = ("<HII", 8) if len(body) < 2**31 and len(raw) < 2**32 else ("<HQQ", 16)
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", size + 4) + b"sl" + struct.pack(form, size, 10 + 2 + size + 4 + len(body) + 8, len(raw))
    return head + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def record(record_id: str, record_type: str, target_uri: str | None, payload: bytes, payload_digest: str, refers_to: str | None, date: str) -> bytes:
    """A response holds the payload below an HTTP header; a revisit has that header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if record_type == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <{clean(record_id)}>", f"WARC-Date: {date}", "Content-Type: application/http;msgtype=response"]
    if target_uri is not None:
        head.append(f"WARC-Target-URI: {clean(target_uri)}")
    head += [f"WARC-Payload-Digest: sha1:{payload_digest}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{clean(refers_to)}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_headers(raw: bytes) -> dict[str, str]:
    """Header names in lower case; folded lines are joined; the first line is 'version'."""
    lines = re.sub(rb"\r\n[ \t]+", b" ", raw).decode("utf-8", "replace").split("\r\n")
    found = {"version": lines[0]}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if colon:
            found[name.strip().lower()] = value.strip()
    return found


def _skip_length(head: bytes) -> int | None:
    """The compressed length of the member that begins with head, from its extra field 'sl'."""
    if head[:3] != b"\x1f\x8b\x08" or not head[3] & 4 or len(head) < 12:
        return None
    extra, at = head[12 : 12 + struct.unpack("<H", head[10:12])[0]], 0
    while at + 4 <= len(extra):
        size = struct.unpack("<H", extra[at + 2 : at + 4])[0]
        if extra[at : at + 2] == b"sl" and size >= 8:
            return struct.unpack("<Q", extra[at + 4 : at + 12])[0] if size >= 16 else struct.unpack("<I", extra[at + 4 : at + 8])[0]
        at += 4 + size
    return None


class Inflating:
    """The records of one gzip member, inflated as far as they are asked for."""

    def __init__(self, source: io.RawIOBase, start: int):
        self.source, self.start = source, start
        source.seek(start)
        self.fed, self.buffer, self.unpacker, self.total = 0, bytearray(), zlib.decompressobj(31), 0
        self.length = _skip_length(first := source.read(4096))
        self._feed(first)

    def _feed(self, raw: bytes) -> None:
        self.buffer += self.unpacker.decompress(raw)
        self.fed += len(raw)

    def more(self) -> bool:
        if self.unpacker.eof:
            return False
        raw = self.source.read(65536)
        if not raw:
            raise ValueError(f"a gzip member that begins at {self.start} is cut off")
        self._feed(raw)
        return True

    def headers(self) -> dict[str, str] | None:
        """Of the record that comes next; None if there is none."""
        while (end := self.buffer.find(b"\r\n\r\n", len(self.buffer) - len(self.buffer.lstrip(b"\r\n")))) < 0:
            if not self.more():
                if self.buffer.strip():
                    raise ValueError(f"a record without headers, in the gzip member that begins at {self.start}")
                return None
        self.body = end + 4
        return parse_headers(bytes(self.buffer[:end]).lstrip(b"\r\n"))

    def block(self, length: int) -> bytes:
        while len(self.buffer) < self.body + length and self.more():
            pass
        return bytes(self.buffer[self.body : self.body + length])

    def next(self) -> bool:
        """Pass over the record's block. Whether the member may hold another record: one of known length has one only."""
        if self.length:
            return False
        left = self.body + self.total
        while len(self.buffer) < left:
            left -= len(self.buffer)
            self.buffer.clear()
            if not self.more():
                return False
        del self.buffer[:left]
        return True

    def end(self) -> int:
        return self.start + (self.length or self.fed - len(self.unpacker.unused_data))


@dataclass
class Files(InputPartition):
    paths: list[str]

    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    size: int = 0


def archives(system: fs.FileSystem, root: str) -> list[tuple[str, int]]:
    """Paths and sizes of the archives at or below root: those that manifests name, or all if there is no manifest."""
    info = system.get_file_info(root)
    infos = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    manifests = [i.path for i in infos if MANIFEST.search(i.path)]
    if not manifests:
        return [(i.path, i.size) for i in infos if i.type == fs.FileType.File and re.search(r"\.warc(\.gz)?$", i.path)]
    files = []
    for path in manifests:
        with system.open_input_file(path) as f:
            files += [(f"{root}/{name}", size) for name, size in json.loads(f.read())]
    return files


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() != "false"
        self.wanted: list[tuple[str, str, tuple]] = [(c, "in", tuple(options[c].split(","))) for c in _PUSHED if c in options]

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if isinstance(f, EqualTo | In | StringStartsWith) and len(f.attribute) == 1 else None
            if column not in _PUSHED:
                yield f
            elif isinstance(f, StringStartsWith):
                self.wanted.append((column, "starts", (f.value,)))
            else:
                self.wanted.append((column, "in", tuple(f.value) if isinstance(f, In) else (f.value,)))

    def partitions(self) -> list[Files]:
        system, root = fs.FileSystem.from_uri(self.path)
        files = archives(system, root)
        parts, held = [[]], 0
        for path, size in sorted(files):
            if parts[-1] and held + size > PARTITION_BYTES:
                parts.append([])
                held = 0
            parts[-1].append(path)
            held += size
        return [Files(p) for p in parts]

    def _wants(self, values: dict[str, str | None]) -> bool:
        return all((v := values[c]) is not None and (v in x if how == "in" else v.startswith(x[0])) for c, how, x in self.wanted)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.path)
        rows, held = [], 0
        for path in partition.paths:
            with system.open_input_file(path) as source:
                for row in self._records(source, path):
                    rows.append(row)
                    held += len(row[3] or b"") + 500
                    if held > BATCH_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
        yield _batch(rows)

    def _records(self, source, path: str) -> Iterator[tuple]:
        at, size = 0, source.size()
        plain = path.endswith(".warc")
        while at < size:
            one = Plain(source, at) if plain else Inflating(source, at)
            while (h := one.headers()) is not None:
                strip = lambda k: h[k].removeprefix("<").removesuffix(">") if k in h else None  # noqa: E731, B023
                values = {"record_type": h.get("warc-type"), "record_id": strip("warc-record-id"), "target_uri": h.get("warc-target-uri")}
                one.total = int(h.get("content-length", 0))
                if self._wants(values):
                    payload = None
                    length = int(h["x-payload-length"]) if "x-payload-length" in h else None
                    if self.payload and values["record_type"] == "response":
                        block = one.block(one.total)
                        payload = block.partition(b"\r\n\r\n")[2] if "application/http" in h.get("content-type", "") else block
                        length = len(payload)
                    yield values["record_id"], values["record_type"], values["target_uri"], payload, length, h.get("warc-payload-digest", "").removeprefix("sha1:") or None, strip("warc-refers-to"), list(h.items()), path, at
                if not one.next():
                    break
            at = max(one.end(), at + 1)


class Plain:
    """A record of an archive without compression."""

    def __init__(self, source, start: int):
        self.source, self.start, self.total, self.body = source, start, 0, 0

    def headers(self) -> dict[str, str] | None:
        self.source.seek(self.start)
        raw = b""
        while (end := raw.find(b"\r\n\r\n", len(raw) - len(raw.lstrip(b"\r\n")))) < 0:
            if not (x := self.source.read(4096)):
                if raw.strip():
                    raise ValueError(f"a record without headers, at {self.start}")
                return None
            raw += x
        self.body = self.start + end + 4
        return parse_headers(raw[:end].lstrip(b"\r\n"))

    def block(self, length: int) -> bytes:
        self.source.seek(self.body)
        return self.source.read(length)

    def next(self) -> bool:
        return False

    def end(self) -> int:
        return self.body + self.total if self.body else self.source.size()


_ARROW = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("payload", pa.binary()), ("payload_length", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("file", pa.string()), ("offset", pa.int64())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * len(_ARROW), _ARROW)], schema=_ARROW)


class WarcWriter(DataSourceArrowWriter):
    """Columns: record_id, record_type, payload; target_uri, payload_digest, refers_to, warc_date if there."""

    def __init__(self, options: dict[str, str], overwrite: bool = False):
        self.path, self.overwrite = options["path"], overwrite
        self.date = options.get("date", "1970-01-01T00:00:00Z")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, root = fs.FileSystem.from_uri(self.path)
        system.create_dir(root, recursive=True)
        name, out = f"part-{uuid.uuid4().hex}.warc.gz", None
        try:
            for batch in batches:
                if out is None and batch.num_rows:
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                for part in slices([batch], "payload"):
                    for row in part.to_pylist():
                        payload = row["payload"] or b""
                        out.write(member(record(row["record_id"], row["record_type"], row.get("target_uri"), payload, row.get("payload_digest") or digest(payload), row.get("refers_to"), row.get("warc_date") or self.date)))
            size = out.tell() if out is not None else 0
        finally:
            if out is not None:
                out.close()
        return Written(name if out is not None else None, size)

    def commit(self, messages: list[Written | None]) -> None:
        """One more manifest. Overwriting takes the old ones away; archives that were there without one are named too."""
        system, root = fs.FileSystem.from_uri(self.path)
        system.create_dir(root, recursive=True)
        old = [i.path for i in system.get_file_info(fs.FileSelector(root)) if MANIFEST.search(i.path)]
        made = [(m.name, m.size) for m in messages if m is not None and m.name]
        if not old and not self.overwrite:
            own = {name for name, _ in made}
            made += [(path.removeprefix(root).lstrip("/"), size) for path, size in archives(system, root) if path.rsplit("/", 1)[-1] not in own]
        with system.open_output_stream(f"{root}/_manifest-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(made).encode())
        for path in old if self.overwrite else []:
            system.delete_file(path)

    def abort(self, messages: list[Written | None]) -> None:
        system, root = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None and m.name:
                system.delete_file(f"{root}/{m.name}")


class WarcDataSource(DataSource):
    """spark.read.format("warc"): path; options payload, record_type, record_id, target_uri (comma lists)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def archive_pages(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Write one record a row of pages (page_id, url, html) below path.

    Payload: html in UTF-8; null is empty. Of rows with equal payloads of at least least_bytes, those with the largest
    page_id are responses and the others revisit it; smaller payloads are responses all. A null page_id is never the
    largest unless all of its group are null. Repeated rows give a record each.
    """
    register(pages.sparkSession)
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload")).withColumn("sha1", F.sha1("payload"))
    equal = pages.select("page_id", F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload")).where(F.octet_length("payload") >= least_bytes).select("page_id", F.sha1("payload").alias("sha1"))
    groups = equal.groupBy("sha1").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    # a large group's rows are dealt out by salt; of other groups, each has few rows
    hot = F.broadcast(most_frequent(groups.where(F.col("n") > GROUP), "n", HOT).select("sha1", F.ceil(F.col("n") / GROUP).cast("int").alias("salts")))
    first = groups.join(hot, "sha1", "left").select("sha1", "first", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    rows = rows.join(hot, "sha1", "left").withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    revisits = F.col("first").isNotNull() & (F.octet_length("payload") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("null")))
    out = rows.join(first, ["sha1", "salt"], "left").select(
        urn(F.col("page_id")).alias("record_id"), F.when(revisits, "revisit").otherwise("response").alias("record_type"), F.col("url").alias("target_uri"), "payload", F.when(revisits, urn(F.col("first"))).alias("refers_to")
    )
    out.write.format("warc").mode("append").save(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A response's length and digest come from the payload that is read; a revisit's from its headers."""
    register(spark)
    page = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1)
    number = lambda c: F.when(page(c) != "", page(c).cast("long"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            read = [digest(p) if p is not None else d for p, d in zip(b.column("payload").to_pylist(), b.column("payload_digest").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("record_id"), b.column("payload_length"), pa.array(read, pa.string()), b.column("record_type"), b.column("refers_to")], ["record_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    rows = spark.read.format("warc").load(path).mapInArrow(check, "record_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return rows.select(number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", number(F.col("refers_to")).alias("refers_to"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "archive")
    archive_pages(table(spark, sf_dir, "pages"), path)
    return read_pages(spark, path)


#: base32 has no DuckDB function, so five-bit groups of the digest are looked up one by one.
OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, max(page_id) OVER (PARTITION BY html) AS first,
             unhex(sha1(html))::BIT::VARCHAR AS bits FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + substr(bits, 1 + 5 * i::INT, 5)::BIT::INT, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""
