"""WARC archives as a Python data source (``format("warc")``), for reading and writing.

Reading plans partitions of whole files from their listed sizes: small files share a partition, and none is opened to plan. A file isn't cut, as a payload may itself hold records, so
that no place inside a file shows for certain where one starts; the writer begins a new file at the size of a partition instead.
Predicates on ``record_type`` and on header columns are pushed down: headers are parsed first, and the block of a record that no predicate wants, or of any record with option
``payload`` = false, is stepped over by its Content-Length without being read or decoded.

Files are plain or gzipped by record. Each gzip member that the writer makes states its own length in the extra field ``sl`` (skip lengths), so a reader inflates a
record's headers and steps over the rest of the member; members of other writers, without that field, are inflated to their end in chunks.
"""

from __future__ import annotations

import io
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import fresh_path, written

SCHEMA = "record_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, http_length long, payload binary"
#: The header that each column comes from (fixed values of the WARC format).
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload that a batch holds, and bytes after which the writer begins another file and the planner another partition.
BATCH_BYTES, FILE_BYTES = 8 << 20, 64 << 20
#: The least that a partition is planned to hold where option ``minPartitions`` asks for more partitions than FILE_BYTES gives.
LEAST_BYTES = 4 << 20
GZIP_MAGIC = b"\x1f\x8b"
#: The fixed part of a gzip header whose only extra field is ``sl``: its length, its name, and the length of its two 32-bit numbers.
SKIP_FIELD = struct.pack("<H2sH", 12, b"sl", 8)
CHUNK = 1 << 16


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (pafs.LocalFileSystem(), path)


@dataclass
class Span(InputPartition):
    """Whole files."""

    paths: tuple[str, ...]


def read_headers(f: io.BufferedReader) -> dict[str, str] | None:
    """The header lines at the reading position, by lower-case name; None at the end. Blank lines before a record are skipped."""
    line = f.readline()
    while line in (b"\r\n", b"\n"):
        line = f.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no WARC record starts here: {line[:40]!r}")
    found: dict[str, str] = {}
    while (line := f.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        found[name.strip().lower()] = value.strip()
    return found


def _open(fs: pafs.FileSystem, path: str) -> io.BufferedReader:
    return io.BufferedReader(fs.open_input_file(path), 1 << 18)


class Member(io.RawIOBase):
    """The inflated bytes of the gzip member at the reading position of ``f``; ``length`` is the member's own, if it states it, else 0."""

    def __init__(self, f: io.BufferedReader):
        self.f, self.z, at = f, zlib.decompressobj(31), f.tell()
        head = f.read(24)
        f.seek(at)
        self.length = struct.unpack_from("<I", head, 16)[0] if len(head) == 24 and head[3] == 4 and head[10:16] == SKIP_FIELD else 0

    def readable(self) -> bool:
        return True

    def readinto(self, buffer: memoryview) -> int:
        while not self.z.eof:
            data = self.z.unconsumed_tail or self.f.read(CHUNK)
            out = self.z.decompress(data, len(buffer))
            if out:
                buffer[: len(out)] = out
                return len(out)
            if not data and not self.z.eof:
                raise ValueError("a gzip member ends too early")
        return 0


class Block:
    """A record's block. What its user leaves unread is stepped over when the next record is asked for."""

    def __init__(self, f: io.BufferedReader, length: int):
        self.f, self.left = f, length

    def readline(self) -> bytes:
        line = self.f.readline(self.left)
        self.left -= len(line)
        return line

    def read(self) -> bytes:
        data = self.f.read(self.left)
        if len(data) < self.left:
            raise ValueError("a record ends too early")
        self.left = 0
        return data


def records(f: io.BufferedReader) -> Iterator[tuple[dict[str, str], Block]]:
    """Headers and block of a file's records in order; a file that ends inside a record is an error."""
    zipped = f.peek(2)[:2] == GZIP_MAGIC
    end = f.seek(0, io.SEEK_END)
    f.seek(0)
    while (at := f.tell()) < end:
        member = Member(f) if zipped else None
        source = io.BufferedReader(member, CHUNK) if zipped else f
        while (head := read_headers(source)) is not None:
            block = Block(source, int(head.get("content-length", 0)))
            yield head, block
            if not zipped:
                if f.seek(block.left, io.SEEK_CUR) > end:
                    raise ValueError("a record ends too early")
                break
            if member.length:
                break
            while block.left and (data := source.read(min(block.left, CHUNK))):
                block.left -= len(data)
        if zipped:
            if f.seek(at + member.length if member.length else f.tell() - len(member.z.unused_data)) > end:
                raise ValueError("a gzip member ends too early")
        elif head is None:
            return


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "true") != "false"
        self.bytes = int(options.get("partitionbytes", options.get("partitionBytes", FILE_BYTES)))
        self.parts = int(options.get("minpartitions", options.get("minPartitions", 1)))
        self.wanted: list[tuple[str, frozenset]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if isinstance(f, EqualTo) and name in HEADERS:
                self.wanted.append((HEADERS[name], frozenset((f.value,))))
            elif isinstance(f, In) and name in HEADERS:
                self.wanted.append((HEADERS[name], frozenset(f.value)))
            elif isinstance(f, IsNotNull) and name in HEADERS:
                self.wanted.append((HEADERS[name], frozenset()))
            else:
                yield f

    def partitions(self) -> list[Span]:
        fs, root = _fs(self.path)
        info = fs.get_file_info(root)
        files = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root, recursive=True))
        whole = sorted((x.path, x.size) for x in files if x.type == pafs.FileType.File and x.size and not x.base_name.startswith(("_", ".")))
        plan, group, size = [], [], 0
        most = min(self.bytes, max(LEAST_BYTES, sum(n for _, n in whole) // self.parts))
        for path, n in whole:
            if group and size + n > most:
                plan.append(Span(tuple(group)))
                group, size = [], 0
            group.append(path)
            size += n
        return [*plan, Span(tuple(group))]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*((n, pa.string()) for n in HEADERS), ("http_length", pa.int64()), ("payload", pa.binary())])
        fs, _ = _fs(self.path)
        rows, held = [], 0
        for path in partition.paths:
            with _open(fs, path) as f:
                for head, block in records(f):
                    if not all(head.get(h) in values if values else h in head for h, values in self.wanted):
                        continue
                    rows.append([*(head.get(h) for h in HEADERS.values()), *self._block(head, block)])
                    held += 500 + len(rows[-1][-1] or b"")
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    def _block(self, head: dict[str, str], block: Block) -> tuple[int | None, bytes | None]:
        """The length that the HTTP headers state, and the payload (None if it isn't wanted)."""
        stated = None
        if head.get("content-type", "").startswith("application/http"):
            while (line := block.readline()) not in (b"\r\n", b"\n", b""):
                if line.lower().startswith(b"content-length:"):
                    stated = int(line.split(b":")[1])
        return stated, block.read() if self.payload else None


@dataclass
class Files(WriterCommitMessage):
    paths: tuple[str, ...]


class WarcWriter(DataSourceArrowWriter):
    """Rows of SCHEMA become records, gzipped one by one unless option ``compression`` is ``none``.

    Tasks write hidden files; the commit gives those of successful attempts their names.
    """

    def __init__(self, options: dict):
        self.path = options["path"]
        self.roll = int(options.get("filebytes", options.get("fileBytes", FILE_BYTES)))
        self.gzip = options.get("compression", "gzip") != "none"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Files:
        fs, root = _fs(self.path)
        fs.create_dir(root, recursive=True)
        paths: list[str] = []
        out, size = None, 0
        for batch in iterator:
            for row in (dict(zip(batch.schema.names, (c[i].as_py() for c in batch.columns))) for i in range(len(batch))):
                if out is None or size > self.roll:
                    if out:
                        out.close()
                    paths.append(f"{root}/.{uuid.uuid4().hex}.warc{'.gz' if self.gzip else ''}")
                    out, size = fs.open_output_stream(paths[-1], compression=None), 0
                out.write(data := zipped(record(row)) if self.gzip else record(row))
                size += len(data)
        if out:
            out.close()
        return Files(tuple(paths))

    def commit(self, messages: list[Files | None]) -> None:
        fs, root = _fs(self.path)
        fs.create_dir(root, recursive=True)
        for n, path in enumerate(p for m in messages if m for p in m.paths):
            stem, dot, ending = path.rpartition(".warc")
            fs.move(path, f"{root}/part-{n:06d}-{stem[-8:]}{dot}{ending}")

    def abort(self, messages: list[Files | None]) -> None:
        fs, _ = _fs(self.path)
        for path in (p for m in messages if m for p in m.paths):
            fs.delete_file(path)


def _line(name: str, value: str | None) -> str:
    """A header line, or nothing for None; control characters are percent-encoded, so a value can't break out of its line."""
    return "" if value is None else f"{name}: {re.sub(r'[\x00-\x1f\x7f]', lambda m: f'%{ord(m[0]):02X}', value)}\r\n"


def record(row: dict) -> bytes:
    """One WARC/1.1 record of an HTTP response; a revisit has the HTTP headers without the payload."""
    payload = row["payload"] or b""
    revisit = row["record_type"] == "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['http_length'] if revisit else len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = "WARC/1.1\r\n" + "".join(
        _line(n, v)
        for n, v in (
            ("WARC-Type", row["record_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Target-URI", row["target_uri"]), ("WARC-Date", row["date"]),
            ("WARC-Profile", REVISIT_PROFILE if revisit else None), ("WARC-Refers-To", row["refers_to"]), ("WARC-Payload-Digest", row["payload_digest"]),
            ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
        )
    )
    return b"".join((head.encode("utf-8", "replace"), b"\r\n", block, b"\r\n\r\n"))


def zipped(data: bytes) -> bytes:
    """``data`` as one gzip member that states its length (left out beyond 32 bits, where readers inflate to the end)."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    length = 10 + 14 + len(body) + 8
    fits = length < 1 << 32
    head = GZIP_MAGIC + struct.pack("<BBIBB", 8, 4 if fits else 0, 0, 0, 255) + (SKIP_FIELD + struct.pack("<II", length, len(data) & 0xFFFFFFFF) if fits else b"")
    return b"".join((head, body, struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)))


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def archive(pages: DataFrame, path: str, least: int = 100, date: str = "2024-01-01T00:00:00Z", compression: str = "gzip") -> None:
    """Write one record per row of ``pages(page_id, url, html)``; further columns are ignored.

    Payloads of at least ``least`` bytes that are equal: the smallest page_id's record is the response, the others revisit it. A null html is an empty payload. Rows
    that repeat the smallest page_id with the same payload are responses too. A null page_id gives a record without an id; it is a response only if
    its group has no id. The date is a parameter, so that runs are repeatable.
    Who is a response is decided on (digest, smallest page_id) of the payloads that recur, a table written first: while it is small, Catalyst broadcasts it
    by its size and no payload is shuffled.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    rows = rows.withColumns({"bytes": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    first = written(rows.where(F.col("bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"), "warc-repeated")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">"))
    out = rows.join(first, "digest", "left").select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), urn("page_id").alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("date"),
        F.when(revisit, urn("first")).alias("refers_to"), F.concat(F.lit("sha256:"), "digest").alias("payload_digest"), F.col("bytes").alias("http_length"), F.when(~revisit, F.col("payload")).alias("payload"),
    )
    register(pages.sparkSession)
    out.write.format("warc").mode("append").option("compression", compression).save(path)


def page_records(spark: SparkSession, path: str) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of the archives at ``path``.

    Length and digest of responses are taken from the payload itself, those of revisits from their headers, which state them for the full payload.
    """
    register(spark)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    both = spark.read.format("warc").option("minPartitions", spark.sparkContext.defaultParallelism).load(path).where("record_type IN ('response', 'revisit')")
    own = F.col("record_type") == "response"
    length = F.when(own, F.octet_length("payload").cast("long")).otherwise(F.col("http_length"))
    digest = F.when(own, F.sha2("payload", 256)).otherwise(F.substring_index("payload_digest", ":", -1))
    return both.select(number("record_id").alias("page_id"), length.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages' archives to a new place in the shared folder and read them back."""
    path = fresh_path(pages.sparkSession, "warc")
    archive(pages, path)
    return page_records(pages.sparkSession, path)

