"""WARC records packed in ZIP archives: a writer, and a reader that range-reads records without extraction.

An archive holds archive/data.warc.gz, each record a gzip member of its own, and indexes/index.cdx with one line
for each record: offset and length within the data member, all lines of one width, so that a span of records is found by
reading its lines alone. Both members are stored, not deflated, so a
record's place in the archive is the member's place plus its offset. The reader parses the end record (and the
ZIP64 one where there is one), the central directory and the local headers, then reads ranges of the index and of the data.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import fresh_path

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
#: A line of the index, and its bytes.
LINE, LINE_BYTES = "{:019d} {:019d}\n", 40
#: Adjacent records are fetched in one read of at most about this many bytes.
READ_BYTES = 4 << 20
#: An archive is closed when its data reaches this size.
ARCHIVE_BYTES = 256 << 20


def open_store(uri: str):
    """(file system, path) of a URI; a plain path is local."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    packed: int
    header: int


class Archive:
    """Members of a ZIP archive in a random-access file, by its central directory."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size
        self.members = {m.name: m for m in self._directory()}

    def read(self, start: int, length: int) -> bytes:
        self.file.seek(start)
        data = self.file.read(length)
        if len(data) != length:
            raise ValueError("the archive ends early")
        return data

    def _directory(self) -> Iterator[Member]:
        tail_at = max(0, self.size - 22 - 0xFFFF)
        tail = self.read(tail_at, self.size - tail_at)
        at = tail.rfind(b"PK\x05\x06", 0, len(tail) - 18)
        while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
            at = tail.rfind(b"PK\x05\x06", 0, at)
        if at < 0:
            raise ValueError("no end of a central directory")
        count, length, start = struct.unpack_from("<HLL", tail, at + 10)
        if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
            locator = self.read(tail_at + at - 20, 20)
            if locator[:4] != b"PK\x06\x07":
                raise ValueError("no ZIP64 locator")
            (end64,) = struct.unpack_from("<Q", locator, 8)
            record = self.read(end64, 56)
            if record[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of a central directory")
            count, length, start = struct.unpack_from("<QQQ", record, 32)
        directory, p = self.read(start, length), 0
        for _ in range(count):
            if directory[p : p + 4] != b"PK\x01\x02":
                raise ValueError("a damaged central directory")
            method = struct.unpack_from("<H", directory, p + 10)[0]
            packed, size, n, m, k = struct.unpack_from("<LLHHH", directory, p + 20)
            header = struct.unpack_from("<L", directory, p + 42)[0]
            name = directory[p + 46 : p + 46 + n].decode("utf-8")
            extra, q = directory[p + 46 + n : p + 46 + n + m], 0
            while q + 4 <= len(extra):
                kind, width = struct.unpack_from("<HH", extra, q)
                if kind == 1:  # the 64-bit values stand in this order, each only if its 32-bit field is full
                    wide = list(struct.unpack_from(f"<{width // 8}Q", extra, q + 4))
                    size = wide.pop(0) if size == 0xFFFFFFFF else size
                    packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                    header = wide.pop(0) if header == 0xFFFFFFFF else header
                q += 4 + width
            yield Member(name, method, size, packed, header)
            p += 46 + n + m + k

    def place(self, name: str) -> tuple[int, int]:
        """Where a stored member's bytes begin, and how many there are."""
        m = self.members[name]
        if m.method:
            raise ValueError(f"{name} is not stored")
        head = self.read(m.header, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("a damaged local header")
        n, k = struct.unpack_from("<HH", head, 26)
        return m.header + 30 + n + k, m.size

    def index(self, first: int = 0, count: int | None = None) -> list[tuple[int, int]]:
        """(offset, length) of records in order: of all, or of count records from the first on. Only their lines are read."""
        start, length = self.place(INDEX)
        if length % LINE_BYTES:
            raise ValueError("a damaged index")
        stop = length if count is None else min(length, (first + count) * LINE_BYTES)
        lines = self.read(start + first * LINE_BYTES, max(0, stop - first * LINE_BYTES)).splitlines()
        return [(int(a), int(b)) for a, b in map(bytes.split, lines)]

    def records(self, ranges: Iterable[tuple[int, int]] | None = None) -> Iterator[tuple[dict[str, str], bytes]]:
        """Headers and content of the records at ranges of the data member, or of all; adjacent ones share a read."""
        start, length = self.place(DATA)
        todo: list[tuple[int, int]] = []
        for at, n in [*(self.index() if ranges is None else ranges), (-1, 0)]:
            if todo and (at != todo[-1][0] + todo[-1][1] or at + n - todo[0][0] > READ_BYTES):
                base = todo[0][0]
                block = self.read(start + base, todo[-1][0] + todo[-1][1] - base)
                for a, b in todo:
                    yield parse_record(zlib.decompress(block[a - base : a - base + b], 31))
                todo = []
            if at >= 0:
                if at + n > length:
                    raise ValueError("a record reaches beyond its member")
                todo.append((at, n))


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    return headers, rest[: int(headers["Content-Length"])]


def record(headers: dict[str, str], content: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in (headers | {"Content-Length": str(len(content))}).items())
    return b"WARC/1.1\r\n" + lines.encode("utf-8") + b"\r\n" + content + b"\r\n\r\n"


class ArchiveWriter:
    """Writes one archive from front to back: sizes and sums follow in the central directory and data descriptors."""

    def __init__(self, sink):
        self.sink, self.at, self.lines, self.crc = sink, 0, [], 0
        self._put(self._local(DATA))
        self.begin = self.at

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    @staticmethod
    def _local(name: str) -> bytes:
        # flag 8: sizes follow the data, as 64-bit values because of the ZIP64 field
        return struct.pack("<4sHHHHHLLLHH", b"PK\x03\x04", 45, 8, 0, 0, 33, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), 20) + name.encode() + struct.pack("<HHQQ", 1, 16, 0, 0)

    def add(self, packed: bytes) -> None:
        self.lines.append(LINE.format(self.at - self.begin, len(packed)))
        self.crc = zlib.crc32(packed, self.crc)
        self._put(packed)

    def close(self) -> int:
        entries = [(DATA, 0, self.crc, self.at - self.begin)]
        self._put(struct.pack("<4sLQQ", b"PK\x07\x08", self.crc, entries[0][3], entries[0][3]))
        index, at = "".join(self.lines).encode(), self.at
        self._put(self._local(INDEX))
        self._put(index)
        self._put(struct.pack("<4sLQQ", b"PK\x07\x08", zlib.crc32(index), len(index), len(index)))
        entries.append((INDEX, at, zlib.crc32(index), len(index)))
        start = self.at
        for name, header, crc, size in entries:
            self._put(struct.pack("<4sHHHHHHLLLHHHHHLL", b"PK\x01\x02", 45, 45, 8, 0, 0, 33, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(name), 28, 0, 0, 0, 0, 0xFFFFFFFF) + name.encode() + struct.pack("<HHQQQ", 1, 24, size, size, header))
        end = self.at
        self._put(struct.pack("<4sQHHLLQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 2, 2, end - start, start))
        self._put(struct.pack("<4sLQL", b"PK\x06\x07", 0, end, 1))
        self._put(struct.pack("<4sHHHHLLH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))
        return self.at


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def with_verdicts(pages: DataFrame, payload: str = "html", least: int = 0, salts: int = 16) -> DataFrame:
    """pages with __sha and __refers: the smallest page_id among payloads that are equal and of at least `least`
    bytes, where that is another row's id, else null.

    Only payloads that occur under several ids are joined, one row for each; they are dealt out over salts, so a
    payload that a third of the pages share meets them in many tasks.
    """
    content = F.coalesce(F.col(payload), F.lit(""))
    salted = pages.withColumn("__sha", F.sha1(content.cast("binary"))).withColumn("__salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int"))
    low = salted.where(F.octet_length(content) >= least).groupBy("__sha").agg(F.min("page_id").alias("__low"), F.max("page_id").alias("__high")).where("__low < __high").drop("__high")
    low = low.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(low, ["__sha", "__salt"], "left").withColumn("__refers", F.when(F.col("page_id") > F.col("__low"), F.col("__low"))).drop("__salt", "__low")


def write_archives(pages: DataFrame, folder: str, payload: str = "html", least: int = 0) -> DataFrame:
    """Write every page as a WARC record into archives under folder; returns one row (path, bytes, records) for each.

    The rows are lazy: read them once, by write(). Each task writes archives of its own under names with its
    attempt, so a task that is run again, or twice at once, leaves at most an archive that no row names.
    Null payloads are empty; a null page_id is kept as such; repeated rows give repeated records, and rows with the
    smallest id of their payload are all responses; very long payloads are one record each. An empty table leaves no archive and
    no row. Only page_id, url and the payload go into records; other columns may have any name.
    """
    rows = with_verdicts(pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("__body")), "__body", least)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        writer = sink = path = None
        done: list[tuple[str, int, int]] = []

        def finish() -> None:
            size = writer.close()
            sink.close()
            done.append((path, size, len(writer.lines)))

        fs, base = open_store(folder)
        for batch in batches:
            for page, url, body, refers in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url", "__body", "__refers")), strict=True):
                if writer is None:
                    name = f"{uuid.uuid4().hex}.wacz"
                    fs.create_dir(base, recursive=True)
                    path, sink = f"{folder}/{name}", fs.open_output_stream(f"{base}/{name}")
                    writer = ArchiveWriter(sink)
                content = body.as_py().encode("utf-8")
                ident = page.as_py()
                headers = {"WARC-Type": "response" if refers.as_py() is None else "revisit", "WARC-Record-ID": f"<urn:page:{'' if ident is None else ident}>", "WARC-Target-URI": json.dumps(url.as_py()), "WARC-Payload-Digest": f"sha1:{payload_digest(content)}", "X-Payload-Bytes": str(len(content))}
                if refers.as_py() is not None:
                    headers |= {"WARC-Refers-To": f"<urn:page:{refers.as_py()}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
                    content = b""
                deflate = zlib.compressobj(3, zlib.DEFLATED, 31)
                writer.add(deflate.compress(record(headers, content)) + deflate.flush())
                if writer.at > ARCHIVE_BYTES:
                    finish()
                    writer = None
        if writer is not None:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "bytes", "records"])

    return rows.mapInArrow(pack, "path string, bytes long, records long")


def read_archives(archives: DataFrame, per_task: int = 2_000) -> DataFrame:
    """The records of archives (path, records): page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload.

    A row's archive is cut into spans of records, and spans are dealt out; each task reads the directory, the index and
    then only its ranges. A revisit has a null payload; its digest and size are the full payload's. The digest of each
    response is computed anew and must equal the header's.
    """
    spans = archives.select("path", F.explode(F.sequence(F.lit(0), F.greatest(F.col("records") - 1, F.lit(0)), F.lit(per_task))).alias("first"))
    spans = spans.repartition(F.col("path"), F.col("first"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
        names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, at = open_store(path)
                with fs.open_input_file(at) as f:
                    archive = Archive(f, f.size())
                    held, size = [], 0
                    for headers, content in archive.records(archive.index(first, per_task)):
                        held.append(_row(headers, content))
                        size += len(content)
                        if size > READ_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], k) for i, k in enumerate(kinds)], names=names)
                            held, size = [], 0
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], k) for i, k in enumerate(kinds)], names=names)

    return spans.mapInArrow(unpack, "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary")


def _row(headers: dict[str, str], content: bytes) -> tuple:
    ident = lambda v: int(v[len("<urn:page:") : -1]) if v and len(v) > len("<urn:page:>") else None
    digest, revisit = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"] == "revisit"
    if not revisit and (payload_digest(content) != digest or len(content) != int(headers["X-Payload-Bytes"])):
        raise ValueError("a payload differs from its digest")
    return ident(headers["WARC-Record-ID"]), json.loads(headers["WARC-Target-URI"]), headers["WARC-Type"], ident(headers.get("WARC-Refers-To")), digest, int(headers["X-Payload-Bytes"]), None if revisit else content


def round_trip(pages: DataFrame, payload: str = "html", least: int = 0) -> DataFrame:
    """Write pages into archives in the shared folder, keep the list of archives there too, and read them back."""
    spark = pages.sparkSession
    folder, listed = fresh_path(spark, "archives"), fresh_path(spark, "archive-list")
    write_archives(pages, folder, payload, least).write.parquet(listed)
    return read_archives(spark.read.schema("path string, bytes long, records long").parquet(listed))


def archive_bytes(rows: Iterable[bytes]) -> bytes:
    """An archive of packed records in memory, for small uses and tests."""
    sink = io.BytesIO()
    writer = ArchiveWriter(sink)
    for r in rows:
        writer.add(zlib.compress(r, 3, 31))
    writer.close()
    return sink.getvalue()
