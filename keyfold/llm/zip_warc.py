"""WARC records in ZIP packages, written by tasks and range-read without extraction.

A package is a ZIP file with two stored members: ``archive/data.warc.gz``, one
gzip member per record, and ``indexes/index.cdx``, one line per record with
its offset and length in the archive.  The reader takes the tail of the file,
finds the end record and, where sizes or counts do not fit it, the ZIP64 end
record, parses the central directory with its ZIP64 fields, locates the stored
members, reads the index, and from then on reads only byte ranges: first the
packages' indexes, then runs of records, each run a row that any task may read.

Equal payloads of at least ``LEAST`` bytes are written once: the smallest page
id is the response, the others are revisit records that refer to it.

Defined cases: null html is an empty payload; a null url is an empty target; a
null page id never is the one referred to unless all are null (then all are
responses); rows that repeat the smallest id are responses too; an empty table
gives no package and no rows; html of any length is one record.
"""

from __future__ import annotations

import gzip
import hashlib
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.llm.common import materialise, open_store, scratch
from keyfold.session import ship_package

LEAST = 100
#: A package is closed at this many bytes; a run of records read at once, at these.
PACKAGE_BYTES, RUN_BYTES = 256 << 20, 4 << 20
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
DATE = "2024-01-01T00:00:00Z"

MANIFEST = "path string, records bigint, bytes bigint"
RUNS = "path string, start bigint, length bigint, lengths array<bigint>"
RECORDS = "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


# ------------------------------------------------------------------- records


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member; a revisit (``refers_to`` set) has no payload."""
    name = f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~-._')}", f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head.insert(-2, f"WARC-Refers-To: <urn:page:{refers_to}>")
        head.insert(-2, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 4, mtime=0)


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode("utf-8").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def _page(name: str | None) -> int | None:
    return int(name[10:-1]) if name and name.startswith("<urn:page:") else None


def parse_record(member: bytes) -> tuple:
    """A row of ``RECORDS``; a response's payload is checked against its digest."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    warc = _fields(head)
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = warc["warc-payload-digest"].removeprefix("sha256:")
    size = int(_fields(http)["content-length"])
    if warc["warc-type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {warc['warc-record-id']}")
    return (
        _page(warc["warc-record-id"]), warc["warc-target-uri"], payload if warc["warc-type"] == "response" else None,
        size, digest, warc["warc-type"], _page(warc.get("warc-refers-to")),
    )


# ----------------------------------------------------------------------- ZIP


class Package:
    """The directory of a ZIP file behind ``read_at(length, offset)``."""

    def __init__(self, source):
        self.src = source
        size = source.size()
        tail_at = max(0, size - 65557)
        tail = source.read_at(size - tail_at, tail_at)
        at = tail.rfind(b"PK\x05\x06")
        while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
            at = tail.rfind(b"PK\x05\x06", 0, at)  # the mark stood in a comment
        if at < 0:
            raise ValueError("no ZIP end record")
        count, length, start = struct.unpack_from("<HII", tail, at + 10)
        if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
            locator = source.read_at(20, tail_at + at - 20)
            if locator[:4] != b"PK\x06\x07":
                raise ValueError("no ZIP64 locator")
            end = source.read_at(56, struct.unpack_from("<Q", locator, 8)[0])
            if end[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end record")
            count, length, start = struct.unpack_from("<QQQ", end, 32)
        self.members = self._central(source.read_at(length, start), count)

    @staticmethod
    def _central(data: bytes, count: int) -> dict[str, tuple[int, int, int]]:
        """Name to method, stored size and place of the local header."""
        out, at = {}, 0
        for _ in range(count):
            if data[at : at + 4] != b"PK\x01\x02":
                raise ValueError("damaged central directory")
            flags, method = struct.unpack_from("<HH", data, at + 8)
            packed, full, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", data, at + 20)
            local = struct.unpack_from("<I", data, at + 42)[0]
            name = data[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra = data[at + 46 + n_name : at + 46 + n_name + n_extra]
            while len(extra) >= 4:
                kind, n = struct.unpack_from("<HH", extra)
                if kind == 1:  # the ZIP64 field holds what did not fit, in this order
                    wide = list(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                    full = wide.pop(0) if full == 0xFFFFFFFF else full
                    packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                    local = wide.pop(0) if local == 0xFFFFFFFF else local
                extra = extra[4 + n :]
            out[name] = method, packed, local
            at += 46 + n_name + n_extra + n_comment
        return out

    def place(self, name: str) -> tuple[int, int]:
        """Offset and length of a stored member's bytes in the file."""
        method, size, local = self.members[name]
        if method != zipfile.ZIP_STORED:
            raise ValueError(f"{name} is compressed; only stored members can be range-read")
        head = self.src.read_at(30, local)
        if head[:4] != b"PK\x03\x04":
            raise ValueError(f"no local header for {name}")
        return local + 30 + sum(struct.unpack_from("<HH", head, 26)), size

    def read(self, name: str) -> bytes:
        at, size = self.place(name)
        return self.src.read_at(size, at)


class _Writer:
    def __init__(self, path: str):
        self.path, self.index, self.at = path, [], 0
        store, inside = open_store(path)
        store.create_dir(inside.rsplit("/", 1)[0], recursive=True)
        self.stream = store.open_output_stream(inside)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)

    def add(self, data: bytes, page_id: int | None, kind: str) -> None:
        self.member.write(data)
        self.index.append(f"{'-' if page_id is None else page_id} {kind} {self.at} {len(data)}\n")
        self.at += len(data)

    def close(self) -> dict:
        self.member.close()
        with self.zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as f:
            f.write("".join(self.index).encode())
        self.zip.close()
        self.stream.close()
        return {"path": self.path, "records": len(self.index), "bytes": self.at}


# --------------------------------------------------------------------- Spark


def _packages(batches: Iterator[pa.RecordBatch], base: str, package_bytes: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    schema = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
    writer = None
    for batch in batches:
        for page_id, url, html, digest, refers in zip(*(batch.column(i) for i in range(5))):
            if writer is None:
                writer = _Writer(f"{base}/pages-{part:07d}-{uuid.uuid4().hex[:8]}.zip")
            page_id, refers = page_id.as_py(), refers.as_py()
            payload = (html.as_py() or "").encode()
            writer.add(record(page_id, url.as_py(), payload, digest.as_py(), refers), page_id, "response" if refers is None else "revisit")
            if writer.at >= package_bytes:
                yield pa.RecordBatch.from_pylist([writer.close()], schema)
                writer = None
    if writer:
        yield pa.RecordBatch.from_pylist([writer.close()], schema)


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write the packages to the shared folder; returns their manifest.  Rows
    stay in the tasks that scan them: only digests are shuffled, and the
    groups of equal payloads come back by a join that Spark broadcasts while
    their table is under its threshold and shuffles beyond."""
    spark = pages.sparkSession
    ship_package(spark)
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"),
        F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).alias("n"),
    )
    groups = materialise(
        rows.where(F.col("n") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
        .where("copies > 1 AND first IS NOT NULL").select("digest", "first"),
        "warc-groups",
    )
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    marked = rows.join(groups, "digest", "left").select("page_id", "url", "html", "digest", refers.alias("refers_to"))
    base = scratch(spark, "warc")
    return materialise(marked.mapInArrow(lambda it: _packages(it, base, package_bytes), MANIFEST), "warc-manifest")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packages to runs of records, from their indexes."""
    for batch in batches:
        for path in batch.column(0).to_pylist():
            store, inside = open_store(path)
            with store.open_input_file(inside) as f:
                package = Package(f)
                base, _ = package.place(ARCHIVE)
                rows, start, lengths, n = [], None, [], 0
                for line in package.read(INDEX).decode().splitlines():
                    at, length = map(int, line.split(" ")[2:4])
                    if lengths and (n + length > RUN_BYTES or at != start + n):
                        rows.append((path, base + start, n, lengths))
                        start, lengths, n = None, [], 0
                    start = at if start is None else start
                    lengths.append(length)
                    n += length
                if lengths:
                    rows.append((path, base + start, n, lengths))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["path", "start", "length", "lengths"]
            )


def _records(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = [c.split()[0] for c in RECORDS.split(", ")]
    for batch in batches:
        for path, start, length, lengths in zip(*(batch.column(i).to_pylist() for i in range(4))):
            store, inside = open_store(path)
            with store.open_input_file(inside) as f:
                data = memoryview(f.read_at(length, start))
            rows, at = [], 0
            for n in lengths:
                row = parse_record(data[at : at + n])
                rows.append(row if payloads else (*row[:2], None, *row[3:]))
                at += n
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def read(spark: SparkSession, manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the packages, see ``RECORDS``."""
    ship_package(spark)
    runs = materialise(manifest.select("path").repartition(max(1, manifest.count())).mapInArrow(_runs, RUNS), "warc-runs")
    # runs are alike in size; dealing them out evenly lets a large package use all tasks
    spread = runs.repartition(max(1, min(runs.count(), 4 * spark.sparkContext.defaultParallelism)))
    return spread.mapInArrow(lambda it: _records(it, payloads), RECORDS)
