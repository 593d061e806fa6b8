"""WARC records in ZIP archives: written by tasks, read back by byte ranges without extraction."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import common

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
ROLL = 256 << 20
CHUNK = 4 << 20
DATE = "1970-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A WARC record, compressed by itself."""
    name = f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"
    head = [b"WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}".encode(), f"WARC-Record-ID: {name}".encode(), f"WARC-Date: {DATE}".encode()]
    if url:
        head.append(b"WARC-Target-URI: " + quote(url, safe="%/:=&?~#+!$,;'@()*[]").encode())
    head.append(f"WARC-Payload-Digest: sha1:{digest32(payload)}".encode())
    block = HTTP + f"Content-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    else:
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>".encode()]
    head += [b"Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}".encode()]
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
    return squeeze.compress(b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


class ArchiveWriter:
    """A ZIP archive with two stored members: the records, and an index of their offsets and lengths."""

    def __init__(self, uri: str) -> None:
        system, path = filesystem(uri)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.uri, self.index, self.at = uri, [], 0
        self.out = system.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(DATA, "w", force_zip64=True)

    def add(self, page_id: int | None, data: bytes) -> None:
        self.member.write(data)
        self.index.append(f"{'' if page_id is None else page_id} {self.at} {len(data)}\n")
        self.at += len(data)

    def close(self) -> tuple[str, int]:
        self.member.close()
        with self.zip.open(INDEX, "w", force_zip64=True) as member:
            member.write("".join(self.index).encode())
        self.zip.close()
        self.out.close()
        return self.uri, len(self.index)


def members(f) -> dict[str, tuple[int, int]]:
    """Place and size of each stored member's data, from the central directory and its ZIP64 fields."""
    size = f.size()
    tail_at = max(0, size - 65_557)
    f.seek(tail_at)
    tail = f.read(size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory: not a ZIP archive")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        (at,) = struct.unpack_from("<Q", tail, end - 20 + 8)
        if tail[end - 20 : end - 16] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        f.seek(at)
        big = f.read(56)
        if big[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack_from("<QQQ", big, 32)
    f.seek(start)
    directory, at, found = f.read(length), 0, {}
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("bad central directory entry")
        method, packed, full, n, extra, comment, local = struct.unpack_from("<10xH8xIIHHH8xI", directory, at)
        name = directory[at + 46 : at + 46 + n].decode()
        fields, k = directory[at + 46 + n : at + 46 + n + extra], 0
        while k + 4 <= len(fields):
            tag, m = struct.unpack_from("<HH", fields, k)
            if tag == 1:  # only the values that don't fit are there, in this order
                wide = iter(struct.unpack_from(f"<{m // 8}Q", fields, k + 4))
                full = next(wide) if full == 0xFFFFFFFF else full
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                local = next(wide) if local == 0xFFFFFFFF else local
            k += 4 + m
        if method == 0:
            f.seek(local)
            head = f.read(30)
            n_name, n_extra = struct.unpack_from("<HH", head, 26)
            found[name] = (local + 30 + n_name + n_extra, packed)
        at += 46 + n + extra + comment
    return found


def parse(raw: bytes) -> tuple[int | None, int, str, str, int | None]:
    """(page_id, payload bytes, payload digest, type, refers_to) of an uncompressed record; a response is checked against its digest."""
    head, _, block = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, v in (x.split(b": ", 1) for x in lines[1:])}
    block = block[: int(fields[b"content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest = fields[b"warc-payload-digest"].decode().removeprefix("sha1:")
    kind = fields[b"warc-type"].decode()
    if kind == "response" and (len(payload) != size or digest32(payload) != digest):
        raise ValueError("payload doesn't match its digest")
    number = lambda name: int(m[10:-1]) if (m := fields.get(name, b"")).startswith(b"<urn:page:") else None
    return number(b"warc-record-id"), size, digest, kind, number(b"warc-refers-to")


def write_archives(pages: DataFrame, base: str) -> DataFrame:
    """Write a record for each page into archives under ``base``; their names and record counts, as a stored table.

    Of pages with equal payloads (null html: no bytes) the largest page_id is the response and
    the others are revisits of it. Digests travel without payloads: only the list of revisits
    meets the pages again. A row with a null page_id is a response, and so is each repeated row
    of a response. A task that runs again writes archives of new names, and only those of the
    tasks that ended are listed.
    """
    spark = pages.sparkSession
    common.small_batches(spark)
    html = F.coalesce("html", F.lit("")).cast("binary")
    thin = pages.select("page_id", F.unhex(F.sha1(html)).alias("sha"))
    last = thin.groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    revisits = thin.join(last, "sha").where("page_id < refers_to").groupBy("page_id").agg(F.max("refers_to").alias("refers_to"))
    plan = pages.select("page_id", "url", "html").join(revisits, "page_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, writer = [], None
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                if writer is None or writer.at > ROLL:
                    done += [writer.close()] if writer else []
                    writer = ArchiveWriter(f"{base}/{uuid.uuid4().hex}.wacz")
                writer.add(page_id, record(page_id, url, (html or "").encode(), refers_to))
        done += [writer.close()] if writer else []
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], names=["path", "n"])

    return common.materialise(plan.mapInArrow(run, "path string, n long"), "warc-manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of every record of the listed archives.

    A first pass reads each archive's directory and index and cuts its records into ranges; a
    second reads the ranges, which any task can do. No member is extracted.
    """

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, local = filesystem(path)
                with system.open_input_file(local) as f:
                    found = members(f)
                    (data, _), (at, size) = found[DATA], found[INDEX]
                    f.seek(at)
                    index = [tuple(map(int, x.rsplit(b" ", 2)[1:])) for x in f.read(size).splitlines()]
                out, first, length = [], 0, 0
                for start, n in index:
                    if length and length + n > CHUNK:
                        out.append((data + first, length))
                        first, length = start, 0
                    length += n
                if length:
                    out.append((data + first, length))
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(out), pa.string()), *(pa.array([x[k] for x in out], pa.int64()) for k in (0, 1))], names=["path", "start", "length"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, local = filesystem(path)
                with system.open_input_file(local) as f:
                    f.seek(start)
                    data = f.read(length)
                rows = []
                while data:
                    stream = zlib.decompressobj(31)
                    rows.append(parse(stream.decompress(data)))
                    data = stream.unused_data
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    places = manifest.select("path").mapInArrow(ranges, "path string, start long, length long").repartition(manifest.sparkSession.sparkContext.defaultParallelism * 4)
    return places.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
