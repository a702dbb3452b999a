"""WARC archives of pages: a writer that stores equal payloads once, and a splittable reader.

Every record is a gzip member of its own, so archives can be read from the
middle: a reading task looks through its range of bytes for the mark of a gzip
member, takes a place for a record's start only if the bytes there decode to a
WARC header, and owns the records that start in its range, whose end may lie
beyond it. Payloads are UTF-8 text, in which the mark (a control byte followed
by a continuation byte) cannot occur, so even an uncompressed deflate block
cannot hold a false start.

Of records with equal payloads of at least ``min_bytes`` bytes the one with the
largest page_id is a ``response`` and the others are ``revisit`` records, which
keep the HTTP header, hence the payload's length, and no payload.

Null html is an empty payload. A null page_id never is the largest; payloads that
only such pages have are all responses, and so are repeated rows of the largest
page_id. Control characters of a URL are percent-encoded and a null URL is empty.
An empty table gives no archives and no rows. Payloads of any length are one record
each. Other columns are ignored, whatever their names. Archives are written under a name
of the attempt and renamed; a task that runs again replaces its file.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remitlens.llm.common import file_system, importable, text_or_empty

MAGIC = b"\x1f\x8b\x08"
#: Bytes of a split and of one read; decoded bytes that must show a header for a start to count.
SPLIT_BYTES, READ_BYTES, HEADER_BYTES = 8 << 20, 1 << 20, 7
DATE = "2024-01-01T00:00:00Z"
PAGE_URN = "urn:remitlens:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<{PAGE_URN}{'none' if page_id is None else page_id}>"


def _page(urn: str | None) -> int | None:
    name = urn.strip("<>").removeprefix(PAGE_URN) if urn else "none"
    return None if name == "none" else int(name)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A gzip member that holds one WARC record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = re.sub(r"[\x00-\x20\x7f%]", lambda m: quote(m[0], safe=""), url or "")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        *([f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {PROFILE}"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """A record's headers (names in lower case) and its block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(headers["content-length"])
    if len(rest) < size:
        raise ValueError("a WARC record is shorter than its length")
    return headers, rest[:size]


class _Window:
    """A part of a file that slides forward; ``at`` gives the bytes from a position on."""

    def __init__(self, file, start: int):
        self.file, self.start, self.data = file, start, b""
        file.seek(start)

    def more(self) -> bool:
        got = self.file.read(READ_BYTES)
        self.data += got
        return bool(got)

    def forget(self, before: int) -> None:
        self.data, self.start = self.data[before - self.start :], before

    def find(self, position: int, end: int) -> int | None:
        """The next mark at or after ``position`` and before ``end``."""
        while True:
            i = self.data.find(MAGIC, position - self.start)
            if i >= 0:
                return self.start + i if self.start + i < end else None
            position = max(position, self.start + len(self.data) - len(MAGIC) + 1)
            if position >= end:
                return None
            self.forget(min(position, self.start + len(self.data)))
            if not self.more():
                return None


def members(file, start: int, end: int) -> Iterator[bytes]:
    """The decoded records that start at positions from ``start`` to before ``end`` of an archive."""
    window, position = _Window(file, start), start
    while (found := window.find(position, end)) is not None:
        window.forget(found)
        unpacker, out, fed = zlib.decompressobj(31), [], 0
        header = b""
        try:
            while len(header) < HEADER_BYTES and not unpacker.eof:
                if fed == len(window.data) and not window.more():
                    break
                piece = window.data[fed : fed + 64]
                header += unpacker.decompress(piece)
                fed += len(piece)
        except zlib.error:
            header = b""
        if not header.startswith(b"WARC/1."):
            position = found + 1
            continue
        out.append(header)
        while not unpacker.eof:
            if fed == len(window.data) and not window.more():
                raise ValueError(f"the record at {found} has no end")
            out.append(unpacker.decompress(window.data[fed:]))
            fed = len(window.data)
        position = found + fed - len(unpacker.unused_data)
        window.forget(position)
        yield b"".join(out)


def write(pages: DataFrame, folder: str, min_bytes: int = 0) -> list[dict]:
    """Write a record for every row of ``pages`` (page_id, url, html); returns the manifest, a row for each archive."""
    importable(pages.sparkSession)
    html = text_or_empty("html")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("sha1"))
    again = rows.where(F.octet_length("html") >= min_bytes).groupBy("sha1").agg(F.max("page_id").alias("largest"), F.count("*").alias("n"))
    again = again.where("n > 1 and largest is not null").select("sha1", "largest")
    rows = rows.join(again, "sha1", "left").select("page_id", "url", "html", "largest")

    def run(batches):
        task = TaskContext.get()
        system, root = file_system(folder)
        name, out, n, size = f"part-{task.partitionId():05d}.warc.gz", None, 0, 0
        mark = f"{task.taskAttemptId()}.part"
        for batch in batches:
            for r in range(batch.num_rows):
                page_id, url, text, largest = (batch.column(k)[r].as_py() for k in range(4))
                if out is None:
                    system.create_dir(root, recursive=True)
                    out = system.open_output_stream(f"{root}/{name}.{mark}")
                made = record(page_id, url, text.encode(), largest, largest is not None and page_id != largest)
                out.write(made)
                n += 1
                size += len(made)
        if out is not None:
            out.close()
            system.move(f"{root}/{name}.{mark}", f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["file", "n_records", "bytes"])

    manifest = sorted((r.asDict() for r in rows.mapInArrow(run, "file string, n_records long, bytes long").collect()), key=lambda r: r["file"])
    system, root = file_system(folder)
    system.create_dir(root, recursive=True)
    with system.open_output_stream(f"{root}/_manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def read(spark: SparkSession, folder: str, payload: bool = False, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """A row for each record of the archives under ``folder``, with its payload (binary, null for a revisit) if wanted.

    The digest of every payload that is there is computed anew and compared with the record's.
    """
    importable(spark)
    system, root = file_system(folder)
    with system.open_input_stream(f"{root}/_manifest.json") as f:
        manifest = json.loads(f.read())
    splits = [(r["file"], at, min(at + split_bytes, r["bytes"])) for r in manifest for at in range(0, r["bytes"], split_bytes)]
    rows = spark.createDataFrame(splits, "file string, start long, end long")
    if splits:
        rows = rows.repartitionByRange(len(splits), "file", "start")
    schema = RECORD + (", payload binary" if payload else "")

    def made(held):
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=False)], names=[x.split()[0] for x in schema.split(", ")])

    def run(batches):
        system, root = file_system(folder)
        for batch in batches:
            for split in batch.to_pylist():
                held, size = [], 0
                with system.open_input_file(f"{root}/{split['file']}") as f:
                    for data in members(f, split["start"], split["end"]):
                        held.append(_row(data)[: 6 + payload])
                        size += len(data) if payload else 200
                        if size >= READ_BYTES:
                            yield made(held)
                            held, size = [], 0
                if held:
                    yield made(held)

    return rows.mapInArrow(run, schema)


def _row(data: bytes) -> tuple:
    headers, block = parse(data)
    http, _, body = block.partition(b"\r\n\r\n")
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    revisit = headers["warc-type"] == "revisit"
    size = int(re.search(rb"(?im)^content-length:\s*(\d+)", http)[1])
    if not revisit and (len(body) != size or payload_digest(body) != digest):
        raise ValueError(f"the payload of {headers['warc-record-id']} is damaged")
    refers = _page(headers.get("warc-refers-to")) if revisit else None
    return _page(headers["warc-record-id"]), unquote(headers["warc-target-uri"]), size, digest, headers["warc-type"], refers, None if revisit else body


#: Base32 of a SHA-1 from its hex digits: five of them are 20 bits, hence four characters.
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, {5 * i + 1}, 5) AS BIGINT) >> {15 - 5 * j}) & 31 AS INTEGER) + 1, 1)"
    for i in range(8)
    for j in range(4)
)
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     h AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS hex FROM p),
     k AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS largest FROM h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN largest IS NULL OR page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN largest IS NULL OR page_id = largest THEN NULL ELSE largest END AS refers_to
FROM k
"""
