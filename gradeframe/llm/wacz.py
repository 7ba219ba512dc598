"""WARC records in ZIP-packaged archives, written and range-read by tasks.

An archive is a ZIP file of stored members: ``archive/data.warc.gz`` (one gzip
member per record), ``indexes/index.cdx`` (one line per record: key, type,
offset, length) and ``datapackage.json``. The reader parses the central
directory, with ZIP64 fields where sizes need them, finds the stored WARC and
index members, and reads records by byte range; nothing is extracted.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeframe.llm.shared import shared_folder, written

DATA, INDEX, PACKAGE = "archive/data.warc.gz", "indexes/index.cdx", "datapackage.json"
#: Payloads from this size on are written once.
REVISIT_BYTES = 100
#: Records that one range task reads.
RANGE_RECORDS = 500
#: Fixed values of the ZIP format: signatures and markers.
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
#: Fixed value of the WARC format: how a revisit names its kind.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


class Member(NamedTuple):
    name: str
    method: int
    size: int
    stored: int
    header: int


class Range:
    """Reads of byte ranges of one file, counted so that tests can see them."""

    def __init__(self, file):
        self.file, self.size, self.bytes_read = file, file.size(), 0

    def at(self, offset: int, length: int) -> bytes:
        if offset < 0 or length < 0 or offset + length > self.size:
            raise ValueError(f"bytes {offset} to {offset + length} of {self.size}")
        self.file.seek(offset)
        data = self.file.read(length)
        self.bytes_read += len(data)
        return data


def members(file: Range) -> list[Member]:
    """The central directory of a ZIP file, plain or ZIP64."""
    tail_at = max(0, file.size - 22 - FULL16)
    tail = file.at(tail_at, file.size - tail_at)
    place = tail.rfind(END)
    while place >= 0 and place + 22 + struct.unpack_from("<H", tail, place + 20)[0] != len(tail):
        place = tail.rfind(END, 0, place)
    if place < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, place + 10)
    if FULL16 == count or FULL32 in (length, start):
        locator = file.at(tail_at + place - 20, 20)
        if locator[:4] != LOCATOR64:
            raise ValueError("no ZIP64 locator")
        end = file.at(struct.unpack_from("<Q", locator, 8)[0], 56)
        if end[:4] != END64:
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack_from("<QQQ", end, 32)
    directory, at, found = file.at(start, length), 0, []
    for _ in range(count):
        if directory[at : at + 4] != CENTRAL:
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", directory, at + 8)
        stored, size, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", directory, at + 20)
        header = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, e = directory[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while e + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, e)
            if kind == 1:  # ZIP64: only the fields that are full, in this order
                field = e + 4
                if size == FULL32:
                    size, field = struct.unpack_from("<Q", extra, field)[0], field + 8
                if stored == FULL32:
                    stored, field = struct.unpack_from("<Q", extra, field)[0], field + 8
                if header == FULL32:
                    header = struct.unpack_from("<Q", extra, field)[0]
            e += 4 + n
        found.append(Member(name, method, size, stored, header))
        at += 46 + n_name + n_extra + n_comment
    return found


def data_start(file: Range, member: Member) -> int:
    """Where a stored member's bytes begin, by its local header."""
    if member.method != 0 or member.size != member.stored:
        raise ValueError(f"{member.name} is not stored")
    local = file.at(member.header, 30)
    if local[:4] != LOCAL:
        raise ValueError("no local header")
    n_name, n_extra = struct.unpack_from("<HH", local, 26)
    return member.header + 30 + n_name + n_extra


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, length: int, refers_to: int | None) -> bytes:
    """One response, or with ``refers_to`` one revisit, which has the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page {page_id} {digest}')}>",
        "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-ID: {refers_to}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Named fields, block and payload of one WARC record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return {"fields": fields, "payload": payload, "length": length}


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((tuple(v.as_py() for v in row)) for batch in batches for row in zip(*(batch.column(c) for c in ("page_id", "url", "html", "digest", "bytes", "refers_to")), strict=True))
        first = next(rows, None)
        if first is None:
            return
        store, base = fs.FileSystem.from_uri(folder)
        # A retried task writes another file; only files named in the result are read.
        path = f"{base}/{uuid.uuid4().hex}.wacz"
        index, at, n = io.StringIO(), 0, 0
        with store.open_output_stream(path, compression=None) as sink, zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED) as archive:
            with archive.open(DATA, "w", force_zip64=True) as data:
                row = first
                while row is not None:
                    page_id, url, html, digest, length, refers_to = row
                    record = gzip.compress(warc_record(page_id, url, (html or "").encode(), digest, length, refers_to), 4, mtime=0)
                    data.write(record)
                    index.write(f"{'' if page_id is None else page_id} {'response' if refers_to is None else 'revisit'} {at} {len(record)}\n")
                    at, n, row = at + len(record), n + 1, next(rows, None)
            archive.writestr(INDEX, index.getvalue())
            archive.writestr(PACKAGE, json.dumps({"profile": "data-package", "resources": [{"path": DATA}, {"path": INDEX}], "records": n}))
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["path", "n_records"])

    return run


def _index(folder: str, records: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with store.open_input_file(path) as opened:
                    file = Range(opened)
                    by_name = {m.name: m for m in members(file)}
                    data = data_start(file, by_name[DATA])
                    lines = file.at(data_start(file, by_name[INDEX]), by_name[INDEX].size).decode().splitlines()
                places = [tuple(map(int, line.split(" ")[-2:])) for line in lines]
                # Each range holds consecutive records and ends where its last one does.
                for i in range(0, len(places), records):
                    group = places[i : i + records]
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([data], pa.int64()), pa.array([[x[0] for x in group]], pa.list_(pa.int64())), pa.array([[x[1] for x in group]], pa.list_(pa.int64()))], ["path", "data", "offsets", "lengths"])

    return run


def _read(folder: str, keep_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            for path, data, offsets, lengths in zip(*(batch.column(c).to_pylist() for c in ("path", "data", "offsets", "lengths")), strict=True):
                with store.open_input_file(path) as opened:
                    file, out = Range(opened), []
                    for offset, length in zip(offsets, lengths, strict=True):
                        record = parse_record(gzip.decompress(file.at(data + offset, length)))
                        fields, payload = record["fields"], record["payload"]
                        digest = fields["warc-payload-digest"].removeprefix("sha256:")
                        response = fields["warc-type"] == "response"
                        if response and (len(payload) != record["length"] or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError(f"{path}: record at {offset} is damaged")
                        page, refers = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
                        out.append((page and int(page), record["length"], digest, fields["warc-type"], refers and int(refers), fields.get("warc-target-uri"), payload if keep_payload and response else None))
                        if sum(len(x[6] or b"") for x in out[-1:]) > 1 << 20:
                            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in out], schema)
                            out = []
                    if out:
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in out], schema)

    return run


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to archives below ``folder``, a URI; gives (path, n_records).

    Of pages with equal payloads of at least REVISIT_BYTES bytes the smallest
    page_id is written as response, the others as revisits that name it. Null
    html is an empty payload; smaller payloads are all responses. Rows that
    repeat that smallest page_id are responses too; a null page_id is larger
    than any other, and if all are null, all are responses.
    """
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("digest"), F.octet_length(html).cast("long").alias("bytes"))
    light = pages.select("page_id", F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("bytes")).where(F.col("bytes") >= REVISIT_BYTES)
    first = light.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 and first_id is not null").select("digest", "first_id")
    again = (F.col("bytes") >= REVISIT_BYTES) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    told = rows.join(first, "digest", "left").withColumn("refers_to", F.when(again, F.col("first_id")))
    sent = told.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), "digest", "bytes", "refers_to")
    return written(sent.mapInArrow(_write(folder), "path string, n_records long"), "archives")


def read_archives(archives: DataFrame, folder: str, keep_payload: bool = True, records: int = RANGE_RECORDS) -> DataFrame:
    """The records of archives (path) below ``folder``, by READ; payload is null for revisits, or if it is not wanted.

    Ranges of an archive are read by different tasks. A payload that differs
    from its digest or length is an error.
    """
    ranges = archives.select("path").repartition(F.col("path")).mapInArrow(_index(folder, records), "path string, data long, offsets array<long>, lengths array<long>")
    return ranges.repartition(F.col("path"), F.element_at("offsets", 1)).mapInArrow(_read(folder, keep_payload), READ)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read the records back: (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    folder = shared_folder(pages.sparkSession, "wacz")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    archives = write_archives(pages, folder)
    return read_archives(archives, folder, keep_payload=False).drop("url", "payload")
