"""WARC records in ZIP packages, written by tasks and read back by byte ranges.

A package is a ZIP file with two stored (not compressed) members: ``archive/data.warc.gz``, the records, each compressed on its
own, and ``indexes/index.cdxj``, one line per record with its offset and length in the first member. Writers stream rows into
packages in the shared scratch folder. A package counts when its path is in the written list of them, which only finished tasks
add to; what a lost task left is never read.

The reader opens no archive as a whole. From the end of a package it reads the end record, the ZIP64 locator and end
record if there are any, and the central directory; it finds the stored members by their local headers and reads the
index. That gives one row per record: package, offset, length. These rows are dealt anew by their place, and each task reads its byte ranges,
neighbours in one read, decompresses record by record, parses the headers and checks payload digests.

Of rows with equal payloads of at least ``least`` bytes, that with the smallest id is a ``response``; the others are ``revisit`` records that
refer to it and hold the HTTP headers only, whose Content-Length is that of the full payload. Rows with the same id
and payload are all responses. A row without id is a revisit where a row with an id has its payload, else a response. A null payload
is empty, a null url is an empty target; other characters of urls than visible ASCII are percent-encoded. An empty table gives no rows; other columns are not read. Long payloads are compressed and read whole, one at a time.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.arrow import arrow_schema
from evalspark.scratch import materialize, new_folder

LEAST = 100  # bytes of a payload that revisits may refer to
MEMBER, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PACKAGES = "path string, records bigint, bytes bigint"
PLACES = "path string, offset bigint, length bigint"
RECORDS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"
READ = 8 << 20  # bytes of neighbouring records read at once
PIECE = 32 << 20  # bytes of records for one reading task, about
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_LEVEL = 1  # of compression
_PLAIN = "".join(map(chr, range(0x21, 0x7F)))  # characters of a url that stay as they are

# Fixed values of the ZIP format.
_END, _END64, _LOCATOR64, _ENTRY, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
_MAX16, _MAX32, _ZIP64, _STORED = 0xFFFF, 0xFFFFFFFF, 0x0001, 0


def shared(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder or file and its path there."""
    if uri.startswith("file:"):
        uri = "file:///" + uri[5:].lstrip("/")
    elif uri.startswith("s3a:"):
        uri = "s3:" + uri[4:]
    return fs.FileSystem.from_uri(uri)


# ---------- writing ----------

def record_id(page_id: int | None, digest: str) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}"


def record(page_id: int | None, url: str, payload: bytes, size: int, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record, not yet compressed. A revisit has the HTTP headers only."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block += b"" if revisit else payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{record_id(page_id, digest)}>",
             "WARC-Target-URI: " + quote(url, safe=_PLAIN), "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha256:{digest}"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{record_id(refers_to, digest)}>", f"X-Refers-To-Page-ID: {refers_to}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_package(out, rows: Iterator[dict]) -> int:
    """Stream ``rows`` into a package; returns the number of records. ``out`` is written once, front to back."""
    index, at, n = [], 0, 0
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as package:
        with package.open(MEMBER, "w", force_zip64=True) as member:
            for r in rows:
                data = gzip.compress(record(**r), _LEVEL, mtime=0)
                member.write(data)
                index.append(f"{r['digest']} {json.dumps({'offset': at, 'length': len(data)})}\n")
                at, n = at + len(data), n + 1
        with package.open(INDEX, "w", force_zip64=True) as member:
            for line in index:
                member.write(line.encode())
    return n


def write_packages(rows: DataFrame, folder: str) -> DataFrame:
    """``path, records, bytes`` of the packages of ``rows`` (page_id, url, payload, size, digest, refers_to, revisit), one for each task that has rows."""
    schema = arrow_schema(PACKAGES)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for batch in batches:
                # row by row: only one payload is copied at a time
                for i in range(batch.num_rows):
                    r = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                    yield r | {"payload": r["payload"] or b""}

        rows_ = each()
        first = next(rows_, None)
        if first is None:
            return
        store, path = shared(folder)
        store.create_dir(path, recursive=True)
        name = f"package-{uuid.uuid4().hex}.zip"  # a fresh one for each attempt
        with store.open_output_stream(f"{path}/{name}") as out:
            n = write_package(out, _chain(first, rows_))
        yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "records": n, "bytes": store.get_file_info(f"{path}/{name}").size}], schema=schema)

    return materialize(rows.mapInArrow(write, PACKAGES), "packages")


def _chain(first: dict, rest: Iterator[dict]) -> Iterator[dict]:
    yield first
    yield from rest


# ---------- reading ----------

def _read(file, offset: int, length: int) -> bytes:
    file.seek(offset)
    return file.read(length)


def directory(file, size: int) -> tuple[int, int, int]:
    """Entries, offset and length of the central directory, from the end records of a package."""
    tail_at = max(0, size - (22 + _MAX16))
    tail = _read(file, tail_at, size - tail_at)
    at = tail.rfind(_END)
    while at >= 0:  # the comment that may follow has its length in the record and may hold the signature too
        if len(tail) - at >= 22 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
            break
        at = tail.rfind(_END, 0, at)
    if at < 0:
        raise ValueError("no end record of a ZIP directory")
    entries, length, offset = struct.unpack_from("<HII", tail, at + 10)
    if tail_at + at >= 20:
        locator = _read(file, tail_at + at - 20, 20)
        if locator[:4] == _LOCATOR64 and (entries == _MAX16 or _MAX32 in (length, offset)):
            end = _read(file, struct.unpack_from("<Q", locator, 8)[0], 56)
            if end[:4] != _END64:
                raise ValueError("the ZIP64 locator points at no end record")
            entries, length, offset = struct.unpack_from("<QQQ", end, 32)
    return entries, offset, length


def members(file, size: int) -> dict[str, tuple[int, int]]:
    """Offset and length of the data of each stored member. Another way of storage is refused by name."""
    entries, at, length = directory(file, size)
    data, found, i = _read(file, at, length), {}, 0
    for _ in range(entries):
        if data[i:i + 4] != _ENTRY:
            raise ValueError("broken central directory")
        method, = struct.unpack_from("<H", data, i + 10)
        packed, whole = struct.unpack_from("<II", data, i + 20)
        n_name, n_extra, n_comment = struct.unpack_from("<HHH", data, i + 28)
        header, = struct.unpack_from("<I", data, i + 42)
        name = data[i + 46:i + 46 + n_name].decode()
        extra, j = data[i + 46 + n_name:i + 46 + n_name + n_extra], 0
        while j + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, j)
            if kind == _ZIP64:  # holds, in this order, only the values that didn't fit
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, j + 4))
                whole = next(wide) if whole == _MAX32 else whole
                packed = next(wide) if packed == _MAX32 else packed
                header = next(wide) if header == _MAX32 else header
            j += 4 + n
        if method != _STORED:
            raise ValueError(f"member {name} is compressed; only stored members can be read by ranges")
        local = _read(file, header, 30)
        if local[:4] != _LOCAL:
            raise ValueError(f"no local header of member {name}")
        found[name] = (header + 30 + sum(struct.unpack_from("<HH", local, 26)), packed)
        i += 46 + n_name + n_extra + n_comment
    return found


def locate(packages: DataFrame) -> DataFrame:
    """``path, offset, length`` of every record, from the directories and indexes of the packages (``path``)."""
    schema = arrow_schema(PLACES)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store, path = shared(uri)
                with store.open_input_file(path) as file:
                    found = members(file, file.size())
                    data_at, _ = found[MEMBER]
                    lines = _read(file, *found[INDEX]).decode().splitlines()
                spots = [json.loads(line.split(" ", 1)[1]) for line in lines]
                yield pa.RecordBatch.from_arrays([
                    pa.array([uri] * len(spots)), pa.array([data_at + s["offset"] for s in spots], pa.int64()),
                    pa.array([s["length"] for s in spots], pa.int64())], schema=schema)

    return packages.select("path").mapInArrow(places, PLACES)


def parse(data: bytes) -> dict:
    """The fields of one record; a digest that isn't that of its payload is an error by name."""
    head, _, block = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record at this place")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = block[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload and digest of {fields['WARC-Record-ID']} differ")
    number = lambda name: int(fields[name]) if name in fields else None
    return {"page_id": number("X-Page-ID"), "url": fields["WARC-Target-URI"], "payload_bytes": size, "payload_digest": digest,
            "record_type": kind, "refers_to": number("X-Refers-To-Page-ID"), "payload": None if kind == "revisit" else payload}


def _spans(places: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Neighbouring places of a package as one read: path, offset, length and the records in it."""
    span = None
    for path, offset, length in places:
        if span and span[0] == path and span[1] + span[2] == offset and span[2] + length <= READ:
            span[3].append((span[2], length))
            span[2] += length
            continue
        if span:
            yield tuple(span)
        span = [path, offset, length, [(0, length)]]
    if span:
        yield tuple(span)


def read_records(places: DataFrame, payloads: bool = True) -> DataFrame:
    """The records at ``places``; without ``payloads`` that column is null, and texts are checked in the task but not returned."""
    schema = arrow_schema(RECORDS)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            for uri, offset, length, parts in _spans(list(zip(*(c.to_pylist() for c in batch.columns)))):
                if uri != name:
                    store, path = shared(uri)
                    name, file = uri, store.open_input_file(path)
                data = _read(file, offset, length)
                found = [parse(gzip.decompress(data[a:a + n])) for a, n in parts]
                if not payloads:
                    for r in found:
                        r["payload"] = None
                yield pa.RecordBatch.from_pylist(found, schema=schema)

    total = places.agg(F.sum("length")).first()[0] or 0
    dealt = places.repartitionByRange(max(1, -(-total // PIECE)), "path", "offset").sortWithinPartitions("path", "offset")
    return dealt.mapInArrow(read, RECORDS)


# ---------- the round trip ----------

def verdicts(pages: DataFrame, id_col: str, url_col: str, html_col: str, least: int) -> DataFrame:
    """Rows as ``write_packages`` takes them: each payload with its digest and what it refers to."""
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"),
                        payload.alias("payload"), F.octet_length(payload).cast("bigint").alias("size"), F.sha2(payload, 256).alias("digest"))
    large = F.col("size") >= least
    shared_by = (rows.filter(large).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
                 .filter("n > 1 AND first IS NOT NULL").select(F.col("digest").alias("key"), "first"))
    # Small payloads meet nothing; they are dealt by their ids, however many are equal.
    key = F.when(large, F.col("digest")).otherwise(F.concat(F.lit("#"), F.coalesce(F.col("page_id"), F.lit(0))))
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    joined = rows.withColumn("key", key).join(shared_by, "key", "left")
    return joined.select("page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "size", "digest",
                         F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST,
            folder: str | None = None) -> DataFrame:
    """Write one record per row into packages; returns the written list of them."""
    folder = folder or new_folder(pages.sparkSession, "warc")
    return write_packages(verdicts(pages, id_col, url_col, html_col, least), folder)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` per row, as read back from the packages."""
    places = materialize(locate(archive(pages, id_col, url_col, html_col, least)), "record-places")
    return read_records(places, payloads=False).select(
        F.col("page_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to")
