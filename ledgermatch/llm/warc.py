"""Web archives packed in ZIP files: written by many tasks, read by byte ranges.

A package holds ``archive/data.warc.gz`` (one gzip member per record) and
``indexes/index.cdxj`` (one line per record with offset and length), both stored, not
deflated. The reader takes the central directory from the end of the file (with
its ZIP64 form), finds where the stored members lie, reads the index, and then
reads only the byte ranges of records; nothing is unpacked to disk.

Packages lie in the shared folder. Each task writes under a name of its own, and a
package counts only once it is listed in the manifest, a table that Spark commits as a whole;
a task that runs twice leaves a file that nobody reads.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermatch.llm.shared import fresh_path, materialise

#: A payload of fewer bytes is always written in full.
REVISIT_BYTES = 1000
#: A task begins a new package after this many bytes of records.
PACKAGE_BYTES = 128 << 20
#: Records are handed to readers in byte ranges of about this size.
RANGE_BYTES = 4 << 20
_ROWS = 256

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"
_RECORD_ID = "<urn:ledgermatch:page:{}>"


# --- writing ---


def _record_id(page_id: int | None) -> str:
    return _RECORD_ID.format("" if page_id is None else page_id)


def record(page_id: int | None, url: str | None, payload: bytes, sha1: bytes, size: int, refers_to: int | None) -> bytes:
    """One WARC record. A revisit keeps the HTTP head, with the length of the payload that it leaves out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {_DATE}"]
    if url is not None:
        safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        head.append(f"WARC-Target-URI: {safe}")
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}")
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Package:
    """A ZIP file being written."""

    def __init__(self, folder: str) -> None:
        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        name = f"{uuid.uuid4().hex}.wacz"
        self.path, self.index, self.at = f"{folder}/{name}", [], 0
        self._stream = system.open_output_stream(f"{path}/{name}", buffer_size=1 << 20)
        self._zip = zipfile.ZipFile(self._stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self._member = self._zip.open("archive/data.warc.gz", "w", force_zip64=True)

    def add(self, content: bytes, page_id: int | None, url: str | None) -> None:
        packer = zlib.compressobj(3, zlib.DEFLATED, 31)
        packed = packer.compress(content) + packer.flush()
        self._member.write(packed)
        self.index.append(f"{page_id} {json.dumps({'url': url, 'offset': self.at, 'length': len(packed)})}\n")
        self.at += len(packed)

    def close(self) -> dict:
        self._member.close()
        self._zip.writestr("indexes/index.cdxj", "".join(self.index))
        self._zip.close()
        size = self._stream.tell()
        self._stream.close()
        return {"path": self.path, "bytes": size, "records": len(self.index)}


def _writer(folder: str, package_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, done = None, []
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                for x in batch.slice(at, _ROWS).to_pylist():
                    package = package or _Package(folder)
                    payload = x["payload"] or b""
                    package.add(record(x["page_id"], x["url"], payload, bytes.fromhex(x["digest"]), x["bytes"], x["refers_to"]), x["page_id"], x["url"])
                    if package.at >= package_bytes:
                        done.append(package.close())
                        package = None
        if package:
            done.append(package.close())
        yield pa.RecordBatch.from_pylist(done, pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

    return run


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, bytes, digest (SHA-1 in hex) and refers_to of each page.

    Among equal payloads of REVISIT_BYTES or more that with the largest page_id is the
    response. Rows without page_id refer to it too; if no row of the group has one, all
    are responses, and so are all rows that share the largest page_id.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    hashed = pages.select("page_id", "url", payload.alias("payload")).withColumns(
        {"bytes": F.octet_length("payload").cast("long"), "digest": F.sha1("payload")}
    )
    groups = (
        hashed.where(F.col("bytes") >= REVISIT_BYTES)
        .groupBy(F.col("digest").alias("copied"))
        .agg(F.max("page_id").alias("first_id"), F.count("*").alias("copies"))
        .where("copies > 1 and first_id is not null")
    )
    # One row per digest on the right, so adaptive execution can split a hot digest on the left.
    other = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    return hashed.join(groups, (F.col("digest") == F.col("copied")) & (F.col("bytes") >= REVISIT_BYTES), "left").select(
        "page_id", "url", F.when(other.isNull(), F.col("payload")).alias("payload"), "bytes", "digest", other.alias("refers_to")
    )


def write_packages(pages: DataFrame, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write pages (page_id, url, html) as packages; the manifest (path, bytes, records) of those written."""
    folder = fresh_path(pages.sparkSession, "packages")
    rows = with_revisits(pages).mapInArrow(_writer(folder, package_bytes), "path string, bytes long, records long")
    return materialise(rows, "manifest")


# --- reading ---


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    start: int  # of its content
    size: int


def _extra64(extra: bytes, *values: int) -> list[int]:
    """Values of which those at their limit are taken from the ZIP64 extra field, in its order."""
    out, at = list(values), 0
    wide = b""
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            wide = extra[at + 4 : at + 4 + size]
        at += 4 + size
    at = 0
    for i, v in enumerate(out):
        if v == 0xFFFFFFFF:
            (out[i],) = struct.unpack_from("<Q", wide, at)
            at += 8
    return out


def directory(source: pa.NativeFile, size: int) -> list[Member]:
    """Members of a ZIP file by its central directory, ZIP64 or not; only the directory is read."""

    def read(start: int, n: int) -> bytes:
        source.seek(start)
        return source.read(n)

    tail_at = max(0, size - (1 << 16) - 22)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("not a ZIP file: no end of central directory")
    entries, length, start = struct.unpack_from("<HII", tail, end + 10)
    locator = read(max(0, tail_at + end - 20), 20)
    if locator[:4] == b"PK\x06\x07":
        (at,) = struct.unpack_from("<Q", locator, 8)
        wide = read(at, 56)
        if wide[:4] != b"PK\x06\x06":
            raise ValueError("broken ZIP64 end of central directory")
        entries, length, start = struct.unpack_from("<QQQ", wide, 32)
    table, at, out = read(start, length), 0, []
    for _ in range(entries):
        if table[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method = struct.unpack_from("<H", table, at + 10)[0]
        packed, plain, n, extra, comment = struct.unpack_from("<IIHHH", table, at + 20)
        local = struct.unpack_from("<I", table, at + 42)[0]
        name = table[at + 46 : at + 46 + n].decode()
        plain, packed, local = _extra64(table[at + 46 + n : at + 46 + n + extra], plain, packed, local)
        head = read(local, 30)
        start_of_content = local + 30 + sum(struct.unpack_from("<HH", head, 26))
        out.append(Member(name, method, start_of_content, packed))
        at += 46 + n + extra + comment
    return out


def _open(path: str) -> tuple[pa.NativeFile, int]:
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner), system.get_file_info(inner).size


def _stored(members: list[Member], folder: str) -> list[Member]:
    found = [m for m in members if m.name.startswith(folder) and not m.name.endswith("/")]
    if any(m.method for m in found):
        raise ValueError(f"a member of {folder} is not stored and can't be read by ranges")
    return found


def _locate(range_bytes: int):
    """Manifest rows to byte ranges (path, start, stop) that hold whole records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                source, size = _open(path)
                with source:
                    members = directory(source, size)
                    archives = _stored(members, "archive/")
                    spans = []
                    for m in _stored(members, "indexes/"):
                        source.seek(m.start)
                        for line in source.read(m.size).splitlines():
                            entry = json.loads(line[line.index(b"{") :])
                            own = next(a for a in archives if a.name == entry["filename"]) if "filename" in entry else archives[0]
                            spans.append((own.start + int(entry["offset"]), int(entry["length"])))
                out, begin, end = [], 0, 0
                for start, length in sorted(spans):
                    if end > begin and (start != end or end - begin >= range_bytes):
                        out.append({"path": path, "start": begin, "stop": end})
                        end = begin
                    if end == begin:
                        begin = start
                    end = start + length
                if end > begin:
                    out.append({"path": path, "start": begin, "stop": end})
                yield pa.RecordBatch.from_pylist(out, pa.schema([("path", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

    return run


_RECORD = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
)


def parse_record(content: bytes) -> dict:
    """The fields of one record; a response's payload is checked against its digest."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)[1])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    number = lambda x: int(m[1]) if x and (m := re.search(r":(-?\d+)>$", x)) else None
    full = fields["WARC-Type"] == "response"
    if full and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged payload in record {fields['WARC-Record-ID']}")
    return {
        "page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "payload_bytes": size,
        "payload_digest": digest, "refers_to": number(fields.get("WARC-Refers-To")), "payload": payload if full else None,
    }


def _read(columns: list[str]):
    schema = pa.schema([_RECORD.field(c) for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                source, _ = _open(x["path"])
                with source:
                    source.seek(x["start"])
                    rest = source.read(x["stop"] - x["start"])
                out = []
                while rest:
                    unpacker = zlib.decompressobj(31)
                    parsed = parse_record(unpacker.decompress(rest))
                    out.append({c: parsed[c] for c in columns})
                    rest = unpacker.unused_data
                    if len(out) >= _ROWS:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out = []
                yield pa.RecordBatch.from_pylist(out, schema)

    return run


def read_packages(manifest: DataFrame, columns: list[str] | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per record of the packages named in ``path``: page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload.

    A revisit has no payload of its own. An empty manifest gives an empty table.
    """
    columns = columns or _RECORD.names
    types = {"page_id": "long", "payload_bytes": "long", "refers_to": "long", "payload": "binary"}
    spark = manifest.sparkSession
    spread = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranges = manifest.select("path").repartition(spread).mapInArrow(_locate(range_bytes), "path string, start long, stop long")
    return ranges.repartition(spread).mapInArrow(_read(columns), ", ".join(f"{c} {types.get(c, 'string')}" for c in columns))
