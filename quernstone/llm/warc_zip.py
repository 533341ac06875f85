"""WARC records in ZIP-packaged archives of stored members: a writer, and a reader that never extracts.

An archive holds `archive/data.warc` and `indexes/index.cdxj`, both stored. The reader takes any `read(offset, size)`
and a size (a file, an object store's range request, or bytes): it finds the end record, follows the ZIP64 locator
where a field overflows, parses the central directory, locates the members by their local headers, reads the
index and then reads single records by range.

Defined results: a null payload is empty; repeated rows are written one by one, and of equal page ids with equal
payloads all are the response; where one id has several payloads, each record follows its own payload; null ids are kept, as responses; an
empty table gives no archives; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written

WARC, INDEX = "archive/data.warc", "indexes/index.cdxj"
ID_FIELD, LENGTH_FIELD, REFERS_FIELD = "WARC-Record-Page", "WARC-Payload-Length", "WARC-Refers-To-Page"
_MAX32, _MAX16 = 0xFFFFFFFF, 0xFFFF


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- writing -----------------------------------------------------------------------------------------------


def warc_record(page_id: object, url: str | None, payload: bytes, refers_to: object = None) -> bytes:
    """A response with its HTTP block, or a revisit, whose block ends after the HTTP header."""
    kind = "response" if refers_to is None else "revisit"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block += payload if kind == "response" else b""
    head = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:quernstone:page:{page_id}>"),
        ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"),
        (ID_FIELD, json.dumps(page_id)),
        (LENGTH_FIELD, str(len(payload))),
    ]
    if kind == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), (REFERS_FIELD, json.dumps(refers_to))]
    head.append(("Content-Length", str(len(block))))
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + block + b"\r\n\r\n"


def zip_stored(members: list[tuple[str, bytes]], force64: bool = False) -> bytes:
    """A ZIP of stored members; ZIP64 fields where sizes need them, or everywhere if forced."""
    out, directory = bytearray(), bytearray()
    for name, data in members:
        raw, crc, at, n = name.encode(), zlib.crc32(data), len(out), len(data)
        big = force64 or n >= _MAX32 or at >= _MAX32
        extra = struct.pack("<HHQQ", 1, 16, n, n) if big else b""
        size = _MAX32 if big else n
        out += struct.pack("<IHHHHHIIIHH", 0x04034B50, 45 if big else 20, 0x800, 0, 0, 33, crc, size, size, len(raw), len(extra)) + raw + extra + data
        extra = struct.pack("<HHQQQ", 1, 24, n, n, at) if big else b""
        directory += struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45 if big else 20, 0x800, 0, 0, 33, crc, size, size, len(raw), len(extra), 0, 0, 0, 0, _MAX32 if big else at) + raw + extra
    at, n, count = len(out), len(directory), len(members)
    out += directory
    if force64 or at >= _MAX32 or count >= _MAX16:
        end64 = len(out)
        out += struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, count, count, n, at) + struct.pack("<IIQI", 0x07064B50, 0, end64, 1)
        count, n, at = _MAX16, _MAX32, _MAX32
    return bytes(out + struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, count, count, n, at, 0))


def archive(records: list[tuple], force64: bool = False) -> bytes:
    """(page_id, url, payload, refers_to) as one archive, with an index line (offset, length) for each record."""
    body, lines = bytearray(), []
    for page_id, url, payload, refers in records:
        rec = warc_record(page_id, url, payload, refers)
        lines.append(json.dumps({"page": page_id, "offset": len(body), "length": len(rec)}))
        body += rec
    return zip_stored([(WARC, bytes(body)), (INDEX, "\n".join(lines).encode())], force64)


# --- reading -----------------------------------------------------------------------------------------------


class RangeZip:
    """The stored members of a ZIP, found through its central directory by range reads alone."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self.read = read
        tail_at = max(0, size - 22 - _MAX16)
        tail = read(tail_at, size - tail_at)
        k = tail.rfind(b"PK\x05\x06")
        while k >= 0 and k + 22 + struct.unpack_from("<H", tail, k + 20)[0] != len(tail):  # a signature inside the comment
            k = tail.rfind(b"PK\x05\x06", 0, k)
        if k < 0:
            raise ValueError("no end-of-directory record")
        count, n, at = struct.unpack_from("<HII", tail, k + 10)
        if count == _MAX16 or n == _MAX32 or at == _MAX32:
            locator = read(tail_at + k - 20, 20)
            if locator[:4] != b"PK\x06\x07":
                raise ValueError("no ZIP64 locator")
            end64 = read(struct.unpack_from("<Q", locator, 8)[0], 56)
            if end64[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end record")
            count, n, at = struct.unpack_from("<QQQ", end64, 32)
        self.members = dict(self._directory(read(at, n), count))

    def _directory(self, raw: bytes, count: int) -> Iterator[tuple[str, tuple[int, int, int]]]:
        at = 0
        for _ in range(count):
            if raw[at : at + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            method, crc, packed, full = struct.unpack_from("<H", raw, at + 10)[0], *struct.unpack_from("<III", raw, at + 16)
            n_name, n_extra, n_comment = struct.unpack_from("<HHH", raw, at + 28)
            offset = struct.unpack_from("<I", raw, at + 42)[0]
            name = raw[at + 46 : at + 46 + n_name].decode()
            extra = raw[at + 46 + n_name : at + 46 + n_name + n_extra]
            while len(extra) >= 4:
                tag, n = struct.unpack_from("<HH", extra)
                if tag == 1:  # only the fields that overflow, in this order
                    wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                    full = next(wide) if full == _MAX32 else full
                    packed = next(wide) if packed == _MAX32 else packed
                    offset = next(wide) if offset == _MAX32 else offset
                extra = extra[4 + n :]
            if method == 0:
                if packed != full:
                    raise ValueError(f"{name}: stored, but of two sizes")
                yield name, (offset, full, crc)
            at += 46 + n_name + n_extra + n_comment

    def range(self, name: str, offset: int = 0, size: int | None = None) -> bytes:
        """Bytes of a stored member; its data follow a local header whose lengths differ from the directory's."""
        at, n, _ = self.members[name]
        head = self.read(at, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError(f"{name}: no local header")
        skip = 30 + sum(struct.unpack_from("<HH", head, 26))
        if offset < 0 or offset > n or (size is not None and offset + size > n):
            raise ValueError(f"{name}: range outside the member")
        return self.read(at + skip + offset, n - offset if size is None else size)

    def check(self, name: str) -> bool:
        return zlib.crc32(self.range(name)) == self.members[name][2]


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload (the HTTP body) of one WARC record."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not sep or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n : n + 4] != b"\r\n\r\n":
        raise ValueError("a record of another length than declared")
    return fields, rest[:n].partition(b"\r\n\r\n")[2]


def read_archive(read: Callable[[int, int], bytes], size: int) -> Iterator[tuple]:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), verified for each record that has its payload."""
    z = RangeZip(read, size)
    if not z.check(INDEX):
        raise ValueError("the index is damaged")
    for line in z.range(INDEX).decode().split("\n"):
        if line:
            where = json.loads(line)
            fields, payload = parse_record(z.range(WARC, where["offset"], where["length"]))
            kind, digest, n = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields[LENGTH_FIELD])
            if kind == "response" and (len(payload) != n or sha1_base32(payload) != digest):
                raise ValueError(f"page {where['page']}: the payload doesn't match its digest")
            refers = json.loads(fields[REFERS_FIELD]) if REFERS_FIELD in fields else None
            yield json.loads(fields[ID_FIELD]), n, digest, kind, refers


# --- DataFrames --------------------------------------------------------------------------------------------


def with_responses(pages: DataFrame, id_col: str, payload_col: str, min_bytes: int) -> DataFrame:
    """(page_id, same, refers_to): of equal payloads (same: their digest) of min_bytes or more, the smallest id, for the larger ones.

    Only ids and digests are shuffled. The smallest id of a payload is found with partial sums, so a payload that a
    third of the pages share is one row for each task.
    """
    body = F.coalesce(pages[payload_col], F.lit(""))
    keyed = pages.select(pages[id_col].cast("long").alias("page_id"), F.sha2(body, 256).alias("same"), F.octet_length(body).alias("n"))
    keyed = keyed.filter((F.col("n") >= min_bytes) & F.col("page_id").isNotNull())
    first = keyed.groupBy("same").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).filter("first < last")
    return keyed.join(first, "same").filter("page_id > first").select("page_id", "same", F.col("first").alias("refers_to")).distinct()


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0, archive_bytes: int = 4 << 20) -> DataFrame:
    """(archive binary, n_records): archives of about archive_bytes of payload, as many as a task's rows fill."""
    refers = with_responses(pages, id_col, payload_col, min_revisit_bytes)
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].alias("url"), pages[payload_col].alias("html"))
    rows = rows.withColumn("same", F.sha2(F.coalesce("html", F.lit("")), 256)).join(refers, ["page_id", "same"], "left").select("page_id", "url", "html", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        emit = lambda: pa.RecordBatch.from_arrays([pa.array([archive(held)], pa.binary()), pa.array([len(held)], pa.int64())], names=["archive", "n_records"])
        for batch in batches:
            for page, url, html, ref in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                held.append((page, url, (html or "").encode(), ref))
                n += len(held[-1][2])
                if n >= archive_bytes:
                    yield emit()
                    held, n = [], 0
        if held:
            yield emit()

    return rows.mapInArrow(run, "archive binary, n_records long")


READ_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(archives: DataFrame, archive_col: str = "archive") -> DataFrame:
    """The records of archives held in a binary column (also of spark.read.format("binaryFile"), column content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for raw in batch.column(0):
                view = memoryview(raw.as_buffer())
                rows = list(read_archive(lambda at, n, v=view: bytes(v[at : at + n]), len(view)))
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return archives.select(archives[archive_col]).mapInArrow(run, READ_SCHEMA)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Archives written to the shared folder, and their records read from there."""
    return read_archives(written(write_archives(pages, **options), "warc"))
