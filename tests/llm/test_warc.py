from __future__ import annotations

import base64
import hashlib
import io
import struct
import zipfile

import pytest

from quernstone.llm import warc_zip as wz


def records(n=5):
    return [(i, f"http://h/{i}", b"\xff\x00 body \r\n\r\n PK\x05\x06 " * i, None if i % 2 else 1) for i in range(n)]


def reader(raw):
    reads = []

    def read(at, n):
        reads.append((at, n))
        return raw[at : at + n]

    return read, reads


@pytest.mark.parametrize("force64", [False, True])
def test_archives_round_trip_and_are_plain_zips(force64):
    raw = wz.archive(records(), force64)
    read, reads = reader(raw)
    got = list(wz.read_archive(read, len(raw)))
    for (page, _, body, refers), r in zip(records(), got, strict=True):
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert r == (page, len(body), digest, "response" if refers is None else "revisit", refers)
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert z.testzip() is None and {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}
        assert z.read(wz.WARC) == wz.RangeZip(read, len(raw)).range(wz.WARC)


def test_one_record_is_read_by_its_range_alone():
    raw = wz.archive([(i, "u", b"x" * 100_000, None) for i in range(30)])
    read, reads = reader(raw)
    z = wz.RangeZip(read, len(raw))
    reads.clear()
    fields, body = wz.parse_record(z.range(wz.WARC, 0, len(wz.warc_record(0, "u", b"x" * 100_000))))
    assert body == b"x" * 100_000 and fields["WARC-Type"] == "response"
    assert sum(n for _, n in reads) < 101_000


def test_comments_other_writers_and_members_that_are_not_stored():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(zipfile.ZipInfo("a/b.txt"), b"stored")
        z.writestr("c.txt", b"packed" * 100, zipfile.ZIP_DEFLATED)
        z.comment = b"a comment with PK\x05\x06 inside it, and more than twenty-two bytes"
    raw = out.getvalue()
    z = wz.RangeZip(lambda at, n: raw[at : at + n], len(raw))
    assert list(z.members) == ["a/b.txt"] and z.range("a/b.txt", 2, 3) == b"ore" and z.check("a/b.txt")
    for at, n in ((-1, 2), (7, 1), (0, 7)):
        with pytest.raises(ValueError):
            z.range("a/b.txt", at, n)


def test_damage_is_an_error():
    raw = wz.archive(records())
    body = raw.index(b"body")
    index = raw.index(b'{"page"')
    locator = wz.archive(records(), True)
    broken = [raw[:-30], b"", raw[:body] + b"B" + raw[body + 1 :], raw[:index] + b" " + raw[index + 1 :], raw.replace(b"PK\x01\x02", b"PK\x01\x03"), raw.replace(b"PK\x03\x04", b"PK\x03\x05"), locator.replace(b"PK\x06\x07", b"PK\x06\x08"), locator.replace(b"PK\x06\x06", b"PK\x06\x09")]
    for x in broken:
        with pytest.raises((ValueError, struct.error)):
            list(wz.read_archive(lambda at, n, x=x: x[at : at + n], len(x)))


def test_tables_with_clashing_ids_nulls_and_repeated_rows(spark):
    rows = [(2, "same"), (3, "same"), (5, "same"), (5, "other"), (7, "solo"), (2, "other"), (5, "other"), (None, "same"), (9, None), (8, ""), (None, None), (7, "x" * 200_000)]
    df = spark.createDataFrame([(i, "u\r\nx", t, 1, "r") for i, t in rows], "page_id long, url string, html string, refers_to int, same string").repartition(3)
    got = wz.round_trip(df, archive_bytes=1000).collect()
    first = {"same": 2, "other": 2, "solo": 7, "": 8, "x" * 200_000: 7}
    want = []
    for i, t in rows:
        body = (t or "").encode()
        alone = i is None or i == first[t or ""]
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if alone else "revisit", None if alone else first[t or ""]))
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    small = {(r.page_id, r.record_type) for r in wz.round_trip(df, min_revisit_bytes=5).collect() if r.payload_bytes < 5}
    assert {k for _, k in small} == {"response"}
    assert wz.round_trip(df.limit(0)).count() == 0
