"""WARC records in ZIP packages."""

import base64
import gzip
import hashlib
import io
import zipfile

import pytest
from llm_rows import table

from tillview.llm import warc
from tillview.sources.staging import new_folder


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


ROWS = [
    (1, "http://a/1", "<p>same</p>"),
    (2, "http://a/2", "<p>same</p>"),
    (3, "http://a/3", "<p>é 👍</p>"),
    (4, None, None),
    (5, "http://a/\r\nX: 1", ""),
    (None, "http://a/6", "<p>same</p>"),
    (7, "http://a/7", "long " * 200_000),
    (2, "http://a/2", "<p>same</p>"),
    (8, "http://a/8", "a\r\n\r\nb"),
]


def expected(rows, least=0):
    largest = {}
    for page, _, html in rows:
        if page is not None:
            largest[html or ""] = max(largest.get(html or "", page), page)
    out = []
    for page, _, html in rows:
        raw = (html or "").encode()
        last = largest.get(html or "")
        later = len(raw) >= least and last is not None and (page is None or page < last)
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((page, len(raw), digest, "revisit" if later else "response", last if later else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    packages = warc.write_archives(pages(spark, ROWS), new_folder(spark, "test"), least, package_bytes=2000)
    assert packages.count() > 1 or packages.agg({"records": "sum"}).first()[0] == len(ROWS)
    rows = warc.read_records(spark, packages, payloads=True).collect()
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows]
    assert sorted(got, key=str) == expected(ROWS, least)
    payloads = {r.page_id: bytes(r.payload) for r in rows if r.record_type == "response"}
    assert payloads[3] == "<p>é 👍</p>".encode() and payloads[8] == b"a\r\n\r\nb" and payloads[5] == b""
    assert {r.page_id: r.url for r in rows}[5] == "http://a/%0D%0AX: 1"


def test_given_pages(spark):
    given = table(spark, "pages")
    got = [tuple(r) for r in warc.archive_pages(given).collect()]
    assert sorted(got, key=str) == expected([tuple(r) for r in given.collect()])


def test_no_pages(spark):
    assert warc.archive_pages(pages(spark, [])).collect() == []


def package(records, **kinds):
    out = io.BytesIO()
    warc.write_package(warc._Unseekable(out), ((str(i), warc.warc_record(i, "u", r, None)) for i, r in enumerate(records)))
    return out.getvalue()


def test_the_library_opens_our_packages():
    raw = package([b"one", b"two" * 50])
    with zipfile.ZipFile(io.BytesIO(raw)) as found:
        assert found.testzip() is None
        assert b"two" * 50 in gzip.decompress(found.read(warc.ARCHIVE))
    entries = list(warc.index_entries(io.BytesIO(raw), len(raw)))
    assert [warc.parse_record(raw[a : a + n])[2] for a, n in entries] == [b"one", b"two" * 50]


def test_zip64_directories(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    raw = package([b"payload" * 100])
    assert warc.END64 in raw and warc.LOCATOR64 in raw
    (start, length), = warc.index_entries(io.BytesIO(raw), len(raw))
    assert warc.parse_record(raw[start : start + length])[2] == b"payload" * 100


def test_members_that_are_not_stored_and_comments():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as made:
        made.writestr("a.txt", b"x" * 500, zipfile.ZIP_DEFLATED)
        made.writestr("b.txt", b"stored", zipfile.ZIP_STORED)
        made.comment = b"PK\5\6 not the end"
    raw = out.getvalue()
    (start, length) = warc.stored_members(io.BytesIO(raw), len(raw))["b.txt"]
    assert raw[start : start + length] == b"stored"
    assert "a.txt" not in warc.stored_members(io.BytesIO(raw), len(raw))
    for broken in (b"", b"no archive at all", raw[:-40]):
        with pytest.raises(ValueError):
            warc.stored_members(io.BytesIO(broken), len(broken))
