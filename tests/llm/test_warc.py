import base64
import hashlib
import io
import zipfile

import pytest

from postloom.llm import warc
from postloom.llm.warc import Archive, read_archives, write_archives

PAGES = [
    (1, "http://a/", "<p>one</p>"), (2, "http://b/", "<p>one</p>"), (3, None, None), (4, "http://c/", ""), (5, "http://d/\r\nx: y", "été \U0001f642"),
    (6, "http://e/", "<p>one</p>"), (7, "http://f/", "x" * 300_000 + "\r\n\r\nWARC/1.1"),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "other", 3) for r in rows], "page_id bigint, url string, html string, sha1 string, size int")


def plain(rows, least):
    out = {}
    for i, _, html in rows:
        data = (html or "").encode()
        same = max(j for j, _, h in rows if (h or "").encode() == data)
        revisit = len(data) >= least and same != i
        out[i] = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", same if revisit else None)
    return out


@pytest.mark.parametrize("least", [0, 1, 11, 1000])
def test_records_come_back(spark, least):
    archives = write_archives(pages(spark), min_bytes=least, member_bytes=200)
    rows = read_archives(spark, archives).collect()
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows} == plain(PAGES, least)
    html = {i: (h or "").encode() for i, _, h in PAGES}
    assert all(r.payload == html[r.page_id] for r in rows if r.record_type == "response")
    assert all(r.payload is None for r in rows if r.record_type == "revisit")
    assert len(rows) == len(PAGES)


def test_empty_table(spark):
    assert read_archives(spark, write_archives(pages(spark, []))).count() == 0


@pytest.mark.parametrize("zip64, note", [(False, b""), (True, b""), (False, b"a note PK\x05\x06 in it")])
def test_directories_are_read_as_they_are(tmp_path, monkeypatch, zip64, note):
    if zip64:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.comment = note
        z.writestr("first", b"0123456789" * 50)
        z.writestr("packed", b"0" * 500, zipfile.ZIP_DEFLATED)
        z.writestr("d/é", b"second")
    archive = Archive(str(path))
    assert {n: archive.read(*m) for n, m in archive.members.items()} == {"first": b"0123456789" * 50, "d/é": b"second"}


def test_damage_is_told(spark, tmp_path):
    path = tmp_path / "b.zip"
    path.write_bytes(b"no archive")
    with pytest.raises(ValueError):
        Archive(str(path))
    record = warc._record(5, "u", b"body", "00" * 20, None)
    headers, http, payload = warc.parse_record(record)
    assert (headers["warc-type"], http["content-length"], payload) == ("response", "4", b"body")
    assert io.BytesIO(record).readline() == b"WARC/1.1\r\n"
