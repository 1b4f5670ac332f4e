"""Web archives packed in ZIP files: writing, and reading by ranges without extraction.

An archive is a ZIP file with two stored members: ``records.warc.gz``, one gzip
member for each WARC record, and ``index.jsonl``, one line for each record with
its offset and length. The reader takes the end record (ZIP64 where it is
there), the central directory and the local headers, and so knows the byte range
of each member in the archive. Records are ranges of ranges: nothing is unpacked
or copied, and records of one archive are read in many tasks.
"""

from __future__ import annotations

import base64
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm.files import make_folder, opened, task_file
from postloom.llm.words import blocks
from postloom.session import scratch_path, settle

RECORDS, INDEX = "records.warc.gz", "index.jsonl"
MEMBER_BYTES = 256 << 20
DATE = "2024-01-01T00:00:00Z"
GZIP_LEVEL = 3


# ---------------------------------------------------------------- writing


def _header(record_type: str, page_id: int, url: str, digest: str, refers: int | None, block: bytes) -> bytes:
    lines = [
        "WARC/1.1",
        f"WARC-Type: {record_type}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if refers is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _record(page_id: int, url: str | None, payload: bytes, sha1: str, refers: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    clean = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    kind = "response" if refers is None else "revisit"
    return _header(kind, page_id, clean, digest, refers, http if refers is not None else http + payload)


def _gzipped(data: bytes) -> bytes:
    packer = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _write(folder: str, member_bytes: int):
    """Archives of a partition; a new one begins when the records have ``member_bytes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = archive = member = None
        path, index, at = "", [], 0

        def close() -> pa.RecordBatch:
            member.close()
            archive.writestr(INDEX, "".join(index))
            archive.close()
            sink.close()
            return pa.RecordBatch.from_pydict({"path": [path], "n_records": [len(index)], "bytes": [at]})

        for part in blocks(batches, "html"):
            for row in part.to_pylist():
                if archive is not None and at >= member_bytes:
                    yield close()
                    archive = None
                if archive is None:
                    uri = task_file(folder, ".zip")
                    system, local = opened(uri)
                    sink = system.open_output_stream(local)
                    archive = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED, allowZip64=True)
                    member = archive.open(zipfile.ZipInfo(RECORDS), "w", force_zip64=True)
                    path, index, at = uri, [], 0
                data = _gzipped(_record(row["page_id"], row["url"], (row["html"] or "").encode(), row["sha1"], row["refers_to"]))
                member.write(data)
                index.append(json.dumps({"id": row["page_id"], "offset": at, "length": len(data)}) + "\n")
                at += len(data)
        if archive is not None:
            yield close()

    return run


def write_archives(
    pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, folder: str | None = None, member_bytes: int = MEMBER_BYTES
) -> DataFrame:
    """One record for each page; the table of archives.

    Of equal payloads of at least ``min_bytes`` bytes the one with the largest key
    is a response, the others are revisits that refer to it; shorter ones are all
    responses. Null payloads and URLs count as empty. Keys are unique integers; a
    null key is refused. An empty table gives no archive. Further columns are not read.
    """
    spark = pages.sparkSession
    folder = make_folder(folder or scratch_path(spark, "archives"))
    rows = pages.select(
        F.expr(f"coalesce(cast(`{key}` as bigint), raise_error('null key'))").alias("page_id"),
        F.col(f"`{url}`").alias("url"),
        F.coalesce(F.col(f"`{payload}`"), F.lit("")).alias("html"),
    ).withColumn("sha1", F.sha1(F.encode("html", "UTF-8")))
    known = settle(rows.select("page_id", "sha1", F.octet_length("html").alias("size")), "digests")
    latest = known.filter(F.col("size") >= min_bytes).groupBy("sha1").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("c"))
    revisits = known.filter(F.col("size") >= min_bytes).join(latest.filter("c > 1").drop("c"), "sha1").filter("page_id <> refers_to")
    rows = rows.join(revisits.select("page_id", "refers_to"), "page_id", "left").select("page_id", "url", "html", "sha1", "refers_to")
    return settle(rows.mapInArrow(_write(folder, member_bytes), "path string, n_records bigint, bytes bigint"), "archives")


# ---------------------------------------------------------------- reading


class Archive:
    """The members of a ZIP file and where their bytes lie."""

    def __init__(self, path: str):
        system, at = opened(path)
        self.file = system.open_input_file(at)
        self.members = {name: (begin, size) for name, begin, size in self._members()}

    def read(self, begin: int, n: int) -> bytes:
        data = self.file.read_at(n, begin)
        if len(data) != n:
            raise ValueError("the archive ends early")
        return data

    def _directory(self) -> tuple[int, int]:
        """Begin and size of the central directory."""
        size = self.file.size()
        tail_size = min(size, 22 + 65535)
        tail = self.read(size - tail_size, tail_size)
        end = tail.rfind(b"PK\x05\x06")
        while end >= 0 and (len(tail) - end < 22 or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
            end = tail.rfind(b"PK\x05\x06", 0, end)
        if end < 0:
            raise ValueError("no end of a ZIP directory")
        count, length, begin = struct.unpack_from("<HII", tail, end + 10)
        if count == 0xFFFF or length == 0xFFFFFFFF or begin == 0xFFFFFFFF:
            locator = self.read(size - tail_size + end - 20, 20)
            if locator[:4] != b"PK\x06\x07":
                raise ValueError("no ZIP64 locator")
            record = self.read(struct.unpack_from("<Q", locator, 8)[0], 56)
            if record[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end record")
            length, begin = struct.unpack_from("<QQ", record, 40)
        return begin, length

    def _members(self) -> Iterator[tuple[str, int, int]]:
        begin, length = self._directory()
        directory = self.read(begin, length)
        at = 0
        while at < len(directory):
            if directory[at : at + 4] != b"PK\x01\x02":
                raise ValueError("broken ZIP directory")
            flags, method = struct.unpack_from("<HH", directory, at + 8)
            packed, plain = struct.unpack_from("<II", directory, at + 20)
            n_name, n_extra, n_note = struct.unpack_from("<HHH", directory, at + 28)
            (local,) = struct.unpack_from("<I", directory, at + 42)
            name = directory[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
            packed, plain, local = self._large(extra, packed, plain, local)
            at += 46 + n_name + n_extra + n_note
            if method or packed != plain or flags & 1:
                continue  # compressed or encrypted members have no byte ranges to read
            head = self.read(local, 30)
            if head[:4] != b"PK\x03\x04":
                raise ValueError("broken local ZIP header")
            yield name, local + 30 + sum(struct.unpack_from("<HH", head, 26)), plain

    @staticmethod
    def _large(extra: bytes, packed: int, plain: int, local: int) -> tuple[int, int, int]:
        """Sizes and place from the ZIP64 field, for those that the directory has as all ones."""
        at = 0
        while at + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, at)
            if kind == 1:
                values = iter(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
                plain = next(values) if plain == 0xFFFFFFFF else plain
                packed = next(values) if packed == 0xFFFFFFFF else packed
                local = next(values) if local == 0xFFFFFFFF else local
            at += 4 + n
        return packed, plain, local


def _index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where each record of each archive lies."""
    for batch in batches:
        for path in batch.column("path").to_pylist():
            archive = Archive(path)
            base, size = archive.members[RECORDS]
            begin, n = archive.members[INDEX]
            rest, at = b"", 0
            while at < n:
                data = rest + archive.read(begin + at, min(1 << 20, n - at))
                at += min(1 << 20, n - at)
                lines = data.split(b"\n")
                rest = lines.pop()
                found = [json.loads(x) for x in lines if x]
                if any(x["offset"] + x["length"] > size for x in found):
                    raise ValueError(f"the index of {path} points outside its records")
                yield pa.RecordBatch.from_pydict(
                    {
                        "path": pa.array([path] * len(found), pa.string()),
                        "offset": pa.array([base + x["offset"] for x in found], pa.int64()),
                        "length": pa.array([x["length"] for x in found], pa.int64()),
                    }
                )


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers, HTTP headers and payload of one WARC record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in http.decode().split("\r\n")[1:])}
    return headers, fields, payload


def _number(urn: str | None) -> int | None:
    return int(urn.removeprefix("<urn:page:").removesuffix(">")) if urn else None


RECORD = (
    "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string"
)


def _read(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")] + ["payload"] * with_payload
        archive = at = None
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for path, offset, length in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length")), strict=True):
                if path != at:
                    archive, at = Archive(path), path
                headers, http, payload = parse_record(zlib.decompress(archive.read(offset, length), 31))
                digest = headers["warc-payload-digest"].removeprefix("sha1:")
                kind = headers["warc-type"]
                if kind == "response":
                    import hashlib

                    if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != int(http["content-length"]):
                        raise ValueError(f"record {headers['warc-record-id']} of {path} is damaged")
                row = (_number(headers["warc-record-id"]), headers["warc-target-uri"], kind, _number(headers.get("warc-refers-to")), int(http["content-length"]), digest)
                rows.append(row + ((payload if kind == "response" else None),) * with_payload)
                held += len(payload) * with_payload + 200
                if held > 4 << 20:
                    yield _rows(rows, names)
                    rows, held = [], 0
            if rows:
                yield _rows(rows, names)

    return run


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)]
    return pa.RecordBatch.from_arrays(columns, names)


def read_archives(spark: SparkSession, archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the archives of a table with ``path``.

    Columns: key, URL, type, the key a revisit refers to, bytes and bare SHA-1
    (base32) of the full payload, and the payload of responses. Payloads are held
    against their digest. Records are dealt out by place, so a large archive is
    read by many tasks.
    """
    places = settle(archives.select("path").repartition("path").mapInArrow(_index_rows, "path string, offset bigint, length bigint"), "records")
    dealt = places.repartitionByRange("path", "offset").sortWithinPartitions("path", "offset")
    return dealt.mapInArrow(_read(with_payload), RECORD + ", payload binary" * with_payload)
