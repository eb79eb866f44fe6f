"""WARC records in ZIP packages: write, and read back by ranges without extraction.

A package is a ZIP file with two stored members: ``archive/data.warc.gz``, one gzip member per
record, and ``indexes/index.cdxj``, one line per record with its offset and length. Reading
parses the end of the file and its central directory, ZIP64 forms included, finds where the
stored members lie, reads the index, and then reads each record by its range.

Records of equal payloads: the one with the largest id is the response, the others are revisits
that refer to it and hold no payload; the HTTP header they keep tells its length. Payloads below
``least_bytes`` are always responses.

Each task writes packages of its own under the given folder, which executors share, and returns
their paths; only paths of tasks that succeeded are in the list, so lost or repeated tasks do no
harm. Payloads that a third of all pages share do not meet in one task (``look_up``).

Edge cases: null html is an empty payload; rows with equal id and payload are alike; a null id
counts as smallest; a null url is left out, line breaks in urls are escaped.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from tillview.operators.lookup import look_up
from tillview.sources.staging import new_folder, stage

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PACKAGE_BYTES = 256 << 20
WARC_DATE = "2000-01-01T00:00:00Z"


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# Writing


def warc_record(
    page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = WARC_DATE
) -> bytes:
    """One record: a response, or a revisit if ``refers_to`` is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    head.append(f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>")
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}"]
    if refers_to is not None:
        head.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_package(stream, records: Iterator[tuple[str, bytes]], limit: int = PACKAGE_BYTES) -> tuple[int, int]:
    """Write records, each with its index key, until ``limit`` bytes; records and bytes written."""
    lines, size = [], 0
    with zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED, allowZip64=True) as package:
        with package.open(ARCHIVE, "w", force_zip64=True) as member:
            for key, record in records:
                packed = gzip.compress(record, compresslevel=3, mtime=0)
                member.write(packed)
                place = {"offset": size, "length": len(packed), "filename": ARCHIVE}
                lines.append(f"{key} {json.dumps(place)}\n")
                size += len(packed)
                if size >= limit:
                    break
        with package.open(INDEX, "w", force_zip64=True) as member:
            for line in lines:
                member.write(line.encode())
    return len(lines), size


def with_decisions(pages: DataFrame, key: str, html: str, least_bytes: int) -> DataFrame:
    """Adds refers_to, null for responses."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    digest = F.when(F.length(payload) >= least_bytes, F.sha1(payload))
    rows = pages.withColumn("payload_key", digest)
    keyed = stage(rows.where("payload_key is not null").select(key, "payload_key"), "warc-digests")
    groups = keyed.groupBy("payload_key").agg(F.max(key).alias("largest"), F.count("*").alias("count"))
    groups = stage(groups.where("count > 1"), "warc-groups")
    joined = look_up(
        rows, groups.select("payload_key", "largest"), "payload_key", counts=groups.select("payload_key", "count")
    )
    later = F.col("largest").isNotNull() & (F.col(key).isNull() | (F.col(key) < F.col("largest")))
    return joined.select(*pages.columns, F.when(later, F.col("largest")).alias("refers_to"))


def write_archives(
    pages: DataFrame,
    folder: str,
    least_bytes: int = 0,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
    package_bytes: int = PACKAGE_BYTES,
) -> DataFrame:
    """Write a record per page under ``folder``; path, records and bytes of every package."""
    rows = with_decisions(pages.select(key, url, html), key, html, least_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)

        def records() -> Iterator[tuple[str, bytes]]:
            for batch in batches:
                for i in range(len(batch)):
                    page, address, text, refers = (batch.column(k)[i].as_py() for k in range(4))
                    yield str(page), warc_record(page, address, (text or "").encode(), refers)

        todo = records()
        ahead = next(todo, None)
        while ahead is not None:
            name = f"part-{uuid.uuid4().hex}.wacz"

            def some(first=ahead) -> Iterator[tuple[str, bytes]]:
                yield first
                yield from todo

            store.create_dir(root, recursive=True)
            with store.open_output_stream(f"{root}/{name}") as stream:
                count, size = write_package(_Unseekable(stream), some(), package_bytes)
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [count], "bytes": [size]})
            ahead = next(todo, None)

    schema = StructType().add("path", StringType()).add("records", LongType()).add("bytes", LongType())
    return stage(rows.mapInArrow(run, schema), "warc-packages")


class _Unseekable(io.RawIOBase):
    """What the ZIP writer needs of a stream to an object store."""

    def __init__(self, stream):
        self.stream = stream

    def writable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return False

    def write(self, data) -> int:
        self.stream.write(bytes(data))
        return len(data)


# Reading

END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"
UNSET16, UNSET32 = 0xFFFF, 0xFFFFFFFF


def _read(file, start: int, length: int) -> bytes:
    file.seek(start)
    found = file.read(length)
    if len(found) != length:
        raise ValueError("the package ends too early")
    return found


def stored_members(file, size: int) -> dict[str, tuple[int, int]]:
    """Start and length of every stored member, from the central directory."""
    tail_at = max(0, size - 22 - UNSET16)
    tail = _read(file, tail_at, size - tail_at)
    end = tail.rfind(END, 0, max(0, len(tail) - 18))
    while end >= 0 and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail):
        end = tail.rfind(END, 0, end + 3)
    if end < 0:
        raise ValueError("not a ZIP package")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    if UNSET16 == count or UNSET32 in (length, start):
        signature, _, at64, _ = struct.unpack("<4sIQI", _read(file, tail_at + end - 20, 20))
        if signature == LOCATOR64:
            end64 = _read(file, at64, 56)
            if end64[:4] != END64:
                raise ValueError("the ZIP64 end record is missing")
            count, length, start = struct.unpack_from("<QQQ", end64, 32)
    directory, at, found = _read(file, start, length), 0, {}
    for _ in range(count):
        if directory[at : at + 4] != CENTRAL:
            raise ValueError("the central directory is damaged")
        flags, method = struct.unpack_from("<HH", directory, at + 8)
        packed, plain, name_n, extra_n, note_n = struct.unpack_from("<IIHHH", directory, at + 20)
        (offset,) = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46 : at + 46 + name_n]
        extra = directory[at + 46 + name_n : at + 46 + name_n + extra_n]
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == 1:  # 64-bit values, only of the fields that are unset
                wide = iter(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                plain = next(wide) if plain == UNSET32 else plain
                packed = next(wide) if packed == UNSET32 else packed
                offset = next(wide) if offset == UNSET32 else offset
            extra = extra[4 + n :]
        if method == 0 and not flags & 1 and packed == plain:
            local = _read(file, offset, 30)
            if local[:4] != LOCAL:
                raise ValueError("a local header is missing")
            name_here, extra_here = struct.unpack_from("<HH", local, 26)
            found[name.decode("utf-8", "replace")] = (offset + 30 + name_here + extra_here, plain)
        at += 46 + name_n + extra_n + note_n
    return found


def index_entries(file, size: int) -> Iterator[tuple[int, int]]:
    """Start and length in the package of every indexed record."""
    members = stored_members(file, size)
    for name, (start, length) in members.items():
        if name.startswith("indexes/") and name.endswith(".cdxj"):
            for line in _read(file, start, length).splitlines():
                place = json.loads(line[line.index(b"{") :])
                yield members[place["filename"]][0] + place["offset"], place["length"]


def parse_record(packed: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload of one gzip member, names in lower case."""
    raw = zlib.decompress(packed, wbits=31)

    def fields(block: bytes) -> dict[str, str]:
        lines = block.decode("utf-8", "replace").split("\r\n")[1:]
        return {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}

    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = fields(head)
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, fields(http), payload


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def locate_records(spark: SparkSession, packages: DataFrame) -> DataFrame:
    """path, start and length of every record in the packages of column ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, place = open_store(path)
                with store.open_input_file(place) as file:
                    found = list(index_entries(file, file.size()))
                if found:
                    starts, lengths = zip(*found, strict=True)
                    yield pa.RecordBatch.from_pydict(
                        {"path": [path] * len(found), "start": list(starts), "length": list(lengths)}
                    )

    return packages.select("path").mapInArrow(run, "path string, start long, length long")


def read_records(spark: SparkSession, packages: DataFrame, payloads: bool = False) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type and refers_to of every record.

    The digest of a response is that of the payload read; with ``payloads`` the payload is
    returned too (null for revisits). Ranges are dealt out by path and part of the file.
    """
    located = stage(locate_records(spark, packages), "warc-ranges")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = located.repartition(partitions, "path", (F.col("start") / (8 << 20)).cast("long"))
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    if payloads:
        names, schema = [*names, "payload"], schema + ", payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, file = None, None
        for batch in batches:
            columns: dict[str, list] = {name: [] for name in names}
            held = 0
            for path, start, length in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if path != opened:
                    if file is not None:
                        file.close()
                    store, place = open_store(path)
                    opened, file = path, store.open_input_file(place)
                warc, http, payload = parse_record(_read(file, start, length))
                revisit = warc["warc-type"] == "revisit"
                digest = warc["warc-payload-digest"].removeprefix("sha1:") if revisit else base32_sha1(payload)
                row = (
                    _page(warc["warc-record-id"]),
                    warc.get("warc-target-uri"),
                    int(http["content-length"]) if revisit else len(payload),
                    digest,
                    warc["warc-type"],
                    _page(warc.get("warc-refers-to")),
                    None if revisit else payload,
                )
                for name, value in zip(names, row, strict=False):
                    columns[name].append(value)
                held += len(payload) if payloads else 0
                if held > 8 << 20:
                    yield _batch(columns)
                    columns, held = {name: [] for name in names}, 0
            if columns["page_id"]:
                yield _batch(columns)
        if file is not None:
            file.close()

    return dealt.sortWithinPartitions("path", "start").mapInArrow(run, schema)


ARROW_TYPES = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}


def _batch(columns: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(values, ARROW_TYPES.get(name, pa.string())) for name, values in columns.items()], list(columns)
    )


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write all pages to packages in the shared folder and return what reading them back gives."""
    spark = pages.sparkSession
    packages = write_archives(pages, new_folder(spark, "warc"))
    return read_records(spark, packages).drop("url")
