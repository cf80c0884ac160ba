"""WARC records in ZIP packages: written, then read by ranges without extracting anything.

A package is a ZIP file with stored members: archives of gzip-per-record WARC data and a CDXJ index
whose lines give the place of each record. The reader parses the end record, the ZIP64 records if
there are any and the central directory, finds where members begin, and reads index and records by
their byte ranges.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, release_memory, shared_dir, shuffle_partitions, written

#: A writer begins a new package after this many bytes of payload.
PACKAGE_BYTES = 32 << 20
#: A reader asks for records that lie side by side in one range of up to this size.
RANGE_BYTES = 4 << 20
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# -- ZIP directories -------------------------------------------------------------------------


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    stored: int
    header: int


class ZipRanges:
    """Members of a ZIP file read by ranges from any object with ``seek`` and ``read``."""

    END, END64, LOCATOR = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"

    def __init__(self, source, size: int):
        self.source, self.size = source, size
        tail_at = max(0, size - 22 - 0xFFFF)
        tail = self.at(tail_at, size - tail_at)
        k = len(tail) - 22
        # The end record's comment must reach exactly to the end of the file.
        while k >= 0 and not (tail[k : k + 4] == self.END and k + 22 + struct.unpack_from("<H", tail, k + 20)[0] == len(tail)):
            k = tail.rfind(self.END, 0, k + 3)
        if k < 0:
            raise ValueError("not a ZIP file: no end record")
        count, length, start = struct.unpack_from("<HII", tail, k + 10)
        end = tail_at + k
        locator = self.at(end - 20, 20) if end >= 20 else b""
        if locator[:4] == self.LOCATOR:
            stated = struct.unpack_from("<Q", locator, 8)[0]
            # With bytes in front of the ZIP data the stated place is too low; the record then ends at its locator.
            for place in (stated, end - 76):
                record = self.at(place, 56) if 0 <= place <= size - 56 else b""
                if record[:4] == self.END64:
                    break
            else:
                raise ValueError("the ZIP64 end record is missing")
            end = place
            count, length, start = struct.unpack_from("<QQQ", record, 32)
        elif count == 0xFFFF or 0xFFFFFFFF in (length, start):
            raise ValueError("the ZIP64 locator is missing")
        self.shift = end - length - start  # bytes in front of the ZIP data
        self.members = {m.name: m for m in self._directory(self.at(start + self.shift, length), count)}

    def at(self, place: int, n: int) -> bytes:
        if place < 0 or n < 0 or place + n > self.size:
            raise ValueError("a range lies outside the ZIP file")
        self.source.seek(place)
        return self.source.read(n)

    @staticmethod
    def _directory(data: bytes, count: int) -> Iterator[Member]:
        k = 0
        for _ in range(count):
            if data[k : k + 4] != b"PK\x01\x02":
                raise ValueError("the central directory is damaged")
            flags, method = struct.unpack_from("<HH", data, k + 8)
            stored, size, name_n, extra_n, comment_n = struct.unpack_from("<IIHHH", data, k + 20)
            (header,) = struct.unpack_from("<I", data, k + 42)
            name = data[k + 46 : k + 46 + name_n].decode("utf-8" if flags & 0x800 else "cp437")
            extra, e = data[k + 46 + name_n : k + 46 + name_n + extra_n], 0
            while e + 4 <= len(extra):
                kind, n = struct.unpack_from("<HH", extra, e)
                if kind == 1:  # ZIP64: only the fields that did not fit, in this order
                    wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, e + 4))
                    size = next(wide) if size == 0xFFFFFFFF else size
                    stored = next(wide) if stored == 0xFFFFFFFF else stored
                    header = next(wide) if header == 0xFFFFFFFF else header
                e += 4 + n
            yield Member(name, method, size, stored, header)
            k += 46 + name_n + extra_n + comment_n

    def start(self, member: Member) -> int:
        """Where the member's data begins, behind its local header."""
        head = self.at(member.header + self.shift, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("a local header is missing")
        name_n, extra_n = struct.unpack_from("<HH", head, 26)
        return member.header + self.shift + 30 + name_n + extra_n

    def range(self, member: Member, offset: int, n: int) -> bytes:
        """Bytes of a stored member."""
        if member.method:
            raise ValueError(f"{member.name} is compressed; ranges need a stored member")
        if offset < 0 or offset + n > member.size:
            raise ValueError("a range lies outside its member")
        return self.at(self.start(member) + offset, n)

    def whole(self, member: Member) -> bytes:
        """A small member, such as an index; stored or deflated."""
        data = self.at(self.start(member), member.stored)
        return zlib.decompress(data, -15) if member.method == 8 else self.range(member, 0, member.size)


# -- WARC records ----------------------------------------------------------------------------


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool) -> bytes:
    """One gzip member holding a response, or a revisit that has the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if is_revisit else head + payload
    uri = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url) if url else f"urn:page:{page_id}"
    fields = [("WARC-Type", "revisit" if is_revisit else "response"), ("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Target-URI", uri), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{digest32(payload)}")]
    if is_revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    record = "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"
    return gzip.compress(record, 1, mtime=0)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """WARC fields (lower-case names), HTTP head and payload of one record, gzip-compressed or plain."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, gap, payload = block.partition(b"\r\n\r\n")
    return fields, http + gap, payload


def _page_id(value: str) -> int | None:
    tail = value.strip("<>").rpartition(":")[2]
    return None if tail == "None" else int(tail)


# -- DataFrames ------------------------------------------------------------------------------


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Append ``is_revisit`` and ``refers_to``: of equal payloads the largest ``page_id`` is kept whole.

    Digests alone tell which pages are revisits; a payload that a third of all pages share is
    neither gathered nor sent to one task, as Spark may split its digests. Pages then meet their
    verdict by id and digest. Repeated rows of the largest page are responses both; a group of null
    page ids has no revisits.
    """
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    keyed = pages.withColumn("digest", F.unhex(F.sha1(body)))
    marks = pages.select("page_id", F.unhex(F.sha1(body)).alias("d"), F.length(body).alias("bytes")).where(F.col("bytes") >= least_bytes)
    groups = marks.groupBy("d").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 and first_id is not null")
    found = marks.select(F.col("page_id").alias("p"), "d").join(groups.select(F.col("d").alias("g"), "first_id"), F.col("d") == F.col("g"))
    again = written(found.where("p is null or p <> first_id").select("p", "d", "first_id").distinct(), "revisits")
    joined = keyed.join(again, keyed["page_id"].eqNullSafe(again["p"]) & (keyed["digest"] == again["d"]), "left")
    return joined.select("page_id", "url", "html", F.col("first_id").isNotNull().alias("is_revisit"), F.col("first_id").alias("refers_to"))


def write_packages(pages: DataFrame, folder: str, *, least_bytes: int = 0, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write a record per row and return the manifest: path, records and bytes of each package.

    A null ``html`` is an empty payload, a null ``url`` becomes ``urn:page:<id>``. Records go to the
    shared folder one by one, so a task holds one page's payload and the package's index. An empty
    table makes no package; other columns of ``pages`` are not read. A retried task writes under
    another name; only packages in the manifest count.
    """
    rows = with_revisits(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), least_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        part, done = TaskContext.get().partitionId(), []
        waiting = (row for whole in batches for batch in bounded(whole, 2) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        row = next(waiting, None)
        while row:
            path = f"{root}/pages-{part:06d}-{len(done):04d}-{uuid.uuid4().hex}.wacz"
            lines, at, payload_bytes = [], 0, 0
            with fs.open_output_stream(path) as out:
                with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
                    with z.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True) as archive:
                        while row and payload_bytes < package_bytes:
                            page, url, html, again, refers = row
                            payload = (html or "").encode()
                            record = build_record(page, url, payload, refers, again)
                            place = {"url": url, "filename": ARCHIVE, "offset": at, "length": len(record)}
                            lines.append(f"urn:page:{page} 19700101000000 {json.dumps(place)}\n")
                            archive.write(record)
                            at, payload_bytes = at + len(record), payload_bytes + len(payload)
                            row = next(waiting, None)
                    z.writestr(INDEX, "".join(lines))
                done.append((path, len(lines), out.tell()))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=["path", "n_records", "n_bytes"])
        release_memory()

    return written(rows.mapInArrow(run, "path string, n_records long, n_bytes long"), "warc-manifest")


def records(package: ZipRanges) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """All indexed records of a package, read in ranges of up to ``RANGE_BYTES``."""
    for name, member in package.members.items():
        if not (name.startswith("indexes/") and name.endswith((".cdx", ".cdxj"))):
            continue
        places = [json.loads("{" + line.partition("{")[2]) for line in package.whole(member).decode().splitlines() if "{" in line]
        places.sort(key=lambda p: (p["filename"], int(p["offset"])))
        i = 0
        while i < len(places):
            first, j = places[i], i + 1
            end = int(first["offset"]) + int(first["length"])
            while j < len(places) and places[j]["filename"] == first["filename"] and int(places[j]["offset"]) == end and end - int(first["offset"]) < RANGE_BYTES:
                end += int(places[j]["length"])
                j += 1
            archive = package.members.get(first["filename"]) or package.members[f"archive/{first['filename']}"]
            data, base = package.range(archive, int(first["offset"]), end - int(first["offset"])), int(first["offset"])
            for p in places[i:j]:
                yield parse_record(data[int(p["offset"]) - base :][: int(p["length"])])
            i = j


READ = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_packages(manifest: DataFrame, folder: str, *, payloads: bool = True) -> DataFrame:
    """A row per record. A response's digest is computed from the payload read and must be the stated one."""
    spread = manifest.select("path").repartition(shuffle_partitions(manifest.sparkSession), "path")
    names = [x.split()[0] for x in READ.split(", ")]

    def row(fields: dict[str, str], http: bytes, payload: bytes) -> tuple:
        stated, kind = fields["warc-payload-digest"].partition(":")[2], fields["warc-type"]
        if kind == "response":
            if digest32(payload) != stated:
                raise ValueError(f"payload of {fields['warc-record-id']} is damaged")
            n = len(payload)
        else:
            n = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        refers = _page_id(fields["warc-refers-to"]) if kind == "revisit" else None
        return _page_id(fields["warc-record-id"]), fields["warc-target-uri"], payload if payloads else None, n, stated, kind, refers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())
        emit = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with fs.open_input_file(path) as source:
                    rows, held = [], 0
                    for fields, http, payload in records(ZipRanges(source, source.size())):
                        rows.append(row(fields, http, payload))
                        held += len(payload) if payloads else 64
                        if held >= RANGE_BYTES:
                            yield emit(rows)
                            rows, held = [], 0
                    if rows:
                        yield emit(rows)

    return spread.mapInArrow(run, READ)


def op5_warc_packages(spark, sf_dir: str) -> DataFrame:
    """Every page into packages and back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    folder = shared_dir(spark, "warc")
    out = read_packages(write_packages(pages, folder), folder, payloads=False)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
