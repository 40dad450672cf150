"""WARC archives: a writer for pages and a salvage reader.

Writer. One record per page, each a gzip member of its own. The first page (smallest page_id) with a payload is a response;
pages with an equal payload are revisits, which carry no payload and refer to it. Members are written by Spark's text
sink (a record a line, whose separator is an empty gzip member), so any store that Spark reaches will do, and the commit
protocol discards what lost tasks began.

Salvage reader. An archive is read from front to back. A member or an uncompressed record that fails a check (gzip checksum, version
line, header block, Content-Length, record end, payload digest) isn't trusted: the reader searches for the next gzip member or
version line after its start that leads to a valid record, goes on there, and logs the bytes between as a quarantined gap. A member
that is sound itself but holds a broken record gives its other records, and so does one that breaks off or fails its checksum, as far as it can be
inflated (its records' length is told as 0); its bytes are logged. A header block that holds a version line is torn. Records of all types come
back; those other than responses have their block as payload (revisits none). Digests are checked where they are SHA-1; a transfer
encoding is kept as it was stored, and no payload digest is checked there.

Scale. Payload digests are found by SHA-1 on the JVM, the first page of each by an aggregation that combines within tasks; the html is
shuffled once, on the digest, where adaptive execution splits a payload that many pages share. An archive holds at most
ARCHIVE_RECORDS records, and is read by one task; archives are read in parallel.

Defined cases. Null html is an empty payload; a null url gives a record without target URI, and comes back as null. Rows with a
null page_id are never what others refer to unless no row with that payload has one. Rows that repeat the smallest page_id of a payload are all
responses. An empty table gives no archive and an empty result. Further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, scratch

ARCHIVE_RECORDS = 20_000
#: Payloads of fewer bytes are never revisited.
MIN_PAYLOAD = 0

_VERSION = b"WARC/1.1\r\n"
#: The date of records whose writer names none.
_NO_DATE = "1970-01-01T00:00:00Z"
_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
_NEXT_LINE = re.compile(rb"\r\nWARC/1\.[01]\r\n")
_CANDIDATE = re.compile(rb"\x1f\x8b\x08|" + _VERSION_LINE.pattern)
_EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff03000000000000000000")
_FEED = 1 << 16


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _un_urn(value: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
    return int(m[1]) if m else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, digest: str | None = None, date: str = _NO_DATE) -> bytes:
    """An uncompressed record; a revisit's block is the HTTP head alone, which still tells the payload's length."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\r\n%]", lambda m: f"%{ord(m[0]):02X}", url)))
    head.append(("WARC-Payload-Digest", "sha1:" + (digest or digest32(payload))))
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _urn(refers_to))]
    else:
        block += payload
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return _VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


@dataclass
class Record:
    offset: int
    length: int
    kind: str
    page_id: int | None
    url: str | None
    payload_bytes: int
    payload_digest: str
    refers_to: int | None
    payload: bytes | None


def _inflated(data: memoryview, at: int) -> tuple[bytes, int | None]:
    """What the member that starts there holds, and its end; where it breaks off or fails its checksum, what came out until then, and no end."""
    d, out, pos = zlib.decompressobj(31), [], at
    while not d.eof:
        if pos >= len(data):
            return b"".join(out), None
        before = d.copy()
        try:
            out.append(d.decompress(data[pos : pos + _FEED]))
        except zlib.error:
            return b"".join([*out, *_sipped(before, data[pos : pos + _FEED])]), None
        pos += _FEED
    return b"".join(out), min(pos, len(data)) - len(d.unused_data)


def _sipped(d, data: memoryview) -> Iterator[bytes]:
    """What comes out before the broken place, to the byte."""
    for size in (64, 1):
        while len(data):
            before = d.copy()
            try:
                yield d.decompress(data[:size])
            except zlib.error:
                d = before
                break
            data = data[size:]


class _Marks:
    """Where an archive's next version line and next end of a header block are. Asked at rising places, it reads the archive once, however many
    torn heads there are."""

    def __init__(self, data: bytes):
        self.data, self.line, self.end = data, -1, -1

    def head_end(self, at: int) -> int:
        """The end of the header block that starts there; -1 if there is none before the next record."""
        if self.end < at and self.end != len(self.data):
            found = self.data.find(b"\r\n\r\n", at)
            self.end = len(self.data) if found < 0 else found
        if self.line <= at and self.line != len(self.data):
            m = _NEXT_LINE.search(self.data, at + 8)
            self.line = m.start() + 2 if m else len(self.data)
        return self.end if self.end < min(self.line, len(self.data)) else -1


def _parsed(data: bytes, at: int, marks: _Marks) -> Record | None:
    """The uncompressed record that starts there, if all checks hold."""
    if data[at : at + 10] not in (b"WARC/1.0\r\n", b"WARC/1.1\r\n"):
        return None
    end = marks.head_end(at)
    if end < 0:
        return None
    head = _fields(data[at + 10 : end])
    size = head.get("content-length", "")
    kind = head.get("warc-type", "")
    if not (size.isascii() and size.isdigit()) or not kind:
        return None
    n = int(size)
    if end + 8 + n > len(data) or data[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
        return None
    block = data[end + 4 : end + 4 + n]
    if not _agrees(head.get("warc-block-digest"), block):
        return None
    digest, payload = head.get("warc-payload-digest"), block
    if "application/http" in head.get("content-type", ""):
        message, _, payload = block.partition(b"\r\n\r\n")
        http = _fields(message)
        told = http.get("content-length", "")
        if kind == "response" and "transfer-encoding" not in http and not _agrees(digest, payload):
            return None
        if kind == "response" and digest is None and told and told != str(len(payload)):
            return None  # the only length that the payload can be held against
    else:
        told = ""
        if kind != "revisit" and not _agrees(digest, payload):
            return None
    url = head.get("warc-target-uri")
    if url is not None:
        url = re.sub(r"%(0D|0A|25)", lambda x: chr(int(x[1], 16)), url)
    size = int(told) if kind == "revisit" and told.isascii() and told.isdigit() else 0 if kind == "revisit" else len(payload)
    digest = digest32(payload) if digest is None and kind != "revisit" else (digest or "").removeprefix("sha1:")
    payload = None if kind == "revisit" else payload
    return Record(at, end + 8 + n - at, kind, _un_urn(head.get("warc-record-id")), url, size, digest, _un_urn(head.get("warc-refers-to")), payload)


def _fields(head: bytes) -> dict[str, str]:
    """Named fields by their lower-case names; a line that begins with white space continues the one before."""
    lines = re.sub(rb"\r\n[ \t]+", b" ", head).decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip(" \t") for k, colon, v in (x.partition(":") for x in lines) if colon}


def _agrees(digest: str | None, data: bytes) -> bool:
    """False if the digest is the SHA-1 (base32 or hexadecimal) of something else."""
    name, _, value = (digest or "").partition(":")
    if name.lower() != "sha1":
        return True
    return value.lower() == hashlib.sha1(data).hexdigest() if len(value) == 40 else value.upper() == digest32(data)


def _at(data: bytes, view: memoryview, at: int, marks: _Marks) -> tuple[list[Record], int | None, bool] | None:
    """The records of the member or the record that starts there, its end (none if it is a broken member), and whether it is sound;
    None if nothing of it is."""
    if view[at : at + 2] == b"\x1f\x8b":
        inner, end = _inflated(view, at)
        records, gaps = salvage(inner, members=False)
        if not records and (gaps or end is None):
            return None
        for r in records:
            r.offset, r.length = at, (len(data) if end is None else end) - at
        return records, end, not gaps and end is not None
    r = _parsed(data, at, marks)
    return None if r is None else ([r], at + r.length, True)


def salvage(data: bytes, members: bool = True) -> tuple[list[Record], list[tuple[int, int]]]:
    """The valid records of an archive, in order, and the quarantined gaps as (offset, length). Without members: of plain records alone."""
    view, at, records, gaps, marks = memoryview(data), 0, [], [], _Marks(data)
    pattern = _CANDIDATE if members else _VERSION_LINE

    def found_at(at: int) -> tuple[list[Record], int, bool] | None:
        if not members:
            return ([r], at + r.length, True) if (r := _parsed(data, at, marks)) is not None else None
        if (found := _at(data, view, at, marks)) is None or found[1] is not None:
            return found
        for r in found[0]:  # of a broken member, whose end is unknown
            r.length = 0
        records.extend(found[0])
        return None

    found = found_at(0) if data else None
    while at < len(data):
        if found is not None:
            records += found[0]
            if not found[2]:
                gaps.append((at, found[1] - at))
            at = found[1]
            found = found_at(at) if at < len(data) else None
            continue
        start = at
        while found is None and at < len(data):
            m = pattern.search(data, at + 1)
            at = m.start() if m else len(data)
            found = found_at(at) if m else None
        gaps.append((start, at - start))
    return records, gaps


def write_archives(pages: DataFrame, path: str, min_payload: int = MIN_PAYLOAD, archive_records: int = ARCHIVE_RECORDS, date: str | None = None) -> None:
    """Archives of all rows (page_id, url, html) in the folder path; date: of all records (now, if none is named)."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("sha", F.unhex(F.sha1("html")))
    first = rows.groupBy("sha").agg(F.min("page_id").alias("first"))
    small = F.octet_length("html") < min_payload
    revisit = ~small & ~F.col("page_id").eqNullSafe(F.col("first"))
    roles = rows.join(first, "sha").select("page_id", "url", "html", "sha", revisit.alias("revisit"), "first")

    def members(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            out = [
                member(record(page_id, url, html.encode(), first if again else None, again, base64.b32encode(sha).decode(), date))
                for page_id, url, html, sha, again, first in zip(*(c.to_pylist() for c in b.columns), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])

    made = roles.mapInArrow(members, "member binary").select(F.col("member").cast("string").alias("value"))
    options = {"lineSep": _EMPTY_MEMBER.decode("latin-1"), "encoding": "ISO-8859-1", "maxRecordsPerFile": archive_records}
    made.write.options(**options).mode("overwrite").text(path)


_READ = "archive string, offset long, length long, kind string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def read_archives(spark: SparkSession, path: str, payloads: bool = True, names: str = "part-*") -> DataFrame:
    """All records that can be salvaged, and a row of kind 'gap' for each quarantined range of bytes."""
    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, types[t]) for n, t in (x.split() for x in _READ.split(", "))])

    def tasks(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for name, content in zip(b.column(0), b.column(1), strict=True):
                name, (records, gaps) = name.as_py(), salvage(content.as_py())
                rows = [(name, r.offset, r.length, r.kind, r.page_id, r.url, r.payload_bytes, r.payload_digest, r.refers_to, r.payload if payloads else None) for r in records]
                rows += [(name, at, n, "gap", None, None, None, None, None, None) for at, n in gaps]
                for k in range(0, len(rows), 1000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[k : k + 1000], strict=True), schema, strict=True)], schema=schema)

    return spark.read.format("binaryFile").option("pathGlobFilter", names).load(path).select("path", "content").mapInArrow(tasks, _READ)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write_archives(read_table(spark, sf_dir, "pages"), path)
    read = read_archives(spark, path, payloads=False).where("kind <> 'gap'")
    return read.select("page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to", "url")


#: Four base-32 digits for every five hexadecimal ones.
ORACLE = """
with p as (select page_id, url, coalesce(html, '') as payload from pages),
d as (select *, sha1(payload) as h, min(page_id) over (partition by payload) as first from p)
select page_id, cast(strlen(payload) as bigint) as payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         cast(((cast('0x' || substr(h, cast((i // 4) * 5 + 1 as bigint), 5) as bigint) >> cast(15 - 5 * (i % 4) as bigint)) & 31) + 1 as bigint), 1)), '') as payload_digest,
       case when page_id is not distinct from first then 'response' else 'revisit' end as record_type,
       case when page_id is not distinct from first then null else first end as refers_to, url
from d
"""
