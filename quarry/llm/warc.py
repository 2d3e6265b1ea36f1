"""WARC archives: writing, and reading with salvage.

Writing makes one record per page, each a gzip member of its own, and puts bounded runs of them into archive files of the
shared folder through Spark's text sink (one row a file; the sink ends a file with one line feed, which gzip readers ignore).
Pages whose payload was seen before, under a smaller page_id, become revisit records without payload.

Reading never trusts lengths. A record's header block and length must hold, and its digests and HTTP length where it states them.
After a failed check the reader searches for the next member magic or version line that starts a valid record, in a member's
inflated data too, goes on there, and logs the bytes between (of a member: its range) as a quarantined gap. A member that breaks
off gives the records of its readable prefix; one whose stream or checksum fails gives those that a digest proves.

Defined cases: null html is an empty payload; a null url is left out of the record; pages with a null page_id are written, and
named by others only if no page with an id has the payload; rows that repeat a page_id are
records of their own; empty archives and tables give no records and no gaps; other columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import delete_path, fresh_path, lookup, materialize

ARCHIVE_BYTES = 8_000_000
MEMBER = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
#: A header block ends at an empty line, and none holds another version line.
HEAD_END = re.compile(rb"\r\n(?:\r\n|WARC/1\.[01]\r\n)")
DATE = "2026-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, payload_digest: str, is_revisit: bool) -> bytes:
    """An uncompressed record. A revisit keeps the payload's length and digest in its headers."""
    body = b"" if is_revisit else payload
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + body
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {page_id} {url}')}>", f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {re.sub(r'[\x00-\x20]', lambda m: f'%{ord(m[0]):02X}', url)}"] if url else []), f"WARC-Payload-Digest: sha1:{payload_digest}", f"X-Page-ID: {'' if page_id is None else page_id}",
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {'' if refers_to is None else refers_to}"] if is_revisit else []),
        f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


@dataclass
class Record:
    page_id: int | None
    url: str | None
    record_type: str
    refers_to: int | None
    payload_digest: str
    payload_bytes: int
    payload: bytes


def _agrees(stated: str | None, data: bytes) -> bool | None:
    """Whether data has the digest stated (base32 or hex); None if none is stated or its algorithm is not known."""
    name, _, value = (stated or "").strip().partition(":")
    kind = name.lower().replace("-", "")
    if not value or kind not in ("md5", "sha1", "sha224", "sha256", "sha384", "sha512"):
        return None
    made = hashlib.new(kind, data).digest()
    return value.lower() == made.hex() or value.upper().rstrip("=") == base64.b32encode(made).decode().rstrip("=")


def _dechunked(body: bytes) -> bytes | None:
    """The content of a chunked HTTP body; None if its chunks do not hold."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9a-fA-F]{1,15}", size):
            return None
        n = int(size, 16)
        if not n:
            return b"".join(out)
        if body[end + 2 + n : end + 4 + n] != b"\r\n":
            return None
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n


def parse_record(data: bytes, at: int = 0, proven: bool = False) -> tuple[Record, int] | None:
    """The record at an offset and the offset after it; None if anything it states does not hold. ``proven``: only with a digest of its block or payload."""
    m = VERSION.match(data, at)
    if not m:
        return None
    ended = HEAD_END.search(data, m.end() - 2)
    if not ended or ended[0] != b"\r\n\r\n":
        return None
    end = ended.start()
    try:
        lines = re.sub(r"\r\n[ \t]+", " ", data[m.end() : end].decode()).split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, v in (line.split(":", 1) for line in lines)}
        length = int(fields["content-length"])
    except (ValueError, KeyError, UnicodeDecodeError):
        return None
    block = data[end + 4 : end + 4 + length]
    after = end + 4 + length + 4
    whole = _agrees(fields.get("warc-block-digest"), block)
    if length < 0 or len(block) != length or data[after - 4 : after] != b"\r\n\r\n" or whole is False:
        return None
    kind, stated = fields.get("warc-type", ""), fields.get("warc-payload-digest")
    http, _, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
    size = re.search(rb"(?im)^Content-Length:[ \t]*(\d+)", http)
    chunked = re.search(rb"(?im)^Transfer-Encoding:[^\r\n]*chunked", http)
    same = None
    if kind != "revisit":  # a revisit states the length and digest of a payload that it does not have
        if size and not chunked and kind == "response" and int(size[1]) != len(payload):
            return None
        same = _agrees(stated, payload)
        content = _dechunked(payload) if chunked else None
        if content is not None:  # writers state the digest of the body as sent, or of its content
            same = True if same else _agrees(stated, content)
            payload = content
        if same is False:
            return None
    if proven and not (whole or same):
        return None
    named = stated.partition(":")[2] if stated else "" if kind == "revisit" else digest(payload)
    number = lambda k: int(fields[k]) if fields.get(k) else None
    try:
        length = int(size[1]) if size and not chunked else len(payload)
        return Record(number("x-page-id"), fields.get("warc-target-uri"), kind, number("x-refers-to-page-id"), named, length, payload), after
    except ValueError:
        return None


def _inflate(data: bytes, at: int) -> tuple[bytes, int] | None:
    """A member's data and the offset after it; None if it does not inflate in whole."""
    unpacker, out, step = zlib.decompressobj(31), [], 1 << 16
    try:
        while not unpacker.eof and at < len(data):
            out.append(unpacker.decompress(data[at : at + step]))
            at += step
    except zlib.error:
        return None
    return (b"".join(out), min(at, len(data)) - len(unpacker.unused_data)) if unpacker.eof else None


def _prefix(data: bytes, at: int) -> tuple[bytes, bool]:
    """What a broken member inflates to before it fails or ends, and whether nothing but its end is missing."""
    unpacker, out, step = zlib.decompressobj(31), [], 4096
    while at < len(data):
        before = unpacker.copy() if step > 1 else None
        try:
            out.append(unpacker.decompress(data[at : at + step]))
        except zlib.error:
            if before is None:
                return b"".join(out), False
            unpacker, step = before, 1  # the failing piece again, byte by byte
            continue
        at += step
    return b"".join(out), True


class _Places:
    """The next place where a member or record may start; each kind's place is searched once, however many false ones precede it."""

    def __init__(self, data: bytes):
        self.data, self.member, self.version = data, -1, -1

    def after(self, at: int) -> int:
        n = len(self.data)
        if self.member <= at:
            self.member = place if (place := self.data.find(MEMBER, at + 1)) >= 0 else n
        if self.version <= at:
            self.version = found.start() if (found := VERSION.search(self.data, at + 1)) else n
        return min(self.member, self.version)


def _inside(plain: bytes, proven: bool) -> tuple[list[Record], bool]:
    """The records of a member's data, and whether they are all of it; after a failed one the search goes on at the next version line."""
    got, at, whole = [], 0, True
    while at < len(plain):
        one = parse_record(plain, at, proven)
        if one is None:
            whole = whole and not plain[at:].strip(b"\r\n")
            start = VERSION.search(plain, at + 1)
            if not start:
                break
            at = start.start()
            continue
        got.append(one[0])
        at = one[1]
    return got, whole


def salvage(data: bytes) -> Iterator[Record | tuple[int, int]]:
    """Records of an archive (gzip members or plain, also mixed) and the byte ranges (start, end) that hold what could not be read.

    The range of a member that is not read in whole is logged beside the records that it does give.
    """
    at, bad = 0, None
    n, places = len(data), _Places(data)
    while at < n:
        got: list[Record] | None = None
        if data.startswith(MEMBER, at):
            if unpacked := _inflate(data, at):
                plain, after = unpacked
                got, whole = _inside(plain, False)
                if not whole:
                    if bad is not None and bad < at:
                        yield bad, at
                    yield from got
                    yield at, after
                    bad, at = None, after
                    continue
            else:
                yield from _inside(*((p := _prefix(data, at))[0], not p[1]))[0]
        elif one := parse_record(data, at):
            got, after = [one[0]], one[1]
        if got is not None:
            if bad is not None:
                yield bad, at
                bad = None
            yield from got
            at = after
            continue
        bad = at if bad is None else bad
        at = places.after(at)
    if bad is not None and data[bad:].strip(b"\r\n"):
        yield bad, n


def _with_verdicts(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest and refers_to (null: response) of every page."""
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.unhex(F.sha1(F.col("html").cast("binary"))))
    first = rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first")).where("n > 1")
    first = materialize(first, "payloads")
    return lookup(rows, first, "digest", F.coalesce("page_id", F.xxhash64("url")), "n")


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes the pages as archive files of about ``archive_bytes`` under a path of any file system that Spark writes to."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for page_id, url, html, key, first in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                payload = html.encode()
                is_revisit = first is not None and first != page_id
                made = member(record(page_id, url, payload, first if is_revisit else None, base64.b32encode(key).decode(), is_revisit))
                held.append(made)
                size += len(made)
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["archive"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["archive"])

    rows = _with_verdicts(pages)
    made = rows.select("page_id", "url", "html", "digest", "first").mapInArrow(pack, "archive binary")
    made.select(F.col("archive").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


READ = "archive string, page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary, gap_start long, gap_end long"


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of all archives under a path; rows without record_type are quarantined gaps (gap_start, gap_end)."""
    names = [c.split()[0] for c in READ.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name = batch.column(0)[i].as_py()
                out, size = [], 0
                for x in salvage(batch.column(1)[i].as_py()):
                    if isinstance(x, Record):
                        out.append((name, x.page_id, x.url, x.record_type, x.refers_to, x.payload_digest, x.payload_bytes, x.payload if with_payload else None, None, None))
                        size += len(x.payload) if with_payload else 0
                    else:
                        out.append((name, None, None, None, None, None, None, None, *x))
                    if size > 8_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(unpack, READ)


def archive(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Writes all pages to archives in the shared folder; returns what the reader finds in them, and its log of gaps (archive, gap_start,
    gap_end). The archives are deleted once they are read."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_archives(pages, path)
    found = materialize(read_archives(spark, path, with_payload=False), "read")
    delete_path(spark, path)
    records = found.where("record_type is not null").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return records, found.where("record_type is null").select("archive", "gap_start", "gap_end")


def round_trip(pages: DataFrame) -> DataFrame:
    """The records that the reader finds in archives of all pages."""
    return archive(pages)[0]


def oracle_sql() -> str:
    """The same records in DuckDB: SHA-1 and its base32 form, five hex digits as four letters at a time."""
    letters, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789abcdef"
    value = " + ".join(f"(strpos('{digits}', substr(h, g * 5 + {i + 1}, 1)) - 1) * {16 ** (4 - i)}" for i in range(5))
    text = " || ".join(f"substr('{letters}', 1 + ((v // {32 ** (3 - i)}) % 32), 1)" for i in range(4))
    return f"""
with payloads as (select page_id, coalesce(html, '') as payload, sha1(coalesce(html, '')) as h from pages),
firsts as (select h, min(page_id) as first from payloads group by h)
select page_id, octet_length(encode(payload))::bigint as payload_bytes,
       array_to_string(list_transform(list_transform(range(8), lambda g: {value}), lambda v: {text}), '') as payload_digest,
       case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to
from payloads join firsts using (h)"""
