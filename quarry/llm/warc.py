"""WARC archives: a writer with revisits and a reader that salvages damaged files.

The writer makes one gzip member per record. Payload digests are aggregated first, each digest's
smallest page id with the count; only digests of several pages are joined back, spread over salts,
so a payload that a third of all pages share stays in many tasks. A page's member is compressed
once, before that join, and a revisit replaces it by a member without payload. Files are written
by Spark's text writer: a member ends with a byte 0 (the high byte of its length, which is below
16 MiB, else one byte of padding), and that byte is the separator.

The reader checks every member (its CRC and length, the version line, the lengths, the digests).
After a failed check it searches for the next place where a whole member, or in an uncompressed
file a version line with a readable header, begins; records from there on are recovered, and the
bytes between are reported as a gap with the reason. A member may hold any number of records:
``offset`` is the member's, ``inner`` the record's place in it, and ``length`` that of the member
where the record has it alone, else the record's own inside; a record that fails in a sound
member is a gap with its place and length inside, and of a damaged member the records before the
damage are recovered if their digests hold. Digests may be of any kind that hashlib has, in hex or
base32; header lines may be folded.

Defined results: null html is an empty payload; a null url is written as urn:unknown; pages of
the same digest and the smallest id, repeated rows among them, are all responses; null ids come
last; an empty table gives an archive without records; other columns are not read. Records may
have any length that fits a worker's memory; the writer starts a new file once ``FILE_BYTES`` are
reached, and a reader's file must be below 2 GiB, the bound of Spark's binary files.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import shared_path, text_of

VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
#: Payloads of fewer bytes are not deduplicated.
LEAST_BYTES = 100
SALTS = 32
#: Bytes after which a file ends (at the next record), so that it fits a reader's memory.
FILE_BYTES = 1 << 26
CHUNK = 1 << 16
LEVEL = 6


def record(page_id: int | None, url: str | None, kind: str, digest: str, payload: bytes, size: int, refers_to: int | None, date: str = DATE) -> bytes:
    """One record; that of a revisit has the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload
    uri = quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else "urn:unknown"
    lines = [
        VERSION,
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {uri}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = LEVEL) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _unended(gz: bytes) -> bytes:
    """A member without its last byte 0, which the writer adds as separator."""
    return gz[:-1] if gz[-1] == 0 else gz


def write(pages: DataFrame, path: str, ident: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write pages to archives (*.txt of gzip members) in a folder of whatever file system."""
    payload = text_of(html)
    digest = F.sha2(payload, 256)
    slim = pages.select(F.col(ident).cast("long").alias("id"), digest.alias("digest"), F.octet_length(payload).cast("long").alias("size"))
    heads = slim.where(F.col("size") >= LEAST_BYTES).groupBy("digest").agg(F.min("id").alias("head"), F.count("*").alias("n")).where("n > 1 and head is not null")
    heads = heads.select("digest", "head", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, urls, htmls = b.column(0), b.column(1), b.column(2).cast(pa.binary())
            made = []
            for i, u, h, d in zip(ids, urls, htmls, b.column(3), strict=True):
                h = h.as_py()
                made.append(_unended(member(record(i.as_py(), u.as_py(), "response", d.as_py(), h, len(h), None))))
            yield pa.RecordBatch.from_arrays([ids, urls, b.column(3), b.column(4), pa.array(made, pa.binary())], ["id", "url", "digest", "size", "gz"])

    rows = pages.select(F.col(ident).cast("long").alias("id"), F.col(url).alias("url"), payload.alias("html"), digest.alias("digest"), F.octet_length(payload).cast("long").alias("size"))
    rows = rows.mapInArrow(compress, "id long, url string, digest string, size long, gz binary")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    again = F.col("head").isNotNull() & ~F.coalesce(F.col("id") == F.col("head"), F.lit(False))
    most = FILE_BYTES

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Members in files of bounded size; those of revisits are made here."""
        from pyspark import TaskContext

        part, k, size = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            members, files = [], []
            for i, u, d, s, to, gz in zip(*batch.columns, strict=True):
                if to.is_valid:
                    m = _unended(member(record(i.as_py(), u.as_py(), "revisit", d.as_py(), b"", s.as_py(), to.as_py())))
                else:
                    m = gz.as_py()
                if size and size + len(m) >= most:
                    k, size = k + 1, 0
                size += len(m) + 1
                members.append(m)
                files.append(f"{part}-{k}")
            yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary()), pa.array(files, pa.string())], ["value", "file"])

    joined = rows.join(heads, ["digest", "salt"], "left").select("id", "url", "digest", "size", F.when(again, F.col("head")).alias("to"), "gz")
    # The bytes pass through a string column unchanged; the text writer ends each with a byte 0.
    out = joined.mapInArrow(filed, "value binary, file string").select(F.col("value").cast("string"), "file")
    out.write.partitionBy("file").option("lineSep", "\x00").mode("overwrite").text(path)


class Found(NamedTuple):
    """A record, or a gap: kind is then "gap" and reason says why."""

    kind: str
    offset: int
    length: int
    reason: str | None = None
    record_id: str | None = None
    url: str | None = None
    refers_to: str | None = None
    digest: str | None = None
    payload: bytes | None = None
    payload_bytes: int | None = None
    inner: int = 0


class Damaged(Exception):
    """A check that failed."""


class Short(Damaged):
    """A check that failed at the end of the bytes."""


_START = re.compile(rb"WARC/1\.[01]\r\n")
_GZIP = b"\x1f\x8b\x08"


def _headers(block: bytes) -> dict[str, str]:
    """Names and values; a line that starts with a blank goes on from the line before."""
    out = {}
    for line in re.sub(rb"\r\n[ \t]+", b" ", block).split(b"\r\n"):
        name, sep, value = line.partition(b":")
        if not sep:
            raise Damaged("header line without a colon")
        out[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return out


def _http_length(top: bytes) -> int | None:
    """The Content-Length of an HTTP header, whatever its other lines are like."""
    found = re.search(rb"(?im)^content-length:[ \t]*([0-9]{1,18})[ \t]*\r?$", top)
    return int(found[1]) if found else None


def _header_end(data, at: int) -> int:
    """The empty line that ends a header, however long; each search takes more bytes than the last."""
    step, a = CHUNK, at
    while a < len(data):
        found = bytes(data[a : a + step]).find(b"\r\n\r\n")
        if found >= 0:
            return a + found
        a, step = a + step - 3, 2 * step
    raise Short("header without an end")


def _holds(digest: str, data: bytes) -> bool | None:
    """Whether data has a digest (kind:value, in hex or base32); None if its kind is not known."""
    kind, sep, value = digest.partition(":")
    if not sep or kind.lower().replace("-", "") not in ("md5", "sha1", "sha224", "sha256", "sha384", "sha512"):
        return None
    own = hashlib.new(kind.lower().replace("-", ""), data, usedforsecurity=False).digest()
    return value.lower() == own.hex() or value.rstrip("=").upper() == base64.b32encode(own).decode().rstrip("=")


def _record(data, at: int) -> tuple[Found, int, bool]:
    """The record that starts at a place of uncompressed bytes, where it ends, and whether a digest of its block holds."""
    start = _START.match(data, at)
    if start is None:
        raise (Short if len(data) - at < len(VERSION) + 2 else Damaged)("no version line")
    end = _header_end(data, at)
    head = _headers(bytes(data[start.end() : end]))
    kind, size = head.get("warc-type"), head.get("content-length", "")
    if kind is None or not size.isdigit():
        raise Damaged("header without type or length")
    body = end + 4
    last = body + int(size)
    if len(data) < last + 4:
        raise Short("block shorter than its length")
    if bytes(data[last : last + 4]) != b"\r\n\r\n":
        raise Damaged("block shorter than its length")
    block = bytes(data[body:last])
    checked = _holds(head.get("warc-block-digest", ""), block)
    if checked is False:
        raise Damaged("block digest differs")
    payload, full = block, len(block)
    if head.get("content-type", "").startswith("application/http"):
        top, sep, payload = block.partition(b"\r\n\r\n")
        if not sep:
            raise Damaged("HTTP header without an end")
        said = _http_length(top)
        full = len(payload) if said is None else said
    digest = head.get("warc-payload-digest", "")
    if kind != "revisit" and _holds(digest, payload) is False:
        raise Damaged("payload digest differs")
    found = Found(
        kind, at, last + 4 - at, None, head.get("warc-record-id"), head.get("warc-target-uri"), head.get("warc-refers-to"),
        digest.removeprefix("sha256:") or None, None if kind == "revisit" else payload, full if kind == "revisit" else len(payload),
    )
    return found, last + 4, checked is True


def _member(data: memoryview, at: int) -> Iterator[Found | int]:
    """The records and inner gaps of the gzip member at a place and then, as a number, where it ends.

    Bytes are decompressed as records need them. From the first record without a digest on, records
    wait for the end of the member, whose CRC vouches for them.
    """
    z, plain, after = zlib.decompressobj(31), bytearray(), at
    waiting, n, inner, lost, reason, sure = [], 0, 0, -1, "", True

    def fed() -> bool:
        nonlocal after
        if z.eof:
            return False
        if after >= len(data):
            raise Damaged("member without an end")
        part = data[after : after + CHUNK]
        after += len(part)
        try:
            plain.extend(z.decompress(part))
        except zlib.error as e:
            raise Damaged(f"member: {e}") from e
        return True

    while True:
        try:
            found, end, checked = _record(plain, 0)
        except Damaged as e:
            if isinstance(e, Short) and fed():
                continue
            if not plain:
                break
            lost, reason = (inner, str(e)) if lost < 0 else (lost, reason)
            while (m := _START.search(plain, 1)) is None and fed():
                skip = max(0, len(plain) - CHUNK)  # a version line may span two pieces
                del plain[:skip]
                inner += skip
            skip = m.start() if m else len(plain)
            del plain[:skip]
            inner += skip
            continue
        if lost >= 0:
            waiting.append(Found("gap", at, inner - lost, reason, inner=lost))
            lost = -1
        waiting.append(found._replace(offset=at, inner=inner))
        n, sure = n + 1, sure and checked
        del plain[:end]
        inner += end
        if sure and n > 1:
            yield from waiting
            waiting = []
    if not n:
        raise Damaged(reason or "member without a record")
    end = after - len(z.unused_data)
    if lost >= 0:
        waiting.append(Found("gap", at, inner - lost, reason, inner=lost))
    if n == 1 and len(waiting) == 1:
        waiting[0] = waiting[0]._replace(length=end - at)
    yield from waiting
    yield end


def salvage(data) -> Iterator[Found]:
    """The records of an archive, compressed by member or not, and its gaps, in order of offset."""
    data = memoryview(data)
    raw = None  # for searching
    gz = plain = -1  # the next places to try, as far as they are known
    at, n = 0, len(data)
    lost, reason = -1, ""
    while at < n:
        if data[at] == 0 and lost < 0:  # padding after a member
            at += 1
            continue
        try:
            if bytes(data[at : at + 3]) == _GZIP:
                found = _member(data, at)
            else:
                f, end, _ = _record(data, at)
                found = [f, end]
            for f in found:
                if lost >= 0:
                    yield Found("gap", lost, at - lost, reason)
                    lost = -1
                if isinstance(f, int):
                    at = f
                else:
                    yield f
        except Damaged as e:
            if lost < 0:
                lost, reason = at, str(e)
            raw = bytes(data) if raw is None else raw
            if gz <= at:
                gz = raw.find(_GZIP, at + 1) % (n + 1)  # n where there is none
            if plain <= at:
                plain = m.start() if (m := _START.search(raw, at + 1)) else n
            at = min(gz, plain)
    if lost >= 0:
        yield Found("gap", lost, n - lost, reason)


SHAPE = "path string, kind string, offset long, length long, reason string, record_id string, url string, refers_to string, digest string, payload binary, payload_bytes long, inner long"


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of the archives below a path; payloads=False leaves payloads out once checked."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]]) for c in SHAPE.split(", ")])
        for b in batches:
            for name, content in zip(b.column(0), b.column(1), strict=True):
                held, size = [], 0
                for f in salvage(content.as_buffer()):
                    held.append((name.as_py(), *(f if payloads else f._replace(payload=None))))
                    size += len(f.payload or b"") if payloads else 0
                    if len(held) >= 1000 or size > 1 << 24:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(work, SHAPE)


def page_number(urn: Column) -> Column:
    """The page id of a record's name; null where it has none."""
    return F.regexp_extract(urn, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


def archived(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Pages written to archives and read back: records without payloads, and gaps."""
    path = path or shared_path(pages.sparkSession, "warc")
    write(pages, path)
    return read(pages.sparkSession, path, payloads=False)
