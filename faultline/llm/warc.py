"""WARC archives: written as gzip members, read back by a reader that survives damage.

Writing: pages that share a payload of ``REVISIT_BYTES`` or more become one response and revisit records. Each record is
a gzip member of its own; Spark's text writer puts them into files (``part-*.txt`` by that writer's naming), with an
empty member as the line separator, so any file system that Spark knows will do and the files are ordinary multi-member
gzip. Reading: a record that fails a check costs only itself. The reader goes on at the next gzip header or version line
that holds a valid record and reports the bytes between as a gap. The same is done with the contents of a gzip member, and
with what a damaged member gives before it breaks off.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from faultline.session import settle

REVISIT_BYTES = 1000
#: Of payloads that repeat, the most frequent ones that all tasks know; the others are joined by digest.
REPEATED = 1 << 16
RECORDS_PER_FILE = 2000
DATE = "1970-01-01T00:00:00Z"
#: Fixed by the format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: gzip of nothing.
EMPTY_MEMBER = bytes.fromhex("1f8b0800000000000003" "0300" "0000000000000000")

_ID = "urn:x-page:"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def _base32(hexdigest: str) -> str:
    return base64.b32encode(bytes.fromhex(hexdigest)).decode()


def _line(value: str) -> str:
    """A header value without control characters."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit when ``refers_to`` is given."""
    block = _HTTP.format(len(payload)).encode() + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{_base32(digest)}", f"WARC-Block-Digest: sha1:{_base32(hashlib.sha1(block).hexdigest())}",
             "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_warc(pages: DataFrame, path: str) -> None:
    """Write a record for every row of ``page_id, url, html``; further columns are left out.

    A null html is an empty payload, a null url leaves its header out, a null id stays empty. Of rows with one payload of
    at least ``REVISIT_BYTES`` those with the largest id are responses, also where that id repeats; the others revisit it.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = F.octet_length("payload") >= REVISIT_BYTES
    kept = settle(rows.filter(large).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
                  .filter("n > 1"))
    rows = rows.join(F.broadcast(kept.orderBy(F.desc("n"), "digest").limit(REPEATED).select("digest", "keeper", "n")), "digest", "left")
    if kept.count() > REPEATED:
        # what is decided already, and small payloads, are dealt out by row
        seen = kept.orderBy(F.desc("n"), "digest").limit(REPEATED).select("digest")
        rest = kept.join(F.broadcast(seen), "digest", "left_anti").select(F.col("digest").alias("_key"), F.col("keeper").alias("_keeper"))
        alone = F.concat(F.lit("-"), F.xxhash64(F.monotonically_increasing_id()).cast("string"))
        rows = rows.withColumn("_key", F.when(large & F.col("n").isNull(), F.col("digest")).otherwise(alone))
        rows = rows.join(rest, "_key", "left").withColumn("keeper", F.coalesce("keeper", "_keeper"))
    refers = F.when(F.coalesce(F.col("page_id") != F.col("keeper"), F.col("keeper").isNotNull()), F.col("keeper"))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                out = [gzip.compress(record(*(x.as_py() for x in row)), 6, mtime=0)
                       for row in zip(*batch.slice(at, 500).columns)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    (rows.select("page_id", "url", "payload", "digest", refers.alias("refers_to")).mapInArrow(members, "value binary")
     .select(F.col("value").cast("string")).write.option("maxRecordsPerFile", RECORDS_PER_FILE)
     .option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").text(path))


class Damaged(Exception):
    """A check failed."""


class BrokenMember(Damaged):
    """A gzip member that breaks off or fails its checksum; ``inner`` came out before, from the bytes up to ``end``."""

    def __init__(self, reason: str, inner: bytes, end: int, sound: bool) -> None:
        super().__init__(reason)
        self.inner, self.end, self.sound = inner, end, sound


_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_NEXT = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")


def _inflate(data: bytes, start: int) -> tuple[bytes, int]:
    """(contents, end) of the gzip member at ``start``; its checksum holds."""
    inflater, out, at = zlib.decompressobj(31), [], start
    try:
        while not inflater.eof:
            if at >= len(data):
                raise BrokenMember("truncated member", b"".join(out), len(data), True)
            out.append(inflater.decompress(data[at:at + 65536]))
            at += 65536
    except zlib.error as e:
        raise BrokenMember("bad member", *_before_error(data, start, at), False) from e
    return b"".join(out), min(at, len(data)) - len(inflater.unused_data)


def _before_error(data: bytes, start: int, last: int) -> tuple[bytes, int]:
    """(what the member at ``start`` gives before its error, where that is), in the block of input at ``last``."""
    inflater, out = zlib.decompressobj(31), []
    for at in range(start, last, 65536):
        out.append(inflater.decompress(data[at:at + 65536]))
    for at in range(last, min(last + 65536, len(data))):
        try:
            out.append(inflater.decompress(data[at:at + 1]))
        except zlib.error:
            return b"".join(out), at
    return b"".join(out), min(last + 65536, len(data))


def _parse(data: bytes, start: int) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, end) of the record at ``start``; its length and digest hold."""
    version = _VERSION.match(data, start)
    end = data.find(b"\r\n\r\n", start)
    if not version or end < 0:
        raise Damaged("no header")
    lines = data[version.end():end].decode("utf-8", "replace").split("\r\n")
    headers = {k.strip().lower(): v.strip() for k, sep, v in (x.partition(":") for x in lines) if sep}
    if _NEXT.search(data, version.end(), end) or "warc-type" not in headers or "warc-record-id" not in headers:
        raise Damaged("broken header")
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        raise Damaged("no length")
    stop = end + 4 + int(length)
    if data[stop:stop + 4] != b"\r\n\r\n":
        raise Damaged("wrong length")
    block = data[end + 4:stop]
    digest = headers.get("warc-block-digest")
    if digest and digest != "sha1:" + _base32(hashlib.sha1(block).hexdigest()):
        raise Damaged("wrong digest")
    return headers, block, stop + 4


Record = tuple[dict[str, str], bytes]


def _inside(inner: bytes, digests: bool = False) -> tuple[list[Record], list[tuple[int, int, str]]]:
    """(records, gaps as start, end, reason) of a member's contents; with ``digests`` only records that a digest confirms."""
    found, gaps, at, gap, why = [], [], 0, None, ""
    while at < len(inner):
        try:
            headers, block, end = _parse(inner, at)
            if digests and not headers.get("warc-block-digest"):
                raise Damaged("no digest in a bad member")
        except Damaged as e:
            if gap is None:
                gap, why = at, str(e)
            after = _VERSION.search(inner, at + 1)
            at = after.start() if after else len(inner)
            continue
        if gap is not None:
            gaps.append((gap, at, why))
            gap = None
        found.append((headers, block))
        at = end
    if gap is not None:
        gaps.append((gap, len(inner), why))
    return found, gaps


def salvage(data: bytes) -> Iterator[tuple[int, int, str | None, list[Record]]]:
    """(offset, length, reason, records): valid stretches without a reason, gaps with the first failure's reason.

    A gap inside a member has the member's offset and length, and its reason names the bytes of the contents. Records out of a
    broken member have the offset and length of the gap it lies in; if the member fails its checksum, a digest of their own has
    to confirm them.
    """
    at, gap, why, saved, inner_gaps, until, known = 0, None, "", [], [], 0, set()

    def closed(end: int) -> Iterator[tuple[int, int, str | None, list[Record]]]:
        if saved:
            yield gap, end - gap, None, saved
        yield gap, end - gap, why, []
        for a, b, reason in inner_gaps:
            yield gap, end - gap, f"{reason}: bytes {a} to {b} of a member's contents", []

    while at < len(data):
        found, inside, end, failure = [], [], at, None
        try:
            if data[at:at + 3] == b"\x1f\x8b\x08":
                inner, end = _inflate(data, at)
                found, inside = _inside(inner)
                if inside and not found:
                    failure = inside[0][2]
            else:
                headers, block, end = _parse(data, at)
                found = [(headers, block)]
                if at < until and (headers["warc-record-id"], block) in known:  # an uncompressed part of a broken member
                    at = end
                    continue
        except Damaged as e:
            failure, end = str(e), at + 1
            if isinstance(e, BrokenMember):
                more, inside = _inside(e.inner, digests=not e.sound)
                if more:
                    saved, inner_gaps, until = saved + more, inner_gaps + inside, max(until, e.end)
                    known.update((h["warc-record-id"], block) for h, block in more)
        if failure is not None:
            if gap is None:
                gap, why = at, failure
            after = _NEXT.search(data, end)
            at = after.start() if after else len(data)
            continue
        if gap is not None:
            yield from closed(at)
            gap, saved, inner_gaps, known = None, [], [], set()
        yield at, end - at, None, found
        for a, b, reason in inside:
            yield at, end - at, f"{reason}: bytes {a} to {b} of a member's contents", []
        at = end
    if gap is not None:
        yield from closed(len(data))


def _page(uri: str | None) -> int | None:
    m = re.fullmatch(rf"<{_ID}(-?\d+)>", uri or "")
    return int(m[1]) if m else None


def _row(headers: dict[str, str], block: bytes) -> dict:
    kind = headers.get("warc-type", "")
    http, _, body = block.partition(b"\r\n\r\n")
    if kind == "response":
        size, digest = len(body), hashlib.sha1(body).hexdigest()
    else:
        m = re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d+)", http)
        size = int(m[1]) if m else None
        named = headers.get("warc-payload-digest", "").removeprefix("sha1:")
        digest = base64.b32decode(named).hex() if re.fullmatch("[A-Z2-7]{32}", named) else None
    return {"page_id": _page(headers.get("warc-record-id")), "url": headers.get("warc-target-uri"), "record_type": kind,
            "payload_bytes": size, "payload_digest": digest, "refers_to": _page(headers.get("warc-refers-to")),
            "payload": body if kind == "response" else None}


_SCHEMA = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("reason", pa.string()),
                     ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
                     ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
_DDL = ("path string, offset long, length long, reason string, page_id long, url string, record_type string, "
        "payload_bytes long, payload_digest string, refers_to long, payload binary")


def _scan(spark: SparkSession, path: str, payloads: bool) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(*batch.columns):
                rows = []
                for offset, length, reason, found in salvage(content.as_py()):
                    here = {"path": name.as_py(), "offset": offset, "length": length, "reason": reason}
                    new = [here | _row(h, b) for h, b in found] if reason is None else [here]
                    rows += new if payloads else [{k: v for k, v in r.items() if k != "payload"} for r in new]
                    if len(rows) >= 500:
                        yield pa.RecordBatch.from_pylist(rows, _SCHEMA)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(scan, _DDL)


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The valid records of all archives below ``path``, gzip or plain; each file is read by one task."""
    return _scan(spark, path, payloads).filter("reason IS NULL").drop("reason")


def read_gaps(spark: SparkSession, path: str) -> DataFrame:
    """``path, offset, length, reason`` of the quarantined stretches; a stretch inside a member has the member's place."""
    return _scan(spark, path, False).filter("reason IS NOT NULL").select("path", "offset", "length", "reason")
