"""WARC archives: writer with identical-payload revisits, and a salvage reader.

Every record is a gzip member of its own. Spark's text writer puts the members into files on any
file system it can reach; between two members it writes ``_EMPTY``, a valid member of no bytes,
so the file is an ordinary ``.warc.gz``. The reader checks member checksums, version
lines, lengths and block digests; after a failed check it looks for the next valid member or
version line, inside a member too, and logs the bytes in between as a quarantined gap. ``start`` and ``end``
are places in the archive; what lies in a member has its place in the inflated content besides (``content_start``,
``content_end``). Of a broken member the records before the damage are kept. A record whose block digest is missing
or of an unknown algorithm is kept with ``verified`` false.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
_MAGIC = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_ALGORITHMS = {re.sub("[-_]", "", a): a for a in hashlib.algorithms_guaranteed if not a.startswith("shake")}
_EMPTY = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"
FIELDS = [("kind", pa.string()), ("archive", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("reason", pa.string()),
          ("record_type", pa.string()), ("record_id", pa.string()), ("target", pa.string()), ("refers_to", pa.string()),
          ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()),
          ("content_start", pa.int64()), ("content_end", pa.int64()), ("verified", pa.bool_())]
_DDL = ("kind string, archive string, start bigint, end bigint, reason string, record_type string, record_id string, "
        "target string, refers_to string, payload_digest string, payload_bytes bigint, payload binary, content_start bigint, content_end bigint, "
        "verified boolean")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def record(page_id, url: str | None, payload: bytes, refers_to=None) -> bytes:
    """One WARC record. A revisit holds the HTTP header of its response, whose length field is that of the full payload."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    block = block if revisit else block + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: "%%%02X" % ord(m[0]), url or f"urn:page:{page_id}")
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Target-URI: {target}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"] if revisit else []),
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, first): ``first`` is the response a row refers to, null for a response.

    Of equal payloads of at least ``least_bytes`` bytes the smallest id is the response. Null html is an
    empty payload; rows with a null id are responses; rows that repeat an id with its payload all are. The table of
    repeated payloads holds one row per payload, aggregated before it moves; the join may split a hot payload.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", html.alias("html")).withColumn(
        "_sha1", F.sha1(F.col("html").cast("binary"))).withColumn("_bytes", F.octet_length("html"))
    firsts = rows.where((F.col("_bytes") >= least_bytes) & F.col("page_id").isNotNull()).groupBy("_sha1", "_bytes").agg(
        F.min("page_id").alias("first"), F.max("page_id").alias("_last")).where("first <> _last").drop("_last")
    joined = rows.join(firsts, ["_sha1", "_bytes"], "left")
    return joined.select("page_id", "url", "html", F.when(F.col("page_id") != F.col("first"), F.col("first")).alias("first"))


def write(pages: DataFrame, path: str, least_bytes: int = 0, records_per_file: int = 20_000) -> None:
    """Archives of ``pages(page_id, url, html)`` in the new folder ``path``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                out = [member(record(p.as_py(), u.as_py(), h.as_py().encode("utf-8"), f.as_py()))
                       for p, u, h, f in zip(*batch.slice(i, 256).columns)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])

    rows = with_revisits(pages, least_bytes).mapInArrow(run, "member binary")
    rows.select(F.col("member").cast("string").alias("value")).write.option("lineSep", _EMPTY.decode("latin-1")).option(
        "encoding", "ISO-8859-1").option("maxRecordsPerFile", records_per_file).text(path)


def _member_at(data: memoryview, pos: int) -> tuple[bytes, int, bool]:
    """Content of the gzip member at ``pos``, its end and True; of a broken one what can be inflated, and False."""
    z = zlib.decompressobj(31)
    out = []
    for at in range(pos, len(data), 65536):
        part = data[at:at + 65536]
        before = z.copy()
        try:
            out.append(z.decompress(part))
        except zlib.error:
            # Byte by byte, so that nothing before the damage is lost.
            try:
                for i in range(len(part)):
                    out.append(before.decompress(part[i:i + 1]))
            except zlib.error:
                pass
            return b"".join(out), at, False
        if z.eof:
            return b"".join(out), at + len(part) - len(z.unused_data), True
    return b"".join(out), len(data), False


def _place_of(data: memoryview, pos: int, size: int) -> int:
    """Place in the archive, never too far, by which the member at ``pos`` has yielded ``size`` bytes."""
    z, at = zlib.decompressobj(31), pos
    while size > 0 and at < len(data):
        part = data[at:at + 65536]
        before = z.copy()
        try:
            size -= len(z.decompress(part, size))
            at += len(part) - len(z.unconsumed_tail)
        except zlib.error:
            # The damage lies behind the last byte asked for, but in its part.
            for i in range(len(part)):
                size -= len(before.decompress(part[i:i + 1]))
                if size <= 0:
                    return at + i
            break
    return at


def _fits(digest: str, block: bytes) -> bool | None:
    """Whether a digest field ``algorithm:value`` (hexadecimal, base32 or base64) is that of the block; None if unknown."""
    name, _, value = digest.partition(":")
    name = _ALGORITHMS.get(re.sub("[-_]", "", name.strip().lower()))
    if name is None:
        return None
    want, value = hashlib.new(name, block, usedforsecurity=False).digest(), value.strip().rstrip("=")
    bare = lambda encoded: encoded.decode().rstrip("=")
    return (value.lower() == want.hex() or value.upper() == bare(base64.b32encode(want))
            or value in (bare(base64.b64encode(want)), bare(base64.urlsafe_b64encode(want))))


def _sha1_text(digest: str | None) -> str | None:
    """A sha1 digest field as upper-case base32, like ``base32_sha1``; any other as it is."""
    name, _, value = (digest or "").partition(":")
    if name.strip().lower().replace("-", "") != "sha1":
        return digest or None
    value = value.strip()
    if re.fullmatch("[0-9A-Fa-f]{40}", value):
        return base64.b32encode(bytes.fromhex(value)).decode()
    return (value.upper() if re.fullmatch("[2-7A-Za-z]{32}", value) else value) or None


def _record_at(data: bytes, pos: int) -> tuple[dict | None, int, str]:
    """Record at a version line: (fields, end, reason of failure)."""
    stop = data.find(b"\r\n\r\n", pos)
    if not _VERSION.match(data, pos) or stop < 0:
        return None, pos, "no header"
    fields: dict = {}
    # A line that starts with a blank goes on with the line before.
    for line in re.sub("\r\n[ \t]+", " ", data[pos:stop].decode("utf-8", "replace")).split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            return None, pos, "bad header line"
        fields[name.strip().lower()] = value.strip()
    if not fields.get("content-length", "").isdecimal():
        return None, pos, "no length"
    start = stop + 4
    end = start + int(fields["content-length"])
    if data[end:end + 4] != b"\r\n\r\n":
        return None, pos, "wrong length"
    block = bytes(data[start:end])
    fits = _fits(fields.get("warc-block-digest", ""), block)
    if fits is False:
        return None, pos, "wrong digest"
    return fields | {"": block, "verified": fits is True}, end + 4, ""


def _row(fields: dict) -> dict:
    block: bytes = fields[""]
    kind = fields.get("warc-type", "")
    head, blank, payload = block.partition(b"\r\n\r\n")
    http = fields.get("content-type", "").startswith("application/http") and blank
    size = re.search(rb"(?im)^content-length:[ \t]*([0-9]+)", head) if http else None
    payload = payload if http else block
    full = kind != "revisit"
    bare = lambda s: s[1:-1] if s and s.startswith("<") else s
    return {"record_type": kind, "record_id": bare(fields.get("warc-record-id")), "target": fields.get("warc-target-uri"),
            "refers_to": bare(fields.get("warc-refers-to")),
            "payload_digest": base32_sha1(payload) if full else _sha1_text(fields.get("warc-payload-digest")),
            "payload_bytes": len(payload) if full else int(size[1]) if size else None, "payload": payload if full else None,
            "verified": fields["verified"]}


def _parsed(content: bytes) -> Iterator[tuple[dict | None, int, int, str]]:
    """Records (fields, start, end, "") of a member's content, and the gaps (None, start, end, reason) between them."""
    at, gap, reason = 0, None, ""
    while at < len(content):
        fields, end, why = _record_at(content, at)
        if fields is None:
            if gap is None:
                gap, reason = at, why
            at = content.find(b"WARC/1.", at + 1)
            at = len(content) if at < 0 else at
            continue
        if gap is not None:
            yield None, gap, at, reason
            gap = None
        yield fields, at, end, ""
        at = end
    if gap is not None:
        yield None, gap, len(content), reason


def salvage(archive: str, data: bytes) -> Iterator[dict]:
    """All records of one archive (compressed or plain), and the gaps between them."""
    view = memoryview(data)
    pos, gap, reason = 0, None, ""

    def row(fields: dict | None, start: int, end: int, why: str, inner=(None, None)) -> dict:
        rest = {"kind": "gap", "reason": why} if fields is None else {"kind": "record"} | _row(fields)
        return {"archive": archive, "start": start, "end": end, "content_start": inner[0], "content_end": inner[1]} | rest

    while pos < len(data):
        why = "no member or version line"
        if data.startswith(_MAGIC, pos):
            content, after, sound = _member_at(view, pos)
            if sound and gap is not None:
                yield row(None, gap, pos, reason)
                gap = None
            kept, hole = 0, None
            for fields, start, end, cause in _parsed(content):
                if fields is None and not sound:
                    hole = start, end, cause
                    continue
                if fields is not None:
                    if gap is not None:
                        yield row(None, gap, pos, reason)
                        gap = None
                    if hole is not None:
                        yield row(None, pos, after, hole[2], hole[:2])
                        hole = None
                    kept = end
                yield row(fields, pos, after, cause, (start, end))
            if sound:
                pos = after
                continue
            why = "broken member"
            if kept:
                # The rest of a broken member is a gap from the end of its last record on.
                pos = gap = max(pos + 1, _place_of(view, pos, kept))
                reason = why
        elif data.startswith(b"WARC/1.", pos):
            fields, end, why = _record_at(data, pos)
            if fields is not None:
                if gap is not None:
                    yield row(None, gap, pos, reason)
                    gap = None
                yield row(fields, pos, end, "")
                pos = end
                continue
        if gap is None:
            gap, reason = pos, why
        following = [x for x in (data.find(_MAGIC, pos + 1), data.find(b"WARC/1.", pos + 1)) if x >= 0]
        pos = min(following, default=len(data))
    if gap is not None:
        yield row(None, gap, len(data), reason)


def read(archives: DataFrame) -> DataFrame:
    """Rows of ``FIELDS`` from ``archives(path, content)``: ``kind`` is record or gap. Null contents hold nothing."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                rows, size = [], 0
                for row in salvage(path.as_py(), content.as_py() or b""):
                    rows.append(row)
                    size += len(row.get("payload") or b"")
                    if len(rows) >= 1000 or size > 4_000_000:
                        yield pa.RecordBatch.from_pylist(rows, pa.schema(FIELDS))
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema(FIELDS))

    return archives.select("path", "content").mapInArrow(run, _DDL)


def read_folder(spark, path: str) -> DataFrame:
    return read(spark.read.format("binaryFile").load(path))


def round_trip(pages: DataFrame, path: str) -> DataFrame:
    """Write ``pages`` and read them back: (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    write(pages, path)
    number = lambda c: F.regexp_extract(c, r"^urn:page:(-?[0-9]+)$", 1).try_cast("bigint")
    return read_folder(pages.sparkSession, path).where("kind = 'record'").select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
