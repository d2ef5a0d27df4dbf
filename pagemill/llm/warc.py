"""Operator 2: WARC archives, written and read back with segments reassembled.

Writing.  A page becomes a ``response`` record whose block is an HTTP response in
chunked transfer framing.  Of payloads of at least ``least`` bytes that are equal,
the one with the largest page_id is written; the others become ``revisit`` records
that refer to it.  A block longer than ``segment`` bytes is cut into the first
record and ``continuation`` records, which carry the origin's identifier, their
number and, the last one, the total length.  Each record is a gzip member of its
own.  Spark's text writer writes them: the last byte of a member is the highest of
its length, which is zero, and so is the line separator, so the file consists of
members and nothing else.  Payloads are not shuffled while the table of repeated
digests has at most ``SENT`` rows.

Reading.  Our own archives are read by Spark's text reader with the fixed header of
a member as the separator, so files of any size are split and streamed, and a row is
a record.  Any other archive is a row a file, whose members and records are parsed
one after the other (Spark reads such files up to 2 GB).  A record is parsed by the
length in its header, so a payload may hold anything.  Continuations are grouped by
origin and ordered by number; the number of segments and the total length are
verified, then the chunked framing is decoded and the payload's digest compared.
Each file is parsed once; a group is one record.  Revisits get their size from the
record they refer to.

Edges: a null html is an empty payload; a null url leaves out the target; a null
page_id is written as ``null`` and read as null; rows that repeat the largest page_id
of equal payloads are all responses; rows equal in page_id and payload keep their
urls.  An empty table gives no rows.  Faults (a cut or damaged member, a missing or
wrong length, no identifier, a missing segment, bad framing, another digest) give a
row with ``error`` set and its payload null, and what follows in the file is read on
from the next record that can be found.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import components, tables, words

LEAST = 1000
SEGMENT, CHUNK = 16 << 10, 4 << 10
MOST_SEGMENT = 8 << 20  # so that the length of a member stays below 1 << 24
FILE_RECORDS = 20_000
SENT = 100_000  # repeated digests that are sent to all tasks, at most; about 60 bytes each
STEP = 1 << 20  # bytes that are inflated at once
DATE = "2000-01-01T00:00:00Z"
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff"  # header of our gzip members
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def _cut(data: bytes, size: int) -> list[bytes]:
    """Pieces of about ``size`` bytes that do not split a character."""
    out, at = [], 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        out.append(data[at:end])
        at = end
    return out


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in _cut(payload, size)) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """Decode chunked transfer framing; chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        out.append(body[at : at + size])
        at += size + 2


def _record(kind: str, name: str, block: bytes, more: list[tuple[str, str]]) -> str:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", DATE), *more, ("Content-Length", str(len(block)))]
    return "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n" + block.decode()


def records(page_id: int | None, url: str | None, html: str | None, refers_to: int | None, segment: int = SEGMENT, key: str = "0", refers_key: str = "0") -> list[str]:
    """The records of a page, without what ends them; ``key`` tells pages of one id and payload apart."""
    payload = (html or "").encode()
    digest = hashlib.sha1(payload).digest()
    name = f"urn:x-page:{'null' if page_id is None else page_id}:{key}:{digest.hex()}"
    more = [("WARC-Payload-Digest", "sha1:" + base64.b32encode(digest).decode())]
    if url is not None:
        more.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    http = ("Content-Type", "application/http;msgtype=response")
    if refers_to is not None:
        return [_record("revisit", name, _HTTP, [*more, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:x-page:{refers_to}:{refers_key}:{digest.hex()}>"), http])]
    block = _HTTP + chunked(payload)
    parts = _cut(block, segment)
    if len(parts) == 1:
        return [_record("response", name, block, [*more, http])]
    out = [_record("response", name, parts[0], [*more, ("WARC-Segment-Number", "1"), http])]
    for i, part in enumerate(parts[1:], 2):
        last = [("WARC-Segment-Total-Length", str(len(block)))] if i == len(parts) else []
        out.append(_record("continuation", f"{name}:{i}", part, [("WARC-Segment-Origin-ID", f"<{name}>"), ("WARC-Segment-Number", str(i)), *last]))
    return out


def member(record: bytes) -> bytes:
    """A record with its end as a gzip member; the last byte is zero."""
    data = record + END
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    return MEMBER + z.compress(data) + z.flush() + struct.pack("<II", zlib.crc32(data), len(data))


def write(pages: DataFrame, path: str, least: int = LEAST, segment: int = SEGMENT, sent: int = SENT) -> None:
    """Write the archive files of page_id, url and html to a folder that executors share."""
    if not 0 < segment <= MOST_SEGMENT:
        raise ValueError(f"segment must be from 1 to {MOST_SEGMENT}")
    components.shared_folder(pages.sparkSession)
    text, url = F.coalesce(F.col("html").cast("string"), F.lit("")), F.col("url").cast("string")
    rows = tables.named(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), F.hex(F.xxhash64(url)).alias("key"), text.alias("html"), F.sha1(text.cast("binary")).alias("digest"), F.octet_length(text).alias("size"))
    # Equal payloads: only digests that occur more than once are joined back.
    kept = F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "key")))
    again = rows.where(F.col("size") >= least).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), kept.alias("kept")).where("n > 1 and kept is not null").select("digest", "kept").checkpoint()
    joined = rows.join(F.broadcast(again) if again.count() <= sent else again.hint("merge"), "digest", "left")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("kept.page_id")), F.col("kept"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.small(batches, 256):
            cols = [batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")]
            keys = [batch.column(c).to_pylist() for c in ("key", "refers_key")]
            out = [member(r.encode())[:-1] for row, more in zip(zip(*cols, strict=True), zip(*keys, strict=True), strict=True) for r in records(*row, segment, *more)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    made = joined.select("page_id", "url", "html", "key", refers["page_id"].alias("refers_to"), refers["key"].alias("refers_key")).mapInArrow(run, "value binary")
    made.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", FILE_RECORDS).text(path)


# -- parsing

Head = dict[str, str]


def _fault(text: str) -> tuple[Head, bytes]:
    return {"error": text}, b""


def _inflated(data: bytes) -> Iterator[bytes | None]:
    """The content of each gzip member, in pieces; None after a fault, when what follows starts anew."""
    at = 0
    while at < len(data):
        z, begun, left = zlib.decompressobj(31), at, b""
        try:
            while not z.eof:
                if not left:
                    left, at = data[at : at + STEP], at + STEP
                if not left:
                    raise zlib.error("cut off")
                piece = z.decompress(left, STEP)
                left = z.unconsumed_tail
                if piece:
                    yield piece
            at = min(at, len(data)) - len(z.unused_data)
        except zlib.error:
            yield None
            at = data.find(MEMBER[:3], begun + 1)
            if at < 0:
                return
            continue
        if data[at : at + 2] != MEMBER[:2]:
            at = len(data)


def _pieces(data: bytes) -> Iterator[bytes | None]:
    if data[:2] == MEMBER[:2]:
        yield from _inflated(data)
    else:
        yield from (data[i : i + STEP] for i in range(0, len(data), STEP))


class Reader:
    """Takes an archive in pieces and gives its records; it holds one record at a time."""

    def __init__(self):
        self.buffer, self.need = bytearray(), 0

    def feed(self, piece: bytes, last: bool = False) -> Iterator[tuple[Head, bytes]]:
        self.buffer += piece
        while len(self.buffer) >= self.need or last:
            while self.buffer[:2] == b"\r\n":
                del self.buffer[:2]
            if not self.buffer:
                return
            end = self.buffer.find(END)
            if end < 0:
                if last:
                    yield _fault("a record is cut off in its header")
                    self.buffer.clear()
                self.need = len(self.buffer) + 1
                return
            version, *lines = bytes(self.buffer[:end]).decode("utf-8", "replace").split("\r\n")
            head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            size = head.get("content-length", "")
            if not version.startswith("WARC/"):
                yield self._skip(0, "no record where one must start")
            elif not re.fullmatch("[0-9]{1,18}", size):
                yield self._skip(end, "a record without a length")
            else:
                start, stop = end + 4, end + 4 + int(size)
                after = bytes(self.buffer[stop : stop + 9])
                if len(self.buffer) < stop + 9 and not last:
                    self.need = stop + 9
                    return
                self.need = 0
                if stop > len(self.buffer) or after != END[: len(after)] + b"WARC/"[: max(0, len(after) - 4)]:
                    yield self._skip(end, "a record is cut off" if stop > len(self.buffer) else "a record does not end where its length says")
                else:
                    yield head, bytes(self.buffer[start:stop])
                    del self.buffer[:stop]
            self.need = 0

    def _skip(self, start: int, text: str) -> tuple[Head, bytes]:
        """Go on at the next place that looks like a record."""
        at = self.buffer.find(END + b"WARC/", start)
        del self.buffer[: at if at >= 0 else len(self.buffer)]
        return _fault(text)


def parsed(data: bytes) -> Iterator[tuple[Head, bytes]]:
    """(headers with lower-case names, block) of each record of a file; a fault has the header ``error`` only."""
    reader = Reader()
    for piece in _pieces(data):
        if piece is None:
            yield from reader.feed(b"", last=True)
            yield _fault("a gzip member is damaged or cut off")
        else:
            yield from reader.feed(piece)
    yield from reader.feed(b"", last=True)


def _member_records(body: bytes) -> Iterator[tuple[Head, bytes]]:
    """The records of one of our members, without its header."""
    z = zlib.decompressobj(-15)
    try:
        data = z.decompress(body) + z.flush()
    except zlib.error:
        data = None
    if data is None or z.unused_data != struct.pack("<II", zlib.crc32(data), len(data)):
        yield _fault("a gzip member is damaged or cut off")
    else:
        yield from parsed(data)


Part = tuple[str | None, int, int | None, str | None, str | None, str | None, str | None, bytes | None, str | None]
_PART = "origin string, number int, total long, kind string, refers string, digest string, target string, block binary, error string"
_PARTS = pa.schema([("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("kind", pa.string()), ("refers", pa.string()), ("digest", pa.string()), ("target", pa.string()), ("block", pa.binary()), ("error", pa.string())])


def _part(h: Head, block: bytes) -> Part:
    if "error" in h:
        return None, 0, None, None, None, None, None, None, h["error"]
    name, origin = h.get("warc-record-id", "").strip("<>"), h.get("warc-segment-origin-id", "").strip("<>")
    number, total, digest = h.get("warc-segment-number", "0"), h.get("warc-segment-total-length"), h.get("warc-payload-digest")
    try:
        if not name or "warc-type" not in h:
            raise ValueError("a record without an identifier or a type")
        if digest is not None:
            kind, _, text = digest.partition(":")
            digest = base64.b32decode(text).hex() if kind == "sha1" else None  # other digests are not compared
        return origin or name, int(number), int(total) if total else None, h["warc-type"], h.get("warc-refers-to", "").strip("<>") or None, digest, h.get("warc-target-uri"), block, None
    except ValueError as e:
        return origin or name or None, 0, None, h.get("warc-type"), None, None, h.get("warc-target-uri"), None, str(e)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _parts(parse, payloads: bool):
    """A row a record; the blocks of records that are not in segments are checked here, and kept if payloads are wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for content in batch.column("content"):
                for h, block in parse(content.as_py()):
                    part = _part(h, block)
                    if part[1] == 0 and part[-1] is None:
                        part = _checked(part, payloads)
                    rows.append(part)
                    size += 1000 + len(part[7] or b"")
                    if size > 4 << 20:
                        yield _batch(rows, _PARTS)
                        rows, size = [], 0
        if rows:
            yield _batch(rows, _PARTS)

    return run


def _page(name: str | None) -> int | None:
    found = re.fullmatch(r"urn:x-page:(-?\d+):.*", name or "")
    return int(found[1]) if found else None


def _payload(kind: str, numbers: list[int], totals: list[int | None], blocks: list[bytes], digest: str | None) -> bytes | None:
    if numbers != [0]:
        if numbers != list(range(1, len(numbers) + 1)):
            raise ValueError(f"segments {numbers[:20]} are not all there")
        if totals[-1] != sum(map(len, blocks)):
            raise ValueError(f"segments have {sum(map(len, blocks))} bytes, not {totals[-1]}")
    if kind == "revisit":
        return None
    head, gap, body = b"".join(blocks).partition(b"\r\n\r\n")
    payload = unchunked(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked", head) else body
    if digest is not None and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError("the payload has another digest")
    return payload


def _checked(part: Part, payloads: bool) -> Part:
    """A record of one part: ``total`` becomes the payload's length, ``block`` the payload."""
    origin, number, _, kind, refers, digest, target, block, _ = part
    try:
        payload = _payload(kind, [0], [None], [block], digest)
    except (ValueError, IndexError) as e:
        return origin, number, None, kind, refers, digest, target, None, str(e)
    return origin, number, None if payload is None else len(payload), kind, refers, digest or (hashlib.sha1(payload).hexdigest() if payload is not None else None), target, payload if payloads else None, None


_WHOLE = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary, error string"
_WHOLES = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("error", pa.string())])


def _whole(parts: list[dict], payloads: bool) -> Iterator[tuple]:
    """The rows of one origin: each record that was whole, and what its segments give together."""
    for p in parts:
        if p["number"] == 0:
            yield _page(p["origin"]), p["target"], p["kind"], _page(p["refers"]), p["digest"], p["total"], p["block"], p["error"]
    cut = sorted((p for p in parts if p["number"] != 0), key=lambda p: p["number"])
    if not cut:
        return
    # A repeated row was written as a repeated record: as many wholes as first segments.
    first = cut[0]
    copies = sum(p["number"] == first["number"] for p in cut)
    cut = [p for i, p in enumerate(cut) if i == 0 or p["number"] != cut[i - 1]["number"]]
    payload, error = None, None
    try:
        payload = _payload(first["kind"], [p["number"] for p in cut], [p["total"] for p in cut], [p["block"] for p in cut], first["digest"])
    except (ValueError, IndexError) as e:
        error = str(e)
    for _ in range(copies):
        yield _page(first["origin"]), first["target"], first["kind"], _page(first["refers"]), first["digest"], None if payload is None else len(payload), payload if payloads else None, error


def _wholes(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.small(batches, 256):
            rows = [row for parts in batch.column("parts").to_pylist() for row in _whole(parts, payloads)]
            if rows:
                yield _batch(rows, _WHOLES)

    return run


def read(spark: SparkSession, path: str, payloads: bool = True, own: bool = False) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload and error of each record in the archives.

    ``own``: the archives were written by write(), and are split and streamed.
    """
    if own:
        lines = spark.read.option("encoding", "ISO-8859-1").option("lineSep", MEMBER.decode("latin-1")).text(path)
        contents, parse = lines.where("value <> ''").select(F.col("value").cast("binary").alias("content")), _member_records
    else:
        contents, parse = spark.read.format("binaryFile").load(path).select("content"), parsed
    parts = contents.mapInArrow(_parts(parse, payloads), _PART)
    # Faults without an origin are not gathered in one group.
    origin = F.coalesce("origin", F.concat(F.lit("fault:"), F.monotonically_increasing_id().cast("string")))
    grouped = parts.withColumn("group", origin).groupBy("group").agg(F.collect_list(F.struct(*_PARTS.names)).alias("parts"))
    return grouped.select("parts").mapInArrow(_wholes(payloads), _WHOLE)


def round_trip(pages: DataFrame, least: int = LEAST, segment: int = SEGMENT, sent: int = SENT) -> DataFrame:
    """Write archives of ``pages``, read them back, and give revisits the size of what they refer to."""
    spark = pages.sparkSession
    path = f"{components.shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path, least, segment, sent)
    found = read(spark, path, payloads=False, own=True).select("page_id", "record_type", "refers_to", "payload_digest", "payload_bytes", "error").checkpoint()
    kept = found.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    revisits = found.where("record_type = 'revisit'").drop("payload_bytes").join(kept, ["refers_to", "payload_digest"], "left")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error"]
    return found.where("record_type is null or record_type <> 'revisit'").select(names).union(revisits.select(names))


ORACLE_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
k AS (SELECT d, max(page_id) AS kept FROM p WHERE n >= 1000 GROUP BY d)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN p.page_id < k.kept THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id < k.kept THEN k.kept END AS refers_to
FROM p LEFT JOIN k ON p.d = k.d AND p.n >= 1000
"""
