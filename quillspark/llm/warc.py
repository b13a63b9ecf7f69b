"""WARC archives: a writer on Spark's file sink and a salvage reader.

Writing: each record is built where its row is, and Spark's text sink stores the bytes, so any file
system that Spark writes to will do and a lost executor's files are committed once. Records are
gzip members; the sink's line separator is an empty member, which is a valid one. Without
compression a record's closing CR LF CR LF is the separator. An archive is as many records as fit
``file_bytes``, or one larger record.

Reading: an archive is walked record by record. Where a check fails (gzip CRC, version line,
headers, length, closing, block or payload digest) the reader looks for the next gzip member or
version line that passes, goes on from there, and logs the bytes between as a gap. A member's
unpacked bytes are walked in the same way, so it may hold any number of records, some of them
damaged. Of a member that is broken or cut off, what could be unpacked is walked too: whole records are
kept if a digest proves them, or if the member was merely cut off.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.text import columns_of
from quillspark.scratch import discard, materialize

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
EMPTY_MEMBER = gzip.compress(b"", mtime=0)
CLOSING = b"\r\n\r\n"
FIRST_LINE = re.compile(rb"WARC/1\.\d+\r\n")
CHUNK = 1 << 16
ROW_ID = "WARC-Source-Row"

FOUND = (
    "kind string, path string, start bigint, stop bigint, inner_start bigint, reason string, record_type string, row_id string, url string, "
    "payload_bytes bigint, payload_digest string, refers_to string, payload binary"
)


def build_record(row_id: object, url: str | None, payload: bytes, digest: str, refers_to: object, revisit: bool, date: str) -> bytes:
    """One record without its closing. Ids are written as text, quoted as in a URL."""
    row_id, refers_to = (None if x is None else quote(str(x), safe="") for x in (row_id, refers_to))
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{row_id}>", f"WARC-Date: {date}"]
    if row_id is not None:
        head.append(f"{ROW_ID}: {row_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    head.append(f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + CLOSING + block


class _Ahead:
    """Where a mark comes next in a buffer; asked for growing places, it looks at every byte once."""

    def __init__(self, buf: bytes, mark: bytes) -> None:
        self.buf, self.mark, self.found, self.since = buf, mark, -1, 0

    def next(self, at: int) -> int:
        """The first place of the mark from ``at`` on, or -1."""
        if not self.since <= at <= self.found and not (self.found == len(self.buf) and at >= self.since):
            self.found = self.buf.find(self.mark, at)
            self.found = len(self.buf) if self.found < 0 else self.found
        self.since = at
        return -1 if self.found == len(self.buf) else self.found


def _digests(block: bytes, said: str) -> tuple[bool, bool]:
    """Whether a labelled digest (``sha256:...``, hex or base32) can be checked, and whether it is right."""
    name, _, value = said.partition(":")
    name = name.lower().replace("-", "")
    if name not in ("sha1", "sha256", "sha512", "md5"):
        return False, True
    own = hashlib.new(name, block).digest()
    plain = base64.b32encode(own).decode()
    return True, value.lower() == own.hex() or value.upper().rstrip("=") == plain.rstrip("=")


def _headers(buf: bytes, at: int, stop: int) -> dict[str, str] | None:
    """Named fields between two places; a line that begins with white space goes on with the field before. None at the first line that is neither."""
    head: dict[str, str] = {}
    last = None
    while at < stop:
        end = buf.find(b"\r\n", at, stop)
        end = stop if end < 0 else end
        line, at = buf[at:end], end + 2
        if line[:1] in (b" ", b"\t") and last is not None:
            head[last] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        last = name.strip().lower().decode("latin-1")
        head[last] = value.strip().decode("utf-8", "replace")
    return head


def _parse(buf: bytes, at: int, closings: _Ahead) -> tuple[int, dict, bool] | str:
    """Where the record at ``at`` ends, its fields, and whether a digest proves it; or what is wrong with it."""
    head_end = closings.next(at)
    if head_end < 0:
        return "headers do not end"
    version = FIRST_LINE.match(buf, at, head_end + 2)
    if version is None:
        return "no version line"
    head = _headers(buf, version.end(), head_end)
    if head is None:
        return "broken header line"
    size = head.get("content-length", "")
    if not size.isdigit():
        return "no content length"
    start, stop = head_end + 4, head_end + 4 + int(size)
    if buf[stop : stop + 4] != CLOSING:
        return "record does not close where its length says"
    block = buf[start:stop]
    proved, right = _digests(block, head.get("warc-block-digest", ""))
    if not right:
        return "block digest differs"
    _, split, body = block.partition(CLOSING)
    if not (split and block.startswith(b"HTTP/")):
        body = block
    said = head.get("warc-payload-digest", "")
    kind = head.get("warc-type")
    if kind == "revisit":
        length = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", block)
        n = int(length[1]) if length else None
        digest = said[7:] if said.startswith("sha256:") else None
        body = None
    else:
        checked, right = _digests(body, said)
        if not right:
            return "payload digest differs"
        n, digest, proved = len(body), hashlib.sha256(body).hexdigest(), proved or checked
    refers = re.fullmatch(r"<urn:page:(.*)>", head.get("warc-refers-to", ""))
    row_id = head.get(ROW_ID.lower())
    return stop + 4, {
        "record_type": kind, "row_id": None if row_id is None else unquote(row_id), "url": head.get("warc-target-uri"),
        "payload_bytes": n, "payload_digest": digest, "refers_to": unquote(refers[1]) if refers else None, "payload": body,
    }, proved


def _member(buf: memoryview, at: int) -> tuple[int, bytes, str | None]:
    """Where the gzip member at ``at`` ends, what could be unpacked of it, and what is wrong with it."""
    unpack, out, pos = zlib.decompressobj(31), [], at
    try:
        while not unpack.eof:
            if pos >= len(buf):
                return pos, b"".join(out), "gzip member is cut off"
            out.append(unpack.decompress(buf[pos : pos + CHUNK]))
            pos = min(pos + CHUNK, len(buf))
    except zlib.error:
        return pos, b"".join(out), "gzip member is broken"
    return pos - len(unpack.unused_data), b"".join(out), None


def _walk(text: bytes, prove: bool) -> list[tuple]:
    """(record or gap, first byte, end, reason, fields) over plain bytes; with ``prove`` only records that a digest proves."""
    out: list[tuple] = []
    closings, versions = _Ahead(text, CLOSING), _Ahead(text, VERSION)
    pos, lost, reason = 0, None, None
    while pos < len(text):
        got = _parse(text, pos, closings) if text.startswith(VERSION, pos) else "no version line"
        if not isinstance(got, str) and prove and not got[2]:
            got = "no digest proves a record of a broken member"
        if isinstance(got, str):
            if lost is None:
                lost, reason = pos, got
            pos = versions.next(pos + 1)
            pos = len(text) if pos < 0 else pos
            continue
        if lost is not None:
            out.append(("gap", lost, pos, reason, {}))
            lost = None
        out.append(("record", pos, got[0], None, got[1]))
        pos = got[0]
    if lost is not None:
        out.append(("gap", lost, len(text), reason, {}))
    return out


def salvage(buf: bytes) -> Iterator[tuple[str, int, int, int | None, str | None, dict]]:
    """(record or gap, first byte, end, first byte inside a member, reason of a gap, fields of a record) over a whole archive, in order.

    Records and gaps cover the archive, but for empty members. What lies in one member shares its first byte and end;
    all else doesn't overlap.
    """
    view, pos, lost, reason = memoryview(buf), 0, None, None
    unpacked = False
    closings, versions, members = _Ahead(buf, CLOSING), _Ahead(buf, VERSION), _Ahead(buf, MAGIC)
    while pos < len(buf):
        inner: list[tuple] = []
        end, wrong = pos, None
        if buf.startswith(MAGIC, pos):
            end, text, wrong = _member(view, pos)
            inner = _walk(text, wrong == "gzip member is broken")
            if wrong is not None:
                records = [x for x in inner if x[0] == "record"]
                if records:
                    # What was read is told; the rest is a gap that ends where the next member or record begins.
                    if lost is not None:
                        yield "gap", lost, pos, None, reason, {}
                        lost = None
                    for kind, a, _, _, fields in records:
                        yield kind, pos, end, a, None, fields
                    unpacked = True  # so version lines that the packed bytes may show are of records already told
        elif buf.startswith(VERSION, pos):
            got = _parse(buf, pos, closings)
            if isinstance(got, str):
                wrong = got
            else:
                end, inner = got[0], [("record", None, None, None, got[1])]
        else:
            wrong = "no member or version line"
        if wrong is not None:
            if lost is None:
                lost, reason = pos, wrong
            ahead = [members.next(pos + 1), -1 if unpacked else versions.next(pos + 1)]
            pos = min((x for x in ahead if x >= 0), default=len(buf))
            continue
        unpacked = False
        if lost is not None:
            yield "gap", lost, pos, None, reason, {}
            lost = None
        for kind, a, _, why, fields in inner:
            yield kind, pos, end, a, why, fields
        pos = end
    if lost is not None:
        yield "gap", lost, len(buf), None, reason, {}


def write_warc(
    pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    min_revisit_bytes: int = 100, compress: bool = True, file_bytes: int = 32 << 20, date: str = "1970-01-01T00:00:00Z",
) -> None:
    """A record per row of ``pages`` under ``path``; equal payloads of ``min_revisit_bytes`` or more are stored once.

    Of those the smallest id is the response, the others are revisits that refer to it; rows that repeat the
    smallest id are responses too. A null payload is empty; a row without id among equal payloads is a
    revisit unless no row has an id. A null url is left out. Extra columns are ignored; an empty
    table writes no record. Ids may be of any type that has an order and a text form. Copies are found by
    SHA-256, pre-aggregated, so a payload that a third of the pages share costs a row per task.
    """
    columns_of(pages, [id_col, url_col, payload_col])
    p = pages.select(
        pages[id_col].alias("id"),
        pages[url_col].cast("string").alias("url"),
        F.encode(F.coalesce(pages[payload_col], F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    firsts = (
        p.where(F.length("payload") >= min_revisit_bytes)
        .groupBy("digest")
        .agg(F.min("id").alias("first"), F.count("*").alias("n"))
        .where("n > 1 AND first IS NOT NULL")
        .select(F.col("digest").alias("d"), "first")
    )
    firsts = materialize(firsts, "first-payloads")  # so that the join deals rows anew and can divide a payload that many have
    marked = p.join(firsts, p["digest"] == firsts["d"], "left").select("id", "url", "payload", "digest", "first")

    separator = EMPTY_MEMBER if compress else CLOSING

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0
        for batch in batches:
            for row_id, url, payload, digest, first in zip(*batch.columns, strict=True):
                row_id, first = row_id.as_py(), first.as_py()
                revisit = first is not None and row_id != first
                record = build_record(row_id, url.as_py(), payload.as_py(), digest.as_py(), first, revisit, date)
                record = gzip.compress(record + CLOSING, mtime=0) if compress else record
                if held and size + len(record) > file_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([(b"" if compress else CLOSING).join(held)], pa.binary())], names=["value"])
                    held, size = [], 0
                held.append(record)
                size += len(record) + len(separator)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([(b"" if compress else CLOSING).join(held)], pa.binary())], names=["value"])

    (
        marked.mapInArrow(run, "value binary")
        .select(F.col("value").cast("string").alias("value"))
        .write.option("lineSep", separator.decode("latin-1"))
        .option("encoding", "ISO-8859-1")
        .option("maxRecordsPerFile", 1)
        .text(path)
    )
    discard(firsts)


def read_warc(spark: SparkSession, path: str, *, payloads: bool = True) -> DataFrame:
    """Every record and every quarantined gap (kind ``record`` or ``gap``) of the archives under ``path``.

    start and stop are bytes of the archive, inner_start is the first byte inside an unpacked member; row_id and
    refers_to are text. Fields that a record does not have are null, as are all of a gap's but its reason. An
    archive without a byte gives no row. A task holds one archive at a time, unpacked member by member; an
    archive must be under 2 GB, which the writer's are unless one record is larger.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                rows: list[dict] = []
                held = 0
                for kind, start, stop, inner, reason, fields in salvage(content.as_py()):
                    row = {"kind": kind, "path": name.as_py(), "start": start, "stop": stop, "inner_start": inner, "reason": reason, **fields}
                    held += len(row.get("payload") or b"") if payloads else 0
                    if not payloads:
                        row["payload"] = None
                    rows.append(row)
                    if len(rows) >= 4096 or held > 1 << 24:
                        yield pa.RecordBatch.from_pylist(rows, schema=FOUND_ARROW)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=FOUND_ARROW)

    return files.mapInArrow(run, FOUND)


FOUND_ARROW = pa.schema([
    (name, {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[kind])
    for name, kind in (f.split() for f in FOUND.split(", "))
])
