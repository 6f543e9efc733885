"""WARC archives: a writer with payload revisits, and a reader that salvages what damaged archives still hold.

Writing: payload digests are grouped (map-side combined minima) so that of equal payloads of at least ``least`` bytes the one with the
smallest page_id is the response and the others revisit it. Tasks turn records into archive files of bounded size, each record a gzip
member of its own; the files are written by Spark's own writer, so any store works that Spark can write.

Reading: a file is read member by member. A record must start with a version line, hold as many bytes as its Content-Length says and
match its digests: that of the block, else that of the payload, which of an HTTP message is what follows the headers. After a failed
check the reader searches for the next place where a member or a version line is valid, goes on from there and logs the bytes between
as a gap. The same search runs in what a member holds; of a member that breaks off or fails its CRC the records before and after the
damage stay, with a note.

Defined cases: a null html is an empty payload; a null url gives no target; repeated rows give a record each, and those of equal
page_id and payload are all responses; an empty table gives an empty archive; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, store, task

#: Archive files are closed at about so many bytes.
ARCHIVE_BYTES = 8 << 20
VERSION = b"WARC/1.1\r\n"
_MAGIC = b"\x1f\x8b\x08"
READ_SCHEMA = "kind string, archive string, start long, length long, page_id long, record_type string, target string, payload_digest string, refers_to long, payload binary, note string"
_LINE = re.compile(rb"WARC/1\.[01]\r\n")
_HTTP = re.compile(rb"HTTP/\d|[A-Z]+ [^\r\n]* HTTP/\d")
_CHUNK = re.compile(rb"([0-9A-Fa-f]{1,15})[^\r\n]*\r\n")
#: May stand between records.
_PADDING = b"\x00\r\n"
_FIELD = re.compile(rb"([!-9;-~]+):[ \t]*([^\r\n]*)\r\n")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to=None) -> bytes:
    """One WARC record; refers_to makes it a revisit, which has the payload's digest and length but not its bytes."""
    head = [b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"), b"WARC-Record-ID: <urn:page:%s>" % str(page_id).encode()]
    if url is not None:
        head.append(b"WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url).encode())
    head.append(b"WARC-Payload-Digest: sha1:" + digest(payload).encode())
    if refers_to is not None:
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: <urn:page:%d>" % refers_to, b"X-Payload-Bytes: %d" % len(payload)]
        payload = b""
    head.append(b"Content-Length: %d" % len(payload))
    return VERSION + b"\r\n".join(head) + b"\r\n\r\n" + payload + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def write_archives(pages: DataFrame, path: str, least: int = 0) -> None:
    """Write a record for each row of pages (page_id, url, html) into .warc.gz files under path."""
    own = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    sums = own.select("page_id", F.sha1(F.encode("html", "utf-8")).alias("sha"), F.octet_length("html").alias("n")).filter(F.col("n") >= least)
    first = store(sums.groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count("*").alias("k")).filter("k > 1").drop("k"), "first")
    again = sums.join(first, "sha").filter("page_id <> first_id").select(F.col("page_id").alias("again_id"), F.struct("sha", "first_id").alias("ref"))
    again = again.distinct().groupBy("again_id").agg(F.map_from_entries(F.collect_set("ref")).alias("refs"))  # page_id may repeat with other payloads
    joined = own.join(again, own.page_id == again.again_id, "left").select("page_id", "url", "html", F.element_at("refs", F.sha1(F.encode("html", "utf-8"))).alias("refers_to"))

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                held.append(member(record(row[0], row[1], row[2].encode("utf-8", "surrogatepass"), row[3])))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["archive"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["archive"])

    # the text writer puts a string's bytes as they are; one archive to a file, then one byte of padding, which gzip readers skip
    files = joined.mapInArrow(run, "archive binary").select(F.col("archive").cast("string").alias("value"))
    files.write.option("maxRecordsPerFile", 1).option("lineSep", "\x00").text(path)


def _matches(said: str, content: bytes) -> bool:
    """Whether a labelled digest, in hexadecimal, base32 or base64, is that of content; unknown algorithms say nothing."""
    label, colon, value = said.partition(":")
    name = label.strip().lower().replace("-", "")
    if not colon or name not in ("md5", "sha1", "sha256", "sha512"):
        return True
    raw, value = hashlib.new(name, content).digest(), value.strip().rstrip("=")
    return value.lower() in (raw.hex(), base64.b32encode(raw).decode().rstrip("=").lower()) or value in (base64.b64encode(raw).decode().rstrip("="), base64.urlsafe_b64encode(raw).decode().rstrip("="))


def _unchunk(body: bytes) -> bytes | None:
    """The body without its chunked transfer coding, or None."""
    out, at = [], 0
    while m := _CHUNK.match(body, at):
        n = int(m[1], 16)
        if not n:
            return b"".join(out)
        out.append(body[m.end() : m.end() + n])
        at = m.end() + n
        if body[at : at + 2] != b"\r\n":
            return None
        at += 2
    return None


def _payloads(content: bytes) -> Iterator[bytes]:
    """What a payload digest may be of: the block, and of an HTTP message the bytes after the headers, as sent or without chunks."""
    yield content
    if _HTTP.match(content):
        head, blank, body = content.partition(b"\r\n\r\n")
        if blank:
            yield body
            if b"chunked" in head.lower() and (plain := _unchunk(body)) is not None:
                yield plain


def _intact(fields: dict[str, str], content: bytes) -> bool:
    if said := fields.get("warc-block-digest"):
        return _matches(said, content)
    said = fields.get("warc-payload-digest")
    if not said or fields.get("warc-type") == "revisit" or "warc-segment-number" in fields:  # of another record's bytes, or of all segments
        return True
    return any(_matches(said, x) for x in _payloads(content))


def parse_record(raw: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int] | None:
    """Fields, content and end of the valid record at a place of raw, or None."""
    m = _LINE.match(raw, at)
    if not m:
        return None
    at, fields = m.end(), {}
    while f := _FIELD.match(raw, at):
        fields[f[1].decode("ascii").lower()] = f[2].decode("utf-8", "replace")
        at = f.end()
    if raw[at : at + 2] != b"\r\n" or not fields.get("content-length", "").isdigit():
        return None
    at += 2
    end = at + int(fields["content-length"])
    if raw[end : end + 4] != b"\r\n\r\n":
        return None
    content = raw[at:end]
    return (fields, content, end + 4) if _intact(fields, content) else None


def _inflate(data: bytes, at: int, limit: int | None = None) -> tuple[bytes, int, bool]:
    """What the gzip member at a place holds (at least its first ``limit`` bytes), where the input read ends and whether the member is
    whole. It is fed in steps, so that what follows isn't copied; a step that fails or passes the limit is fed again byte by byte."""
    z, out, size, step = zlib.decompressobj(31), [], 0, 1 << 16
    while at < len(data) and not z.eof and (limit is None or size < limit):
        before = z.copy()
        try:
            got = z.decompress(data[at : at + step])
            again = step > 1 and limit is not None and size + len(got) >= limit
        except zlib.error:
            if step == 1:
                break
            again = True
        if again:
            z, step = before, 1
            continue
        out.append(got)
        size += len(got)
        at += step
    return b"".join(out), min(at, len(data)) - len(z.unused_data), z.eof


def _records(raw: bytes) -> Iterator[tuple[int, int, dict | None, bytes]]:
    """(from, to, fields, content) of the valid records of an inflated member; fields None for what lies between."""
    at, n, hole = 0, len(raw), -1
    while at < n:
        one = parse_record(raw, at)
        if one:
            if hole >= 0:
                yield hole, at, None, b""
            hole = -1
            yield at, one[2], one[0], one[1]
            at = one[2]
        elif hole < 0 and raw[at] in _PADDING:
            at += 1
        else:
            hole = at if hole < 0 else hole
            at = raw.find(b"WARC/1.", at + 1)
            at = n if at < 0 else at
    if hole >= 0:
        yield hole, n, None, b""


def salvage(data: bytes) -> Iterator[tuple[int, int, dict | None, bytes, str]]:
    """(start, length, fields, content, note) of each record of an archive; fields None for a quarantined gap. Records and gaps inside
    a member have the member's place; a gap's note has its own."""
    at, n = 0, len(data)
    gap = -1
    found_at = {_MAGIC: -1, b"WARC/1.": -1}  # where each mark is found next, so that no part is searched twice

    def ahead(after: int) -> int:
        for mark, place in found_at.items():
            if place < after:
                place = data.find(mark, after)
                found_at[mark] = n if place < 0 else place
        return min(found_at.values())

    def close(end: int):
        if gap >= 0 and end > gap:
            yield gap, end - gap, None, b"", "no valid member or version line"

    while at < n:
        if data.startswith(_MAGIC, at):
            raw, end, whole = _inflate(data, at)
            found = list(_records(raw))
            last = max((to for _, to, fields, _ in found if fields is not None), default=0)
            if last:
                yield from close(at)
                gap = -1
                if not whole:  # what follows the last valid record is searched again, and is a gap of the file
                    end = _inflate(data, at, last)[1]
                for start, to, fields, content in found:
                    if fields is not None:
                        yield at, end - at, fields, content, "" if whole else "its member is damaged"
                    elif whole or to <= last:
                        yield at, end - at, None, b"", f"no valid record in bytes {start} to {to} of the member"
                at = end
                if whole:
                    continue
                gap = at
                at -= 1  # a member may start right here
        elif data.startswith(b"WARC/1.", at):
            one = parse_record(data, at)
            if one:
                yield from close(at)
                gap = -1
                yield at, one[2] - at, one[0], one[1], ""
                at = one[2]
                continue
        if gap < 0 and data[at] in _PADDING:  # between records
            at += 1
            continue
        if gap < 0:
            gap = at
        at = ahead(at + 1)
    yield from close(n)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """READ_SCHEMA rows: kind ``record`` or ``gap`` (with start and length of the bytes left out)."""

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows: list[tuple] = []
                size = 0
                for start, length, fields, content, note in salvage(data.as_py()):
                    if fields is None:
                        rows.append(("gap", name, start, length, None, None, None, None, None, None, note))
                    else:
                        ids = [re.fullmatch(r"<urn:page:(-?\d+)>", fields.get(k, "")) for k in ("warc-record-id", "warc-refers-to")]
                        size += len(content)
                        fact = (fields.get("warc-type"), fields.get("warc-target-uri"), fields.get("warc-payload-digest", "").removeprefix("sha1:"))
                        rows.append(("record", name, start, length, ids[0] and int(ids[0][1]), *fact, ids[1] and int(ids[1][1]), content, fields.get("x-payload-bytes") or note or None))
                    if size > 4 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(run, READ_SCHEMA)


_TYPES = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()]
_NAMES = [x.split()[0] for x in READ_SCHEMA.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write pages to archives, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to, archive, start."""
    spark = pages.sparkSession
    path = shared_dir(spark, "warc")
    write_archives(pages, path, least)
    got = read_archives(spark, path).filter("kind = 'record'")
    size = F.when(F.col("record_type") == "revisit", F.col("note").cast("long")).otherwise(F.octet_length("payload").cast("long"))
    return got.select("page_id", size.alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


#: Bare upper-case base32 of SHA-1 in SQL: 32 groups of five bits.
def oracle(least: int = 0) -> str:
    bits = "".join(f" || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ('0b' || substr(bits, {1 + 5 * i}, 5))::INT, 1)" for i in range(32)).removeprefix(" || ")
    nibbles = "".join(f" || list_extract(['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'], 1 + instr('0123456789abcdef', substr(sha, {i}, 1))::INT - 1)" for i in range(1, 41)).removeprefix(" || ")
    return f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
s AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS sha FROM p),
b AS (SELECT *, {nibbles} AS bits, min(page_id) OVER (PARTITION BY sha) AS first_id FROM s)
SELECT page_id, payload_bytes, {bits} AS payload_digest,
CASE WHEN payload_bytes >= {least} AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN payload_bytes >= {least} AND page_id <> first_id THEN first_id END AS refers_to FROM b"""
