"""WARC archives: writing pages as records, reading them back with segment reassembly.

The writer stores each payload as an HTTP response with chunked transfer framing. A block of more than
`segment_bytes` is cut into a first record and continuation records (WARC-Segment-Number,
WARC-Segment-Origin-ID, WARC-Segment-Total-Length), so every record, and with `records_per_file` every archive
file, has a bounded size. Of records with equal payloads only the one with the largest page_id is a response;
the others are revisit records without a body. Files are written by Spark's own text writer (committed per
task, any file system) and read back with its binaryFile reader.

The reader parses records by their Content-Length. Records without segments are decoded at once; continuation
records are grouped by origin, ordered by segment number, checked against the total length and decoded.
A group is one payload. Archives whose bytes are gzip members are unpacked first. What doesn't hold together (a missing
or repeated segment, a wrong total, broken framing, another digest, a record without a length or cut off, bytes that
belong to no record, a broken gzip member) comes out as a row with valid = false and no payload, and reading goes on at
the next record, so that one bad archive stops no job.

Null and empty html are payloads of no bytes; a null url has no target; a null page_id is the response only if
no equal payload has an id; rows that repeat a page_id with an equal payload are all responses if that id is
the largest; payloads of any length are cut into segments; empty tables give an empty archive and result; other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.llm.common import materialize

BROADCAST_ROWS = 100_000
SALTS = 16
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def cut_points(data: bytes, size: int) -> list[int]:
    """Ends of pieces of at most `size` bytes that don't part a UTF-8 character."""
    out, at = [], 0
    while at < len(data):
        end = min(at + size, len(data))
        back = end
        while end < len(data) and back > at and back > end - 4 and data[back] & 0xC0 == 0x80:
            back -= 1
        at = back if back > at else end
        out.append(at)
    return out


def chunked(payload: bytes, size: int) -> bytes:
    """HTTP/1.1 chunked framing."""
    out, at = [], 0
    for end in cut_points(payload, size):
        out += [b"%x\r\n" % (end - at), payload[at:end], b"\r\n"]
        at = end
    out.append(b"0\r\n\r\n")
    return b"".join(out)


def unchunked(body: bytes) -> bytes | None:
    """The payload of a chunked body, with extensions and trailers allowed; None if the framing is broken."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            return None
        try:
            n = int(body[at:line].split(b";", 1)[0].strip() or b"?", 16)
        except ValueError:
            return None
        at = line + 2
        if n == 0:
            end = body.find(b"\r\n", at) if body[at : at + 2] == b"\r\n" else body.find(b"\r\n\r\n", at)
            return b"".join(out) if end >= 0 else None
        if n < 0 or body[at + n : at + n + 2] != b"\r\n":
            return None
        out.append(body[at : at + n])
        at += n + 2


def http_payload(block: bytes) -> bytes | None:
    """The payload of an HTTP response with or without chunked framing."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        return None
    framed = any(x.lower().startswith(b"transfer-encoding:") and b"chunked" in x.lower() for x in head.split(b"\r\n"))
    return unchunked(body) if framed else body


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {str(v).replace(chr(13), ' ').replace(chr(10), ' ')}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.1\r\n" + head.encode("utf-8", "surrogatepass") + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n"


def page_records(page_id, url: str | None, payload: bytes, refers_to, date: str, segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    """A page's records; the second line end after each is the writer's."""
    rid = f"<urn:uuid:{uuid.uuid4()}>"
    common = [("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Page-ID", page_id), ("WARC-Payload-Digest", "sha1:" + sha1_base32(payload))]
    kind = ("Content-Type", "application/http; msgtype=response")
    if refers_to is not None:
        profile = ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        block = HTTP + b"Content-Length: %d\r\n\r\n" % len(payload)
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", rid), *common, ("WARC-Refers-To-Page-ID", refers_to), profile, kind], block)
        return
    block = HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk_bytes)
    ends = cut_points(block, segment_bytes)
    if len(ends) == 1:
        yield record([("WARC-Type", "response"), ("WARC-Record-ID", rid), *common, kind], block)
        return
    at = 0
    for no, end in enumerate(ends, 1):
        total = ("WARC-Segment-Total-Length", len(block) if no == len(ends) else None)
        if no == 1:
            fields = [("WARC-Type", "response"), ("WARC-Record-ID", rid), *common, kind]
        else:
            fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("WARC-Segment-Origin-ID", rid)]
        yield record([*fields, ("WARC-Segment-Number", no), total], block[at:end])
        at = end


def write_archives(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", segment_bytes: int = 16_384, chunk_bytes: int = 4_096, records_per_file: int = 4_096) -> None:
    """Writes pages (page_id, url, html) as WARC files under path."""
    keyed = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    digest = F.struct(F.sha1("payload").alias("sha"), F.octet_length("payload").alias("n"))
    sums = pages.select("page_id", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload")).select("page_id", digest.alias("d"))
    copies = sums.groupBy("d").agg(F.max("page_id").alias("holder"), F.count("*").alias("n")).filter("n > 1").select("d", "holder")
    copies = materialize(copies, "copies")
    if copies.count() <= BROADCAST_ROWS:
        joined = keyed.withColumn("d", digest).join(F.broadcast(copies), "d", "left")
    else:  # the rows of a common payload go to several tasks
        salted = copies.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        joined = keyed.withColumn("d", digest).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["d", "salt"], "left")
    revisited = F.when(~F.col("holder").eqNullSafe(F.col("page_id")), F.col("holder"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 128):
                out = []
                for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in b.slice(at, 128).columns)):
                    out += page_records(page_id, url, payload, refers_to, date, segment_bytes, chunk_bytes)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    records = joined.select("page_id", "url", "payload", revisited.alias("refers_to")).mapInArrow(run, "value binary")
    records.select(F.col("value").cast("string")).write.option("lineSep", "\r\n").option("maxRecordsPerFile", records_per_file).text(path)


def whole_number(value: str | bytes | None) -> int | None:
    """The number that a field says, or None."""
    try:
        return int(value)
    except (TypeError, ValueError):
        return None


def unpacked(data: bytes) -> tuple[list[bytes], bool]:
    """The bytes of an archive, out of its gzip members if it has them, and whether all could be unpacked.

    A damaged member ends a piece, with what came out of it; the next begins at the next member that holds records.
    """
    if data[:2] != b"\x1f\x8b":
        return [data], True
    pieces, out, at, sound = [], [], 0, True
    while 0 <= at < len(data):
        member, begin, got = zlib.decompressobj(wbits=31), at, []
        try:
            while not member.eof and at < len(data):
                piece = data[at : at + 65_536]
                got.append(member.decompress(piece))
                at += len(piece) - len(member.unused_data)
        except zlib.error:
            pass
        if member.eof:
            out += got
            while data[at : at + 1] == b"\0":
                at += 1
            continue
        if sound or b"".join(got).startswith(b"WARC/"):  # else the bytes looked like a member by chance
            out += got
        sound = False
        if out:
            pieces.append(b"".join(out))
            out = []
        at = data.find(b"\x1f\x8b\x08", begin + 1)
    if out:
        pieces.append(b"".join(out))
    return pieces, sound


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(fields with lower-case names, block) of each record of an archive; block None for what is no whole record."""
    at = 0
    while True:
        while data[at : at + 2] == b"\r\n":
            at += 2
        if at >= len(data):
            return
        end = data.find(b"\r\n\r\n", at)
        fields: dict[str, str] = {}
        if data[at : at + 5] == b"WARC/":
            for line in data[at : end if end >= 0 else len(data)].split(b"\r\n")[1:]:
                name, _, value = line.partition(b":")
                fields[name.strip().lower().decode("ascii", "replace")] = value.strip().decode("utf-8", "replace")
        size = whole_number(fields.get("content-length"))
        if end >= 0 and size is not None and 0 <= size <= len(data) - end - 4:
            at = end + 4 + size
            yield fields, data[at - size : at]
            continue
        yield fields, None
        following = data.find(b"\r\nWARC/", at + 1)
        if following < 0:
            return
        at = following


RESULT = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, valid boolean, payload binary"
NAMES = [x.split()[0] for x in RESULT.split(", ")]
TYPES = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]


def decoded(fields: dict[str, str], block: bytes | None, keep: bool) -> list:
    """A result row from a whole record; block None: the segments don't hold together."""
    told = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    kind, url, page = fields.get("warc-type"), fields.get("warc-target-uri"), whole_number(fields.get("warc-page-id"))
    if kind == "revisit" and block is not None:
        heads = dict(x.split(b": ", 1) for x in block.split(b"\r\n") if b": " in x)
        return [page, url, kind, whole_number(fields.get("warc-refers-to-page-id")), whole_number(heads.get(b"Content-Length", b"0")), told, True, None]
    payload = None if block is None else http_payload(block)
    if payload is None or (told and sha1_base32(payload) != told):
        return [page, url, kind, None, None, told, False, None]
    return [page, url, kind, None, len(payload), sha1_base32(payload), True, payload if keep else None]


def read_archives(spark: SparkSession, path: str, keep_payload: bool = False, pattern: str = "part-*") -> DataFrame:
    """One row per response or revisit record, and per broken piece, of the files under path that match the pattern: page_id, url, record_type, refers_to, payload_bytes, payload_digest, valid, payload."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([*zip(NAMES, TYPES), ("origin", pa.string()), ("no", pa.int32()), ("total", pa.int64()), ("fields", pa.map_(pa.string(), pa.string())), ("block", pa.binary())])

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kind.types)], schema=kind)

        for b in batches:
            for content in b.column(0):
                pieces, sound = unpacked(content.as_py())
                rows, held = [] if sound else [[*decoded({}, None, False), None, None, None, None, None]], 0
                for fields, block in chain.from_iterable(map(parse_records, pieces)):
                    number = whole_number(fields.get("warc-segment-number"))
                    if block is None or ("warc-segment-number" in fields and number is None):
                        rows.append([*decoded(fields, None, False), None, None, None, None, None])
                    elif number is not None:
                        origin = fields.get("warc-segment-origin-id") or fields.get("warc-record-id")
                        rows.append([None] * len(NAMES) + [origin, number, whole_number(fields.get("warc-segment-total-length")), list(fields.items()), block])
                        held += len(block)
                    elif fields.get("warc-type") in ("response", "revisit"):
                        rows.append([*decoded(fields, block, keep_payload), None, None, None, None, None])
                        held += len(block) if keep_payload else 100
                    if held > 4_000_000:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 16):
                rows = []
                for parts in b.slice(at, 16).column(0).to_pylist():
                    fields = dict(parts[0]["fields"])
                    total = [p["total"] for p in parts if p["total"] is not None]
                    block = b"".join(p["block"] for p in parts)
                    whole = [p["no"] for p in parts] == list(range(1, len(parts) + 1)) and total == [len(block)]
                    rows.append(decoded(fields, block if whole else None, keep_payload))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TYPES)], NAMES)

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).filter("length > 0").select("content")
    parsed = materialize(files.mapInArrow(parse, RESULT + ", origin string, no int, total bigint, fields map<string,string>, block binary"), "records")
    whole = parsed.filter("no IS NULL").select(*NAMES)
    parts = parsed.filter("no IS NOT NULL").select("origin", F.struct("no", "total", "fields", "block").alias("part"))
    ordered = F.array_sort(F.collect_list("part"), lambda a, b: a["no"] - b["no"])  # the segments of one payload
    groups = parts.groupBy("origin").agg(ordered.alias("parts")).select("parts")
    return whole.unionByName(groups.mapInArrow(assemble, RESULT))
