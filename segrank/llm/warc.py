"""WARC archives: writing with segmentation and revisits, reading with segment reassembly.

Writing: a record a page; the HTTP block is framed in chunks and cut into segments where it is longer than
``segment_bytes``; of equal payloads the page with the smallest id is the response and the others are revisits.
Archives are written by Spark's text writer, whose separator is the two line ends that close a record.

Reading: every file is parsed by its Content-Length fields.  Records that were not segmented are decoded at once;
continuation records are grouped by the origin's identifier, ordered by segment number, and joined only if the
numbers are complete and the total length is right; then the chunked framing is taken off and the digest verified.

Defined cases: a null html is an empty payload; a null url gives no target field; rows that repeat a page_id are
records of their own (identifiers carry a row number), and those with the response's id and payload are all response;
a null page_id is the smallest only where a payload has no other; an empty table gives an empty folder and result;
a damaged record raises; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segrank.llm.common import bounded_batches, read_table, scratch, stored

SEGMENT_BYTES = 32 << 10
CHUNK = 8 << 10
RECORDS_IN_FILE = 4096
END = b"\r\n\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
RESULT = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
          "url string, payload string")


def cuts(data: bytes, step: int) -> list[bytes]:
    """``data`` in pieces of about ``step`` bytes, never cut inside a UTF-8 character."""
    out, at = [], 0
    while at < len(data):
        to = min(at + step, len(data))
        while to < len(data) and data[to] & 0xC0 == 0x80:
            to += 1
        out.append(data[at:to])
        at = to
    return out or [b""]


def chunked(payload: bytes) -> bytes:
    return b"".join(b"%x\r\n%s\r\n" % (len(c), c) for c in cuts(payload, CHUNK) if c) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        n = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if not n:
            return b"".join(out)
        if body[at + n:at + n + 2] != b"\r\n":
            raise ValueError("broken chunk")
        out.append(body[at:at + n])
        at += n + 2


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def records(page_id: int | None, row_no: int, url: str | None, payload: bytes, refers_to: int | None,
            revisit: bool, segment_bytes: int) -> Iterator[bytes]:
    """The WARC records of a page, without the closing line ends."""
    own = f"<urn:page:{'' if page_id is None else page_id}#{row_no}"
    fields = [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        fields.insert(0, "WARC-Target-URI: " + re.sub(r"[\x00-\x1f]", "", url))
    if revisit:
        block = HTTP + b"Content-Length: %d\r\n\r\n" % len(payload)
        fields += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                   f"WARC-Refers-To: <urn:page:{refers_to}>"]
    else:
        block = HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = cuts(block, segment_bytes)
    for k, part in enumerate(parts, 1):
        head = ["WARC/1.1", f"WARC-Type: {'continuation' if k > 1 else 'revisit' if revisit else 'response'}",
                f"WARC-Record-ID: {own}{f'/{k}' if k > 1 else ''}>", "WARC-Date: 1970-01-01T00:00:00Z"]
        if k == 1:
            head += fields
        if len(parts) > 1:
            head.append(f"WARC-Segment-Number: {k}")
            if k > 1:
                head.append(f"WARC-Segment-Origin-ID: {own}>")
            if k == len(parts):
                head.append(f"WARC-Segment-Total-Length: {len(block)}")
        head.append(f"Content-Length: {len(part)}")
        yield "\r\n".join(head).encode() + END + part


def write_warc(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, least_revisit: int = 0) -> None:
    """Writes ``pages`` (page_id, url, html) as gzip-compressed archives; payloads from ``least_revisit`` bytes on are
    written once.  Only payloads that occur more than once enter the join's other side."""
    spark = pages.sparkSession
    bounded_batches(spark)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html"), F.lit("")).alias("html")).withColumn("sha", F.sha1(F.col("html").cast("binary")))
    groups = stored(rows.where(F.octet_length("html") >= least_revisit).groupBy("sha")
                    .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
                    .select("sha", "first_id"), "payloads")
    joined = rows.join(groups, "sha", "left").select(
        "page_id", "url", "html", "first_id",
        (F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))).alias("revisit"),
        F.monotonically_increasing_id().alias("row_no"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, size = [], 0
            for r in b.to_pylist():
                for x in records(r["page_id"], r["row_no"], r["url"], r["html"].encode(), r["first_id"], r["revisit"], segment_bytes):
                    out.append(x.decode())
                    size += len(x)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    (joined.mapInArrow(run, "value string").write.option("lineSep", END.decode()).option("compression", "gzip")
     .option("maxRecordsPerFile", RECORDS_IN_FILE).text(path))


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record."""
    at = 0
    while at < len(data):
        to = data.index(END, at)
        lines = data[at:to].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record where one should start")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(head["content-length"])
        at = to + 4 + n
        if data[at:at + 4] != END:
            raise ValueError("a record's length is wrong")
        yield head, data[to + 4:at]
        at += 4


def page_of(identifier: str) -> int | None:
    own = identifier.removeprefix("<urn:page:").rstrip(">").split("#")[0]
    return int(own) if own else None


def decoded(head: dict[str, str], block: bytes) -> dict:
    """The result row of a whole record."""
    http, _, body = block.partition(END)
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode().split("\r\n")[1:])}
    row = {"page_id": page_of(head["warc-record-id"]), "record_type": head["warc-type"], "refers_to": None,
           "url": head.get("warc-target-uri"), "payload": None,
           "payload_digest": head["warc-payload-digest"].removeprefix("sha1:")}
    if head["warc-type"] == "revisit":
        return row | {"refers_to": page_of(head["warc-refers-to"]), "payload_bytes": int(fields["content-length"])}
    payload = unchunked(body) if fields.get("transfer-encoding") == "chunked" else body
    if digest(payload) != row["payload_digest"]:
        raise ValueError(f"payload digest of {head['warc-record-id']} is wrong")
    return row | {"payload_bytes": len(payload), "payload": payload.decode()}


SCHEMA = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                    ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.string())])
FIELDS = ["warc-type", "warc-record-id", "warc-target-uri", "warc-payload-digest", "warc-refers-to"]


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Pages of the archives under ``path``: plain records at once, segmented ones after reassembly."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    files = spark.read.format("binaryFile").schema(
        "path string, modificationTime timestamp, length long, content binary").load(path).select("content")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, bytes]]:
        for b in batches:
            for data in b.column("content").to_pylist():
                yield from parse(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for head, block in blocks(batches):
            if "warc-segment-number" not in head and head.get("warc-type") in ("response", "revisit"):
                row = decoded(head, block)
                rows.append(row if payloads else row | {"payload": None})
                size += len(block)
            if size > 8 << 20:
                yield pa.RecordBatch.from_pylist(rows, SCHEMA)
                rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, SCHEMA)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, block in blocks(batches):
            if "warc-segment-number" in head:
                yield pa.RecordBatch.from_pylist([{
                    "origin": head.get("warc-segment-origin-id", head["warc-record-id"]),
                    "number": int(head["warc-segment-number"]), "total": int(head.get("warc-segment-total-length", -1)),
                    "head": [head.get(f) for f in FIELDS], "block": block}],
                    pa.schema([("origin", pa.string()), ("number", pa.int64()), ("total", pa.int64()),
                               ("head", pa.list_(pa.string())), ("block", pa.binary())]))

    def reassemble(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["number"])
        block = b"".join(r["block"] for r in rows)
        if [r["number"] for r in rows] != list(range(1, len(rows) + 1)) or rows[-1]["total"] != len(block):
            raise ValueError(f"segments of {rows[0]['origin']} are missing, doubled or of wrong length")
        row = decoded({f: v for f, v in zip(FIELDS, rows[0]["head"]) if v is not None}, block)
        return pa.Table.from_pylist([row if payloads else row | {"payload": None}], SCHEMA)

    whole = files.mapInArrow(plain, RESULT)
    cut = (files.mapInArrow(segments, "origin string, number long, total long, head array<string>, block binary")
           .groupBy("origin").applyInArrow(reassemble, RESULT))
    return whole.unionByName(cut)


def op5_warc(spark, sf_dir: str) -> DataFrame:
    """Every page written, then read back from the archives."""
    path = scratch(spark, "warc")
    write_warc(read_table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
