"""WARC archives: write segmented, chunked records; read them back by segment reassembly.

Writing: one record a page. Of pages with equal payloads one is the response, the others revisit it. A
response's HTTP message is chunk-framed and, when long, split over a first record and continuation
records, so no record (and no archive file) outgrows a bound. Records are dealt to files by Spark's
text writer, whose line separator is WARC's record end: files are committed like any table's.

Reading: files are cut into records by their lengths; segments are grouped by the identifier of their
first record, ordered by number, checked against the stated total length, and joined; then the
chunk framing is decoded and the payload's digest verified.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrun.llm.common import fits_broadcast, shuffle_partitions, written

#: Payloads at least this long are written once.
MIN_REVISIT_BYTES = 1000
#: Bytes of a record's block, and of a chunk in it, at most (a chunk ends between characters).
SEGMENT_BYTES = 1 << 15
CHUNK_BYTES = 4096
#: Records in one file.
FILE_RECORDS = 1000
DATE = "2024-01-01T00:00:00Z"
END = "\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# --- writing ----------------------------------------------------------------------------------------


def plan_records(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``page_id, url, html, digest, refers_to, refers_url``: each page and the page that it revisits, if any."""
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    long = rows.where(F.octet_length("html") >= min_bytes)
    # A row for each payload that occurs again: partial counts, however many copies there are.
    again = long.groupBy("digest").agg(
        F.count(F.lit(1)).alias("n"), F.max("page_id").alias("owner"), F.max_by("url", "page_id").alias("owner_url")
    )
    again = written(again.where("n > 1").select(F.col("digest").alias("_d"), "owner", "owner_url"), "repeated-payloads")
    again = F.broadcast(again) if fits_broadcast(again) else again
    planned = rows.join(again, (rows.digest == again._d) & (F.octet_length("html") >= min_bytes), "left")
    other = ~F.col("page_id").eqNullSafe(F.col("owner")) & F.col("owner").isNotNull()
    return planned.select(
        "page_id",
        "url",
        "html",
        "digest",
        F.when(other, F.col("owner")).alias("refers_to"),
        F.when(other, F.col("owner_url")).alias("refers_url"),
    )


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing; a chunk ends before a character that it can't hold whole."""
    out, at = [], 0
    while at < len(payload):
        end = min(len(payload), at + size)
        while end < len(payload) and end > at + 1 and payload[end] & 0xC0 == 0x80:
            end -= 1
        out += [b"%x\r\n" % (end - at), payload[at:end], b"\r\n"]
        at = end
    return b"".join([*out, b"0\r\n\r\n"])


def header(fields: list[tuple[str, object]]) -> bytes:
    """Header lines; a line break in a value would end it, so blanks stand for them."""
    clean = [(k, " ".join(str(v).splitlines())) for k, v in fields if v is not None]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in clean) + "\r\n").encode("utf-8", "replace")


def page_records(row: dict, record_id: str, segment: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The records of one page, each without the two line ends that close it."""
    url = row["url"]
    common = [("WARC-Record-ID", record_id), ("WARC-Target-URI", url), ("WARC-Date", DATE)]
    common += [("WARC-Payload-Digest", f"sha1:{row['digest']}"), ("WARC-Page-ID", row["page_id"])]
    kind = ("Content-Type", "application/http;msgtype=response")
    if row["refers_to"] is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
        extra = [("WARC-Profile", REVISIT), ("WARC-Refers-To-Target-URI", row["refers_url"]), ("WARC-Refers-To-Date", DATE)]
        extra.append(("WARC-Refers-To-Page-ID", row["refers_to"]))
        yield header([("WARC-Type", "revisit"), *common, *extra, kind, ("Content-Length", len(block))]) + block
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    block += chunked(row["html"].encode("utf-8", "surrogatepass"))
    cuts = [0]
    while len(block) - cuts[-1] > segment:
        end = cuts[-1] + segment
        while block[end] & 0xC0 == 0x80:
            end -= 1
        cuts.append(end)
    parts = [block[s:e] for s, e in zip(cuts, [*cuts[1:], len(block)], strict=True)]
    first = [("WARC-Segment-Number", 1)] if len(parts) > 1 else []
    yield header([("WARC-Type", "response"), *common, kind, *first, ("Content-Length", len(parts[0]))]) + parts[0]
    for n, part in enumerate(parts[1:], 2):
        fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{record_id[:-1]}:{n}>"), ("WARC-Date", DATE)]
        fields += [("WARC-Segment-Origin-ID", record_id), ("WARC-Segment-Number", n)]
        if n == len(parts):
            fields.append(("WARC-Segment-Total-Length", len(block)))
        yield header([*fields, ("Content-Length", len(part))]) + part


def write_archives(planned: DataFrame, path: str, segment: int = SEGMENT_BYTES) -> None:
    """Write the records of ``plan_records`` as compressed archives into the folder ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for b in batches:
            for s in range(0, len(b), 256):
                out = []
                for row in b.slice(s, 256).to_pylist():
                    n += 1
                    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{row['page_id']}|{row['digest']}|{task}|{n}")
                    out += page_records(row, f"<urn:uuid:{name}>", segment)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    records = planned.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    options = {"lineSep": END, "compression": "gzip", "maxRecordsPerFile": FILE_RECORDS}
    records.write.options(**options).text(path)


# --- reading ----------------------------------------------------------------------------------------


def records_of(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of an archive; an incomplete last record is left out."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or data[at : at + 5] != b"WARC/":
            return
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(fields.get("content-length", 0))
        block = data[end + 4 : end + 4 + size]
        if len(block) < size:
            return
        yield fields, block
        at = end + 4 + size
        while data[at : at + 2] == b"\r\n":
            at += 2


def decode_http(block: bytes) -> bytes | None:
    """Payload of an HTTP message; chunk framing is undone. None if a chunk is cut short or misframed."""
    head, _, body = block.partition(b"\r\n\r\n")
    if b"transfer-encoding: chunked" not in head.lower():
        return body
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            return None
        if size == 0:
            return b"".join(out)
        if size < 0 or body[end + 2 + size : end + 4 + size] != b"\r\n":
            return None
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


_PARSED = (
    "origin string, number int, total bigint, type string, page_id string, url string, digest string, "
    "refers_to string, block binary"
)
_READ = "record_id string, type string, page_id string, url string, digest string, refers_to string, segments int, complete boolean, payload binary"


def parse_archives(spark: SparkSession, path: str) -> DataFrame:
    """``_PARSED``: a row for each record of the archives in ``path``. ``number`` is null for a record in one piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _PARSED.split(", ")]
        types = [pa.string(), pa.int32(), pa.int64(), *[pa.string()] * 5, pa.binary()]
        for b in batches:
            for data in b.column(0):
                data = data.as_py()
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                rows = []
                for f, block in records_of(data):
                    number, total = f.get("warc-segment-number"), f.get("warc-segment-total-length")
                    origin = f.get("warc-segment-origin-id") or f.get("warc-record-id")
                    digest = (f.get("warc-payload-digest") or "").removeprefix("sha1:")
                    rows.append(
                        (
                            origin,
                            int(number) if number else None,
                            int(total) if total else None,
                            f.get("warc-type"),
                            f.get("warc-page-id"),
                            f.get("warc-target-uri"),
                            digest,
                            f.get("warc-refers-to-page-id"),
                            block,
                        )
                    )
                    if len(rows) >= 256:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names
                        )
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names
                    )

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, _PARSED)


def _payload(segments: list[dict]) -> dict:
    """One message from its segments in order: complete if numbered 1, 2, ... and as long as the last one says."""
    first, last = segments[0], segments[-1]
    block = b"".join(s["block"] for s in segments)
    numbers = [s["number"] or 1 for s in segments]
    whole = numbers == list(range(1, len(segments) + 1))
    if len(segments) > 1 or first["number"] is not None:
        whole = whole and last["total"] == len(block)
    payload = decode_http(block) if whole and first["type"] != "revisit" else None
    if first["type"] != "revisit":
        whole = payload is not None and hashlib.sha1(payload).hexdigest() == first["digest"]
    return {
        "record_id": first["origin"],
        **{k: first[k] for k in ("type", "page_id", "url", "digest", "refers_to")},
        "segments": len(segments),
        "complete": whole,
        "payload": payload,
    }


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by origin and number; repeated segments (the same record read twice) count once."""
    strings = {"record_id", "type", "page_id", "url", "digest", "refers_to"}
    kinds = {"segments": pa.int32(), "complete": pa.bool_(), "payload": pa.binary()}
    schema = pa.schema([(n, pa.string() if n in strings else kinds[n]) for n in (x.split()[0] for x in _READ.split(", "))])
    group: list[dict] = []
    out: list[dict] = []
    for b in batches:
        for s in range(0, len(b), 64):
            for row in b.slice(s, 64).to_pylist():
                if group and row["origin"] != group[0]["origin"]:
                    out.append(_payload(group))
                    group = []
                if not group or row["number"] != group[-1]["number"]:
                    group.append(row)
            if len(out) >= 64:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
    if group:
        out.append(_payload(group))
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``_READ``: a row for each page record of the archives in ``path``, with its payload.

    Records in one piece are decoded where they are read; only segments are shuffled, by the
    identifier of their first record. ``complete`` is false, and the payload null, where a segment is missing, the total
    length or the digest differs, or the framing is broken. A revisit has no payload. Segments without a
    first record give a row of type continuation.
    """
    rows = parse_archives(spark, path)
    alone = rows.where("number is null").mapInArrow(_decoded, _READ)
    parts = rows.where("number is not null").repartition(shuffle_partitions(spark), "origin")
    joined = parts.sortWithinPartitions("origin", "number").mapInArrow(_decoded, _READ)
    return alone.unionByName(joined)


def round_trip(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write ``pages(page_id, url, html)`` to archives in ``path`` and return what reading them gives.

    Null html is an empty payload, a null url an empty one, a null page_id stays null (it refers to
    the largest of its equals, never the other way round unless all are null). Rows that repeat page_id and html tie: each
    is a response. Other columns are ignored; an empty table gives an empty archive and result.
    """
    write_archives(plan_records(pages, min_bytes), path)
    return read_archives(pages.sparkSession, path)
