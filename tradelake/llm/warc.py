"""WARC archives: writing with segmentation and revisits, reading with reassembly of segments.

A record's block is an HTTP message. Payloads over CHUNK_OVER bytes are sent in chunked transfer framing, and blocks
over SEGMENT bytes are split into a first record and continuation records, as the format has it. Archives are
written by Spark's text writer, one record a row, with the two empty lines that end a record as the line separator.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach_by_key, materialise, scratch_path

#: Least payload that a later record refers back to; largest block of a record; payload size from which it is chunked,
#: and the chunks; records in a file (so a file has at most RECORDS * (SEGMENT + headers) bytes).
REVISIT_FROM, SEGMENT, CHUNK_OVER, CHUNK, RECORDS = 1000, 32_768, 4096, 4096, 1000
#: The format's version line, line end, and end of a record.
VERSION, EOL, END = b"WARC/1.1", b"\r\n", b"\r\n\r\n"
#: The pages have no date of their own.
DATE = "1970-01-01T00:00:00Z"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing: size in hex, chunk, and a chunk of size zero at the end."""
    parts = [b"%x\r\n%b\r\n" % (len(payload[i : i + size]), payload[i : i + size]) for i in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of chunked framing; raises ValueError if it is cut short."""
    out, at = [], 0
    while True:
        line = body.index(EOL, at)
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if size == 0:
            return b"".join(out)
        if len(body) < at + size + 2 or body[at + size : at + size + 2] != EOL:
            raise ValueError("a chunk is cut short")
        out.append(body[at : at + size])
        at += size + 2


def _header(fields: list[tuple[str, object]]) -> bytes:
    # a line end inside a value (a URL may hold one) would end the header
    lines = [f"{k}: {str(v).replace(chr(13), ' ').replace(chr(10), ' ')}".encode() for k, v in fields if v is not None]
    return EOL.join([VERSION, *lines]) + END


def _named(page_id: object) -> str | None:
    """An id as a header value."""
    return None if page_id is None else quote(str(page_id))


def records(page_id: object, url: str | None, payload: bytes, refers_to: object, refers_to_url: str | None, revisit: bool) -> Iterator[bytes]:
    """The record of a page, then its continuation records; without the two line ends after each."""
    digest = "sha1:" + hashlib.sha1(payload).hexdigest()
    long = not revisit and len(payload) > CHUNK_OVER
    head = [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Transfer-Encoding: chunked" if long else b"Content-Length: %d" % len(payload)]
    block = EOL.join(head) + END + (b"" if revisit else chunked(payload) if long else payload)
    name = f"<urn:uuid:{uuid.uuid4()}>"
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name), ("WARC-Target-URI", url), ("WARC-Date", DATE), ("X-Page-ID", _named(page_id)), ("X-Refers-To-Page-ID", _named(refers_to)), ("WARC-Payload-Digest", digest), ("Content-Type", "application/http; msgtype=response")]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Target-URI", refers_to_url), ("WARC-Refers-To-Date", DATE)]
    parts = [block[i : i + SEGMENT] for i in range(0, len(block), SEGMENT)] or [b""]
    if len(parts) > 1:
        fields.append(("WARC-Segment-Number", 1))
    yield _header([*fields, ("Content-Length", len(parts[0]))]) + parts[0]
    for k, part in enumerate(parts[1:], 2):
        last = [("WARC-Segment-Total-Length", len(block))] if k == len(parts) else []
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", k), *last]
        yield _header([*more, ("Content-Length", len(part))]) + part


def plan_revisits(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) as page_id, url, payload, refers_to, refers_to_url and revisit: of equal payloads of
    REVISIT_FROM bytes or more the page with the largest id is stored and the others refer to it.

    Smaller pages stay where they are. Of the others only digests are grouped, and they are combined before the shuffle; then
    each page looks its digest up, and pages with a very common digest are not shuffled for it."""
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    long = F.length("payload") >= REVISIT_FROM
    nothing = [F.lit(None).cast(pages.schema[c].dataType).alias(n) for c, n in (("page_id", "refers_to"), ("url", "refers_to_url"))]
    small = rows.where(~long).select("*", *nothing, F.lit(False).alias("revisit"))
    named = rows.where(long).withColumn("sha1", F.unhex(F.sha1("payload")))
    kept = named.groupBy("sha1").agg(F.max("page_id").alias("kept"), F.max_by("url", "page_id").alias("kept_url"), F.count("*").alias("n")).where("n > 1")
    found = attach_by_key(named, materialise(kept, "digests"), "sha1", "n")
    other = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    large = found.select("page_id", "url", "payload", F.when(other, F.col("kept")).alias("refers_to"), F.when(other, F.col("kept_url")).alias("refers_to_url"), other.alias("revisit"))
    return small.unionByName(large)


def write_archives(pages: DataFrame, path: str) -> None:
    """Write a record for every row of pages (page_id of any type, url, html) under path, compressed, in files of bounded size.
    A null html is an empty payload; null ids and URLs leave their header out; repeated rows make a record each. Long pages
    are cut into segments; other columns are ignored, whatever their names; an empty table makes no record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for record in records(*row):
                    out.append(record)
                    size += len(record)
                if size > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    made = plan_revisits(pages).mapInArrow(run, "record binary")
    made.select(F.col("record").cast("string").alias("value")).write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of every record of an archive."""
    at = 0
    while at < len(data):
        stop = data.index(END, at)
        lines = data[at:stop].split(EOL)
        if lines[0] != VERSION:
            raise ValueError("not at the start of a record")
        header = dict(line.decode().split(": ", 1) for line in lines[1:])
        begin = stop + 4
        end = begin + int(header["Content-Length"])
        if data[end : end + 4] != END:
            raise ValueError("a record is cut short")
        yield header, data[begin:end]
        at = end + 4


def read_segments(spark, path: str) -> DataFrame:
    """A row for every record under path: origin (of the record that it belongs to), number (null if the record is
    not continued), total (on a last continuation), kind, page_id and refers_to (as text), digest, block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        names = ["origin", "number", "total", "kind", "page_id", "refers_to", "digest", "block"]
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary()]
        number = lambda h, k: int(h[k]) if k in h else None
        name = lambda h, k: unquote(h[k]) if k in h else None
        for batch in batches:
            for content in batch.column(0):
                rows = [
                    (h.get("WARC-Segment-Origin-ID") or h["WARC-Record-ID"], number(h, "WARC-Segment-Number"), number(h, "WARC-Segment-Total-Length"), h["WARC-Type"], name(h, "X-Page-ID"), name(h, "X-Refers-To-Page-ID"), h.get("WARC-Payload-Digest"), block)
                    for h, block in parse(zlib.decompress(content.as_py(), 31))
                ]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(8)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, "origin string, number int, total long, kind string, page_id string, refers_to string, digest string, block binary")


def reassemble(segments: DataFrame) -> DataFrame:
    """page_id, record_type, refers_to, digest (bare hex), payload: the segments of each origin in the order of their
    numbers, with the total length verified, chunked framing decoded and the payload's digest verified. A revisit has
    no payload, but the length that its HTTP header states (payload_bytes). Raises if something doesn't agree.

    Only continued records are shuffled: those have a segment number in their headers."""
    one = segments.where("number is null").select("origin", F.array(F.struct(F.lit(1).alias("number"), "block", "total")).alias("parts"), "page_id", "refers_to", "digest", "kind")
    several = segments.where("number is not null").groupBy("origin").agg(F.sort_array(F.collect_list(F.struct("number", "block", "total"))).alias("parts"), *[F.max(c).alias(c) for c in ("page_id", "refers_to", "digest")], F.max(F.when(F.col("kind") != "continuation", F.col("kind"))).alias("kind"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                segs = row["parts"]
                if [s["number"] for s in segs] != list(range(1, len(segs) + 1)):
                    raise ValueError(f"segments are missing of {row['origin']}")
                block = b"".join(s["block"] for s in segs)
                if len(segs) > 1 and segs[-1]["total"] != len(block):
                    raise ValueError(f"the total length of {row['origin']} differs")
                head, _, body = block.partition(END)
                digest = row["digest"].removeprefix("sha1:")
                fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
                if row["kind"] == "revisit":
                    out.append((row["page_id"], "revisit", row["refers_to"], digest, int(fields["Content-Length"]), None))
                    continue
                payload = unchunked(body) if fields.get("Transfer-Encoding") == "chunked" else body
                if hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"the digest of {row['origin']} differs")
                out.append((row["page_id"], "response", None, digest, len(payload), payload))
            kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], ["page_id", "record_type", "refers_to", "digest", "payload_bytes", "payload"])

    return one.unionByName(several).mapInArrow(run, "page_id string, record_type string, refers_to string, digest string, payload_bytes long, payload binary")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages to archives in the shared scratch folder, read them back, and return reassemble()'s rows, one for each row of
    pages, with ids of their type. Odd rows fare as in write_archives()."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    kind = pages.schema["page_id"].dataType
    return reassemble(read_segments(pages.sparkSession, path)).withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})
