"""WARC records: writing with segmentation, reading with segment reassembly.

Writing.  Each row is one record: a ``response`` (an HTTP message whose body
is the payload in chunked transfer framing) or, when its payload equals that
of another row of at least ``min_dedup_bytes``, a ``revisit`` that refers to
the row with the smallest id.  Blocks longer than ``segment_bytes`` are split
into a first record and ``continuation`` records, each carrying the origin's
identifier and a segment number, the last also the total length.  Spark's text
sink writes the files: the end of a record, two line ends, is its line
separator, so files are plain concatenated records, compressed by the sink's
codec and committed task by task.

Reading.  Files are read whole through Spark and parsed as a stream inside
the task; a file has about ``file_bytes`` of payload, or less where a task has less,
and at most ``WIDEST`` times as much (or one record), which bounds what a task holds.  Records that were split are grouped by the
identifier of their origin, ordered by segment number and checked against the
total length; then HTTP headers are taken off and the chunked framing is
decoded.  Only segments are shuffled, and a group is one payload.

Only narrow rows (id, digest) are grouped to find equal payloads, by a
partial aggregate, so a payload that a third of all rows share is no hot
group.  Rows that get a ``revisit`` record join on the id.

Edge cases: a null payload is empty, one of any length is segmented; other columns
than id, URL and payload are ignored, also under clashing names; a null id counts as the largest and its
record has no id of its own; repeated rows with the smallest id of a payload
are all responses; a missing segment, a wrong total or a broken frame gives a
row with ``status`` other than ``ok`` and a null payload, never a lost one; an
empty table writes no record and reads back empty.
"""
from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from typing import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, prepare

SEGMENT_BYTES = 1 << 16
CHUNK_BYTES = 1 << 13
FILE_BYTES = 128 << 20
RECORD_OVERHEAD = 700         # bytes of headers and framing of a record, about
WIDEST = 8
REVISITS = 100_000            # rows up to which the list of revisits is broadcast (about 100 bytes each)
END = "\r\n\r\n"
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_of(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [payload[i:i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """Payload of a body in chunked framing; raises ValueError if it is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("no chunk size")
        size = int(body[at:end].split(b";")[0].strip(), 16)
        if size < 0:
            raise ValueError("negative chunk size")
        at = end + 2
        if size == 0:
            break
        if body[at + size:at + size + 2] != b"\r\n":
            raise ValueError("chunk does not end where it says")
        out.append(body[at:at + size])
        at += size + 2
    while True:                                # trailer fields, then an empty line
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("no end of the chunks")
        if end == at:
            return b"".join(out)
        at = end + 2


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def _clean(value) -> str:
    """A header value: no line ends inside it."""
    return "".join(c if c not in "\r\n" else "%%%02X" % ord(c) for c in value or "")


def record_id(row_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(f'{row_id}|{digest}'.encode()).digest()[:16])}>"


def page_records(page_id, url, payload: bytes, revisit: bool, first_id, first_url, segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    digest = digest_of(payload)
    name = record_id(page_id, digest)
    head: list[tuple[str, str]] = [("WARC-Record-ID", name), ("WARC-Date", DATE), ("WARC-Target-URI", _clean(url)),
                                   ("WARC-Payload-Digest", digest)]
    if page_id is not None:
        head.append(("X-Row-ID", str(page_id)))
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    kind = ("Content-Type", "application/http; msgtype=response")
    if revisit:
        first = [("WARC-Refers-To", record_id(first_id, digest)), ("WARC-Refers-To-Target-URI", _clean(first_url)),
                 ("WARC-Refers-To-Date", DATE), ("WARC-Profile", PROFILE), ("X-Refers-To-Row-ID", str(first_id))]
        yield _record([("WARC-Type", "revisit"), *head, *first, kind], http + b"\r\n")
        return
    block = http + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk_bytes)
    if len(block) <= segment_bytes:
        yield _record([("WARC-Type", "response"), *head, kind], block)
        return
    cuts = range(0, len(block), segment_bytes)
    yield _record([("WARC-Type", "response"), *head, kind, ("WARC-Segment-Number", "1")], block[:segment_bytes])
    for i in cuts[1:]:
        number = i // segment_bytes + 1
        last = [("WARC-Segment-Total-Length", str(len(block)))] if i + segment_bytes >= len(block) else []
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(f"{page_id}#{number}", digest)),
                       ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", str(number)), *last],
                      block[i:i + segment_bytes])


def _payload(col: str) -> Column:
    return F.coalesce(F.encode(F.col(col), "UTF-8"), F.lit("").cast("binary"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   min_dedup_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES,
                   codec: str = "gzip", file_bytes: int = FILE_BYTES) -> None:
    """Write one record per row of ``pages`` (more where it is segmented) under ``path``."""
    spark = pages.sparkSession
    prepare(spark)
    src = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), _payload(payload_col).alias("payload"))
    rows = cut(src.select("id", "url", F.sha1("payload").alias("digest"), F.length("payload").alias("size"))
               .where(F.col("size") >= min_dedup_bytes))
    least = F.struct(F.col("id").isNull().alias("last"), "id", "url")
    groups = (rows.groupBy("digest").agg(F.min(least).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1")
              .select("digest", F.col("f.id").alias("first_id"), F.col("f.url").alias("first_url")))
    revisits = cut(rows.join(groups, "digest").where(~F.col("id").eqNullSafe(F.col("first_id")))
                   .select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("rid"), F.col("id").isNull().alias("rnull"),
                           "digest", "first_id", "first_url").distinct())
    # The list of revisits is broadcast up to a counted size; beyond it the join shuffles on the id.
    if revisits.limit(REVISITS + 1).count() <= REVISITS:
        revisits = F.broadcast(revisits)
    marked = src.withColumns({"rid": F.coalesce(F.col("id").cast("string"), F.lit("")), "rnull": F.col("id").isNull(),
                              "digest": F.sha1("payload")})
    marked = (marked.join(revisits.withColumn("again", F.lit(True)), ["rid", "rnull", "digest"], "left")
              .select("id", "url", "payload", "again", "first_id", "first_url"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for b in batches:
            held, size = [], 0
            for row in zip(*(c.to_pylist() if i != 2 else c for i, c in enumerate(b.columns))):
                page_id, url, payload, again, first_id, first_url = row
                for r in page_records(page_id, url, payload.as_py(), bool(again), first_id, first_url, segment_bytes, chunk_bytes):
                    held.append(r)
                    size += len(r)
                if size >= 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["value"])
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["value"])

    # Files end by their number of records: as many as make up a file on average, where these are small, but
    # no more than would make up WIDEST files if all were whole segments.
    sizes = src.agg(F.avg(F.least(F.length("payload"), F.lit(segment_bytes))).alias("mean")).first().mean or 0
    least = max(1, file_bytes // segment_bytes)
    per_file = min(max(least, int(file_bytes // (sizes + RECORD_OVERHEAD))), WIDEST * least)
    records = marked.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    records.write.mode("overwrite").option("lineSep", END).option("compression", codec) \
        .option("maxRecordsPerFile", per_file).text(path)


def _stream(raw: bytes) -> Iterator[bytes]:
    """Decompressed pieces of a file (gzip members one after the other, or plain)."""
    if raw[:2] != b"\x1f\x8b":
        yield raw
        return
    step = 1 << 20
    z, at, view = zlib.decompressobj(31), 0, memoryview(raw)
    while at < len(raw):
        data = view[at:at + step]
        at += len(data)
        while len(data):
            yield z.decompress(data)
            data = z.unused_data
            if data:
                z = zlib.decompressobj(31)
    yield z.flush()


def parse_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """``(headers with lower-case names, block)`` of concatenated records."""
    buffer = bytearray()
    pieces = iter(pieces)

    def more() -> bool:
        for p in pieces:
            if p:
                buffer.extend(p)
                return True
        return False

    while True:
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            if not more():
                if buffer.strip():
                    raise ValueError("the archive ends inside a record's header")
                return
        lines = bytes(buffer[:end]).decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("a record does not begin with its version")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size, begin = int(headers["content-length"]), end + 4
        while len(buffer) < begin + size + 4:
            if not more():
                break
        if len(buffer) < begin + size:
            raise ValueError("the archive ends inside a record's block")
        yield headers, bytes(buffer[begin:begin + size])
        del buffer[:begin + size + 4]


_FIELDS = {"type": "warc-type", "record_id": "warc-record-id", "origin": "warc-segment-origin-id",
           "number": "warc-segment-number", "total": "warc-segment-total-length", "uri": "warc-target-uri",
           "digest": "warc-payload-digest", "refers_to": "warc-refers-to", "row_id": "x-row-id",
           "refers_to_row": "x-refers-to-row-id"}


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records under ``path`` as they stand: the headers above and ``block``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    names = [*_FIELDS]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        kinds = [pa.int64() if n in ("number", "total") else pa.string() for n in names] + [pa.binary()]

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[*names, "block"])

        for b in batches:
            for raw in b.column(0):
                rows, size = [], 0
                for h, block in parse_records(_stream(raw.as_py())):
                    row = [h.get(_FIELDS[n]) for n in names]
                    for i in (3, 4):
                        row[i] = int(row[i]) if row[i] is not None else None
                    rows.append((*row, block))
                    size += len(block)
                    if size >= 4 << 20:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)

    schema = ", ".join(f"{n} {'long' if n in ('number', 'total') else 'string'}" for n in names) + ", block binary"
    return files.mapInArrow(run, schema)


def reassemble(records: DataFrame) -> DataFrame:
    """One row per logical record: segments joined in order, with ``status``
    ``ok``, ``missing segment``, ``conflict`` (one number, different blocks),
    ``no origin`` or ``wrong length``; only ``ok`` rows have a block."""
    head = ["type", "record_id", "uri", "digest", "refers_to", "row_id", "refers_to_row"]
    whole = records.where("number is null").select(*head, "block", F.lit("ok").alias("status"))
    parts = records.where("number is not null").withColumn("first", F.coalesce("origin", "record_id"))
    segment = F.struct("number", "block", "total")
    heads = F.when(F.col("origin").isNull(), F.struct(*head))
    g = parts.groupBy("first").agg(F.array_sort(F.collect_set(segment)).alias("s"), F.max(heads).alias("h"),
                                   F.count(F.when(F.col("origin").isNull(), 1)).alias("copies"))
    n = F.size("s")
    numbers = F.transform("s", lambda x: x.number)
    joined = F.expr("reduce(s, 0L, (n, x) -> n + length(x.block))")
    total = F.array_max(F.transform("s", lambda x: x.total))
    status = (F.when(F.col("h").isNull(), "no origin").when(F.size(F.array_distinct(numbers)) < n, "conflict")
              .when((F.element_at(numbers, 1) != 1) | (F.element_at(numbers, -1) != n) | total.isNull(), "missing segment")
              .when(joined != total, "wrong length").otherwise("ok"))
    g = g.withColumn("status", status).withColumn("copies", F.greatest("copies", F.lit(1)))
    block = F.when(F.col("status") == "ok", F.concat(F.lit("").cast("binary"), F.unhex(F.array_join(F.transform("s", lambda x: F.hex(x.block)), ""))))
    # Equal rows share an identifier: one logical record each.
    g = g.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return whole.unionByName(g.select(*[F.coalesce(F.col("h")[c], F.col("first") if c == "record_id" else F.lit(None)).alias(c) for c in head],
                                      block.alias("block"), "status"))


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Logical records under ``path`` with the decoded ``payload`` of responses
    (null for revisits) and ``status`` (``bad frame`` if it cannot be decoded,
    ``bad digest`` if the payload is not the one the header names)."""
    logical = reassemble(read_records(spark, path))
    schema = T.StructType([f for f in logical.schema.fields if f.name not in ("block", "status")]
                          + [T.StructField("payload", T.BinaryType()), T.StructField("status", T.StringType())])
    names = [f.name for f in schema]
    logical = logical.select(*names[:-2], "block", "status")

    def decoded(block: bytes) -> bytes:
        head, sep, body = block.partition(b"\r\n\r\n")
        if not sep:
            raise ValueError("no end of the HTTP header")
        fields = {k.strip().lower(): v.strip().lower() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
        return dechunked(body) if fields.get(b"transfer-encoding") == b"chunked" else body

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for b in batches:
            payloads, states = [], []
            for kind, digest, block, status in zip(b.column("type").to_pylist(), b.column("digest").to_pylist(),
                                                   b.column("block"), b.column("status").to_pylist()):
                payload = None
                if status == "ok" and kind == "response":
                    try:
                        payload = decoded(block.as_py())
                        if digest is not None and digest != digest_of(payload):
                            payload, status = None, "bad digest"
                    except ValueError:
                        status = "bad frame"
                payloads.append(payload)
                states.append(status)
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(payloads, pa.binary()), pa.array(states, pa.string())], names=names)

    return logical.mapInArrow(run, schema)
