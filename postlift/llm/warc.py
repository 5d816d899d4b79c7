"""WARC archives: segmented, chunk-framed records written and put together again.

Writing: one ``response`` record per distinct large payload, ``revisit`` records for
its copies, which name the response's record identifier.  Identifiers follow from page,
digest and place among equal rows, so a task that runs again writes the same ones.  A record block is an HTTP response whose body is framed in chunks; blocks
over ``SEGMENT`` bytes go out as a first record and ``continuation`` records.

Reading: continuation records are grouped by the origin identifier, ordered by segment
number and checked against the stated total length; then the chunk frames are decoded
and the payload is checked against its digest.  Records without segments need no shuffle.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .textops import HEAVY, join_groups

#: Bytes of a segment and of a chunk; records per file, which bound a file; least shared payload.
SEGMENT, CHUNK, FILE_RECORDS, LEAST_SHARED = 16_384, 4_096, 4_096, 1_000
_END = "\r\n\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def with_roles(pages: DataFrame, least: int = LEAST_SHARED, heavy: int = HEAVY) -> DataFrame:
    """Rows with payload, its SHA-1, ``refers_to`` (the response's page_id for revisits) and ``place``.

    Of equal payloads of at least ``least`` bytes the row with the greatest page_id is
    the response.  Only digests and ids are grouped; map-side combining takes a payload
    that very many pages share, and ``heavy`` such pages and more join by broadcast.
    ``place`` numbers rows of one page and payload, from 1.
    """
    rows = (pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
            .withColumn("sha1", F.sha1(F.col("payload").cast("binary"))))
    keyed = rows.where(F.octet_length("payload") >= least).select("page_id", "sha1")
    shared = keyed.groupBy("sha1").agg(F.max("page_id").alias("refers_to"),
                                       F.count("*").alias("_rows")).where("_rows > 1")
    copies = (join_groups(keyed, shared, ["sha1"], heavy).where("page_id <> refers_to")
              .select(F.col("page_id").alias("_id"), F.col("sha1").alias("_sha1"), "refers_to").distinct())
    same = Window.partitionBy("page_id", "sha1").orderBy("url")
    return (rows.join(copies, (F.col("page_id") == F.col("_id")) & (F.col("sha1") == F.col("_sha1")), "left")
            .select("page_id", "url", "payload", "sha1", "refers_to", F.row_number().over(same).alias("place")))


def _cut(data: bytes, size: int) -> Iterator[bytes]:
    """Parts of about ``size`` bytes that end between UTF-8 characters."""
    at = 0
    while at < len(data):
        stop = min(len(data), at + size)
        while stop < len(data) and data[stop] & 0xC0 == 0x80:
            stop += 1
        yield data[at:stop]
        at = stop


def framed(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for c in _cut(payload, size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def unframed(body: bytes) -> bytes:
    """The payload of a body in chunked framing; ill-formed framing raises."""
    parts, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if not size:
            return b"".join(parts)
        if body[at + size:at + size + 2] != b"\r\n":
            raise ValueError("a chunk is shorter than stated")
        parts.append(body[at:at + size])
        at += size + 2


def _record(kind: str, fields: dict, block: bytes) -> str:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *[f"{k}: {v}" for k, v in fields.items() if v is not None],
             f"Content-Length: {len(block)}"]
    return "\r\n".join(lines) + _END + block.decode()


def record_id(page_id, sha1: str, place: int = 1) -> str:
    """The identifier of the ``place``-th record of a page's payload."""
    return f"<urn:page:{'' if page_id is None else page_id}:{sha1}:{place}>"


def records_of(page_id, url, payload: str, sha1: str, refers_to, place: int, date: str,
               segment: int = SEGMENT) -> Iterator[str]:
    """The record of one page, as one text or, over ``segment`` bytes, several."""
    own = record_id(page_id, sha1, place)
    clean = None if url is None else re.sub(
        r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    common = {"WARC-Record-ID": own, "WARC-Date": date, "WARC-Target-URI": clean,
              "WARC-Page": page_id, "WARC-Payload-Digest": f"sha1:{sha1}"}
    if refers_to is not None:
        yield _record("revisit", {**common, "WARC-Refers-To": record_id(refers_to, sha1), "WARC-Profile":
                                  "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}, b"")
        return
    block = _HTTP + framed(payload.encode())
    common["Content-Type"] = "application/http; msgtype=response"
    if len(block) <= segment:
        yield _record("response", common, block)
        return
    parts = list(_cut(block, segment))
    yield _record("response", {**common, "WARC-Segment-Number": 1}, parts[0])
    for k, part in enumerate(parts[1:], 2):
        yield _record("continuation", {
            "WARC-Record-ID": f"{own[:-1]}:segment:{k}>", "WARC-Date": date,
            "WARC-Segment-Origin-ID": own, "WARC-Segment-Number": k,
            "WARC-Segment-Total-Length": len(block) if k == len(parts) else None}, part)


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z",
                   least: int = LEAST_SHARED) -> None:
    """Gzipped archives of all pages in ``path``, at most ``FILE_RECORDS`` records a file.

    A null html is an empty payload; a null url has no target header; repeated rows and
    null page ids get records of their own; an empty table writes no record.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for page in zip(*(c.to_pylist() for c in batch.columns)):
                for record in records_of(*page, date):
                    out.append(record)
                    held += len(record)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
                    out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    # The line separator ends every record the way the format asks for.
    (with_roles(pages, least).mapInArrow(run, "value string").write
     .option("lineSep", _END).option("compression", "gzip")
     .option("maxRecordsPerFile", FILE_RECORDS).text(path))


def parse(stream) -> Iterator[tuple[dict, bytes]]:
    """Header fields (lower-case names) and block of every record of a stream."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:40]!r}")
        fields = {"warc-version": line.strip().decode()[5:]}
        while (line := stream.readline()).strip():
            key, _, value = line.decode("utf-8", "replace").partition(":")
            fields[key.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a record is shorter than stated")
        yield fields, block


_RECORD = ("record_id string, page_id long, kind string, refers_record string, digest string, "
           "origin string, segment int, total long, block binary")


def _number(text: str | None) -> int | None:
    """The whole number at the end of a field."""
    found = re.search(r"-?\d+$", text or "")
    return int(found[0]) if found else None


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of all archives in ``path``, as stored: one row per record or segment."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _RECORD.split(", ")]
        types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(),
                 pa.int32(), pa.int64(), pa.binary()]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                raw = io.BytesIO(content.as_buffer())
                stream = gzip.GzipFile(fileobj=raw) if content.as_buffer()[:2].to_pybytes() == b"\x1f\x8b" else raw
                for f, block in parse(stream):
                    rows.append((f.get("warc-record-id"), _number(f.get("warc-page")), f.get("warc-type"),
                                 f.get("warc-refers-to"),
                                 (f.get("warc-payload-digest") or "").partition(":")[2] or None,
                                 f.get("warc-segment-origin-id"),
                                 _number(f.get("warc-segment-number")),
                                 _number(f.get("warc-segment-total-length")), block))
                    held += len(block)
                    if held > 4 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(run, _RECORD)


def put_together(segments: list[tuple[int, int | None, bytes]]) -> bytes:
    """One block from (number, total, part); gaps, repeats or a wrong length raise."""
    segments = sorted(segments, key=lambda s: s[0])
    if [s[0] for s in segments] != list(range(1, len(segments) + 1)):
        raise ValueError("segments are missing or repeated")
    block = b"".join(s[2] for s in segments)
    if segments[-1][1] != len(block):
        raise ValueError("segments do not add up to the stated length")
    return block


def payload_of(block: bytes) -> bytes:
    """The decoded body of an HTTP response block."""
    head, _, body = block.partition(b"\r\n\r\n")
    framing = re.search(rb"^transfer-encoding:\s*chunked\s*$", head, re.I | re.M)
    return unframed(body) if framing else body


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record_type, record_id, refers_record, payload_bytes, payload_digest, payload) of records.

    Revisits carry the stored digest and the identifier of the response; their payload and
    its length are the response's and null here.  Missing segments, wrong lengths, framing or digests raise.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page_id, kind, record, refers_record, digest, segments, block in zip(*(
                    batch.column(c).to_pylist() for c in (*fields, "segments", "block"))):
                payload = None
                if kind == "response":
                    payload = payload_of(block if segments is None else put_together(
                        [(s["segment"], s["total"], s["block"]) for s in segments]))
                    if hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError("a payload does not have its digest")
                out.append({"page_id": page_id, "record_type": kind, "record_id": record,
                            "refers_record": refers_record, "payload_bytes": None if payload is None else len(payload),
                            "payload_digest": digest, "payload": payload})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([
                ("page_id", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()),
                ("refers_record", pa.string()),
                ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]))

    records = read_records(spark, path)
    fields = ["page_id", "kind", "record_id", "refers_record", "digest"]
    pieces = "array<struct<segment:int,total:bigint,block:binary>>"
    whole = records.where("segment is null").select(
        *fields, F.lit(None).cast(pieces).alias("segments"), "block")
    origin = F.coalesce("origin", "record_id")
    grouped = records.where("segment is not null").groupBy(origin.alias("_origin")).agg(
        *[F.max(c).alias(c) for c in ("page_id", "digest")],
        F.collect_list(F.struct("segment", "total", "block")).alias("segments"))
    joined = grouped.select("page_id", F.lit("response").alias("kind"), F.col("_origin").alias("record_id"),
                            F.lit(None).cast("string").alias("refers_record"), "digest",
                            F.col("segments").cast(pieces).alias("segments"),
                            F.lit(None).cast("binary").alias("block"))
    return whole.unionByName(joined).mapInArrow(
        run, "page_id long, record_type string, record_id string, refers_record string, "
             "payload_bytes long, payload_digest string, payload binary")


def page_digests(found: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """Rows of ``read_pages`` without payloads and identifiers; revisits get page and length of their response.

    A revisit that names no response, one whose digest is another, or one whose
    identifier two responses bear, raises.
    """
    own = ["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest"]
    named = found.where("record_type = 'revisit'")
    wanted = named.groupBy(F.col("refers_record").alias("record_id")).agg(F.count("*").alias("_asked"))
    targets = found.where("record_type = 'response'").select(
        "record_id", F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("_digest"),
        F.col("payload_bytes").alias("_bytes"))
    # One row per record named, whether it is there or not: a join by it loses no revisit.
    resolved = (wanted.join(targets, "record_id", "left").groupBy("record_id")
                .agg(F.max("_asked").alias("_rows"), F.count("_digest").alias("_found"),
                     *[F.max(c).alias(c) for c in ("refers_to", "_digest", "_bytes")])
                .withColumnRenamed("record_id", "refers_record"))
    right = (F.col("_found") == 1) & (F.col("_digest") == F.col("payload_digest"))
    checked = join_groups(named.drop("payload_bytes"), resolved, ["refers_record"], heavy).withColumn(
        "payload_bytes", F.when(right, F.col("_bytes")).otherwise(F.raise_error(
            F.lit("a revisit names no response with its digest")).cast("long")))
    responses = found.where("record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("long"))
    return responses.select(own).unionByName(checked.select(own))
