"""WARC archives of pages, with revisit resolution.

1. Every page becomes a response record (WARC/1.1): its html in UTF-8 as the
   payload, SHA-1 and length in the headers.  Records are packed to archives
   of about ``ARCHIVE_BYTES`` (a longer record has one of its own).
2. The archives are read back, record by record, by their Content-Length.
3. Only headers are shuffled: (payload digest, page id) to the largest id of
   each digest that occurs twice.  That table is joined to the records; those
   that are not the largest become revisits.
4. Deduplicated archives are written with fresh headers: a revisit has no
   payload, refers to the response's record id, and keeps the digest and length
   of the full payload.  The result is read from them.

Archives are written by Spark's text writer with ``CR LF CR LF`` as its line
end, which is what ends a record; so any store that Spark writes to will do.
They are gzip files with one member each.

Nulls: null html is an empty payload; a null page id is less than any other
and is written as ``none``; a null url as ``urn:none``.  Ties: repeated rows of
the largest page id are all responses.  Payloads under ``least_bytes`` are
always responses.  An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import scratch_path

from .common import materialize, read_table

ARCHIVE_BYTES = 16 << 20
END = "\r\n\r\n"
NONE = "none"
#: fixed for reproducible archives; a crawl passes its own
DATE = "2025-01-01T00:00:00Z"
HEADER_LINE = re.compile(rb"([!-9;-~]+):[ \t]*(.*?)\r\n")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: str) -> str:
    return f"<urn:page:{page}>"


def build_record(page: str, url: str | None, payload: bytes, date: str, of: str | None = None) -> bytes:
    """A record without its last blank lines.  ``of``: the page that a revisit
    refers to; its payload is then left out."""
    target = re.sub(r"[\x00-\x20\x7F]", lambda m: f"%{ord(m[0]):02X}", url) if url is not None else "urn:none"
    head = ["WARC/1.1", f"WARC-Type: {'response' if of is None else 'revisit'}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {date}",
            f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Payload-Length: {len(payload)}"]
    if of is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(of)}"]
        payload = b""
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload


def read_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-cased name, payload) of each record of an archive."""
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/1.", at):
            raise ValueError(f"no record at byte {at}")
        at, head = data.index(b"\r\n", at) + 2, {}
        while not data.startswith(b"\r\n", at):
            m = HEADER_LINE.match(data, at)
            if m is None:
                raise ValueError(f"no header at byte {at}")
            head[m[1].decode().lower()] = m[2].decode()
            at = m.end()
        size = int(head["content-length"])
        at += 2
        if data[at + size:at + size + 4] != END.encode():
            raise ValueError(f"record cut short at byte {at}")
        yield head, data[at:at + size]
        at += size + 4


def write_archives(records: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """``record`` (binary, without the last blank lines) to files under ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        held, size = [], 0
        for batch in batches:
            for x in batch.column(0):
                record = x.as_py()
                if held and size + len(record) > archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([END.encode().join(held)], pa.binary())], ["archive"])
                    held, size = [], 0
                held.append(record)
                size += len(record) + 4
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([END.encode().join(held)], pa.binary())], ["archive"])

    (records.select("record").mapInArrow(run, "archive binary").select(F.col("archive").cast("string").alias("value"))
     .write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", 1).text(path))


RECORD = "page_id long, url string, type string, digest string, payload_bytes long, refers_to long, payload binary"


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row per record.  An archive is bounded by its writer, so it is read whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        import pyarrow as pa

        page = lambda s: None if (i := s[len("<urn:page:"):-1]) == NONE else int(i)
        names = ["page_id", "url", "type", "digest", "payload_bytes", "refers_to", "payload"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for x in batch.column(0):
                rows, size = [], 0
                for head, payload in read_records(gzip.decompress(x.as_py())):
                    of = head.get("warc-refers-to")
                    target = head["warc-target-uri"]
                    if head["warc-type"] == "response" and head["warc-payload-digest"] != f"sha1:{digest(payload)}":
                        raise ValueError(f"digest of {head['warc-record-id']} does not match")
                    rows.append((page(head["warc-record-id"]), None if target == "urn:none" else target, head["warc-type"],
                                 head["warc-payload-digest"].removeprefix("sha1:"), int(head["warc-payload-length"]),
                                 None if of is None else page(of), payload if with_payload else None))
                    size += len(payload)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(run, RECORD)


def _as_records(rows: DataFrame, date: str) -> DataFrame:
    """(page_id, url, payload[, refers_to, is_revisit]) -> record."""
    revisits = "is_revisit" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        name = lambda i: NONE if i is None else str(i)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                col = {c: part.column(part.schema.get_field_index(c)).to_pylist() for c in part.schema.names}
                out = [build_record(name(i), u, p or b"", date, name(col["refers_to"][n]) if revisits and col["is_revisit"][n] else None)
                       for n, (i, u, p) in enumerate(zip(col["page_id"], col["url"], col["payload"], strict=True))]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    return rows.mapInArrow(run, "record binary")


def pages_to_archives(pages: DataFrame, path: str, date: str = DATE, archive_bytes: int = ARCHIVE_BYTES) -> None:
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    write_archives(_as_records(rows, date), path, archive_bytes)


def resolve_revisits(spark: SparkSession, source: str, target: str, least_bytes: int = 0, date: str = DATE, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Read the archives under ``source``, write deduplicated ones under ``target``."""
    records = read_archives(spark, source).where("type = 'response'")
    headers = read_archives(spark, source, with_payload=False).where("type = 'response'").select("digest", "payload_bytes", "page_id")
    # written, so that the planner knows its size: a small table is broadcast, a large one joined by a shuffle
    originals = materialize(
        headers.where(F.col("payload_bytes") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").select("digest", "original"), "originals")
    marked = (records.join(originals, "digest", "left")
              .withColumn("is_revisit", F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original")))
              .select("page_id", "url", "payload", F.col("original").alias("refers_to"), "is_revisit"))
    write_archives(_as_records(marked, date), target, archive_bytes)


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, final = scratch_path(spark, "warc"), scratch_path(spark, "warc-dedup")
    pages_to_archives(read_table(spark, sf_dir, "pages", "page_id", "url", "html"), first)
    resolve_revisits(spark, first, final)
    return read_archives(spark, final, with_payload=False).select(
        "page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


#: base32 of a SHA-1 from its hexadecimal form: five digits are four letters
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS hex, max(page_id) OVER (PARTITION BY sha1(body)) AS original FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, (i // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - i % 4 * 5)::BIGINT) & 31)::INT + 1, 1)),
         'string_agg', '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM original THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM original THEN NULL ELSE original END AS refers_to
FROM d
"""
