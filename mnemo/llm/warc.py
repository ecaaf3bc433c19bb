"""WARC: archives whose repeated payloads are revisit records.

Headers (page_id, digest, length) are shuffled by payload digest to find each payload's original and to join revisits to it.
Payloads are dealt once, by page_id and digest, to meet what was decided of them, so a payload that a third of the pages
have makes no large task. The archives are then written with the payload in the original's response record and fresh
revisit headers for the rest. Spark's text writer writes them: a row is one record, and the line separator is the blank
line that ends a WARC record, so every file is a WARC file, one gzip stream each, of about FILE_BYTES and at most
FILE_RECORDS records. There is no warcinfo record. Readers follow the Content-Length of each record; revisit records get
their payload's length by a join with the response that they refer to.

A record's id is made from page_id, address and digest, so it repeats only where all three do.

Defined cases: a null payload is empty; a null url or page_id stands as a missing header. Rows that share the smallest
page_id of a payload are all responses. A payload whose rows all lack a page_id has responses only. A null page_id
beside known ones is a revisit. Every row gives one record, of any length below the reader's 2 GB; an empty table gives
archives without records. Only page_id, url and html are read, so further columns cannot clash.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: A payload of fewer bytes is stored again each time.
MIN_REVISIT_BYTES = 100
#: Records of an archive file at most, and bytes of payload on average.
FILE_RECORDS = 2000
FILE_BYTES = 32 << 20
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def resolve_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """page_id, url, payload (of responses), payload_bytes, payload_digest, record_type, refers_to and the original's record of each row of pages."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    headers = rows.filter(F.col("payload_bytes") >= min_bytes).select("page_id", "url", "payload_digest")
    # partial counts and minima: a payload sends one row from each task, however often it is repeated
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", F.coalesce("url", F.lit("")).alias("url"))))
    originals = headers.groupBy("payload_digest").agg(first.alias("original"), F.count("*").alias("n")).filter("n > 1 AND original IS NOT NULL").drop("n")
    revisits = headers.select("page_id", "payload_digest").distinct().join(originals, "payload_digest").filter("NOT page_id <=> original.page_id")
    size = pages.agg(F.sum(F.octet_length(payload))).first()[0] or 0
    parts = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // file_bytes))
    key = lambda df: df.withColumn("__id", F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    decided = key(revisits).select("__id", "payload_digest", "original").repartition(parts, "__id", "payload_digest")
    dealt = key(rows).repartition(parts, "__id", "payload_digest")
    revisit = F.col("original").isNotNull()
    return dealt.join(decided, ["__id", "payload_digest"], "left").select(
        "page_id",
        "url",
        F.when(~revisit, F.col("payload")).alias("payload"),
        "payload_bytes",
        "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("original.page_id").alias("refers_to"),
        F.when(revisit, _record_id(F.col("original.page_id"), F.col("original.url"), F.col("payload_digest"))).alias("refers_to_record"),
    )


def _record_id(page_id: Column, url: Column, digest: Column) -> Column:
    name = F.md5(F.concat_ws("\n", F.coalesce(page_id.cast("string"), F.lit("")), F.coalesce(url, F.lit("")), digest))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(name, "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), F.lit(">"))


def _record(date: str) -> Column:
    """The record's text without the separator that ends it."""
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    size = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    # a line end within an address would end the header
    address = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    fields = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"), F.col("url"), F.col("payload_digest"))),
        F.concat(F.lit("X-Page-ID: "), F.col("page_id").cast("string")),
        F.concat(F.lit("WARC-Target-URI: "), address),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest")),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), F.col("refers_to_record"), F.lit("\r\nX-Refers-To-Page-ID: "), F.col("refers_to").cast("string"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), size.cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *fields), F.lit(END), block)


def write_archives(resolved: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", file_records: int = FILE_RECORDS) -> None:
    """Write the records of resolve_revisits as WARC files into folder."""
    resolved.select(_record(date).alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", file_records).option("compression", "gzip").text(folder)


def parse_records(data: memoryview) -> Iterator[tuple[dict[bytes, bytes], memoryview]]:
    """Header fields and block of each record of a WARC file."""
    raw, at, end = bytes(data), 0, END.encode()
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
        data = memoryview(raw)
    while at < len(raw):
        stop = raw.index(end, at)
        lines = raw[at:stop].split(b"\r\n")
        if lines[0] != b"WARC/1.1":
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(line.split(b": ", 1) for line in lines[1:])
        begin = stop + len(end)
        size = int(fields[b"Content-Length"])
        yield fields, data[begin : begin + size]
        at = begin + size
        if raw[at : at + len(end)] != end:
            raise ValueError(f"the record before byte {at} is cut")
        at += len(end)


def _id(value: bytes | None) -> int | None:
    return None if value is None else int(value)


RECORD_SCHEMA = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of WARC files; digest and length of a response are taken from the payload itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for fields, block in parse_records(memoryview(content.as_buffer())):
                    kind = fields[b"WARC-Type"].decode()
                    body = block[bytes(block[:1000]).index(END.encode()) + len(END) :]
                    digest, size = fields[b"WARC-Payload-Digest"].removeprefix(b"sha256:").decode(), None
                    if kind == "response":
                        if hashlib.sha256(body).hexdigest() != digest:
                            raise ValueError("a payload does not match its digest")
                        size = len(body)
                    url = fields.get(b"WARC-Target-URI")
                    rows.append((_id(fields.get(b"X-Page-ID")), url and url.decode(), kind, digest, size, _id(fields.get(b"X-Refers-To-Page-ID")), bytes(body) if payloads else None))
                if not rows:
                    continue
                schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(run, RECORD_SCHEMA)


def revisited(records: DataFrame) -> DataFrame:
    """Give each revisit record the payload length of the response that it refers to."""
    originals = (
        records.filter("record_type = 'response' AND page_id IS NOT NULL")
        .select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload_bytes").alias("original_bytes"))
        .dropDuplicates(["refers_to", "payload_digest"])
    )
    return records.join(originals, ["refers_to", "payload_digest"], "left").select(
        "page_id",
        "url",
        F.coalesce("payload_bytes", "original_bytes").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        "refers_to",
    )


def warc_round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write a record for each page, read the archives back, and resolve their revisits."""
    spark = pages.sparkSession
    folder = folder or common.new_folder(spark, "warc")
    write_archives(resolve_revisits(pages), folder)
    return revisited(read_archives(spark, folder, payloads=False))
