"""WARC archives with revisit records.

Headers (id, digest, length) are shuffled by payload digest: the largest page_id of each digest is found by a
partial aggregate, and joined to the few pages that repeat it. What those refer to meets the pages as a broadcast
table while it is small, its rows being counted first; beyond that the pages themselves are shuffled by id.
Records are gathered into archives of bounded size, compressed and written by Spark's writer with fresh headers.
Reading streams an archive of any number of gzip members and resolves every revisit against its response by record
id. An archive is read as one value, so one of foreign origin may have at most 2 GB.

Defined cases: a null page is an empty payload; a null page_id is never a revisit nor referred to; rows
that repeat a page_id and its payload get the same record type; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import WorkTable, work_dir

# The format's own names.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
#: Payloads below this many bytes are always stored.
LEAST_BYTES = 1000
#: Bytes of records in one archive before compression; a longer record is an archive of its own.
ARCHIVE_BYTES = 32 << 20
#: Revisits that may be broadcast, some 100 bytes each.
BROADCAST_ROWS = 1 << 18
#: Compressed bytes taken at a time while reading.
PIECE = 1 << 16

RECORD = "record_id string, record_type string, page_id long, url string, payload_digest string, payload_bytes long, refers_record string, refers_to long, stored_digest string"


def _record_id(page_id, digest):
    h = F.sha1(F.concat_ws("/", F.coalesce(page_id.cast("string"), F.lit("")), digest))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", h.substr(1, 8), h.substr(9, 4), F.concat(F.lit("5"), h.substr(14, 3)), F.concat(F.lit("a"), h.substr(18, 3)), h.substr(21, 12)), F.lit(">"))


def with_revisits(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, html, digest, refers_to (null: a response)."""
    body = F.coalesce(F.col("html"), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("html"), F.sha1(body.cast("binary")).alias("digest"))
    heads = pages.where((F.octet_length("html") >= least_bytes) & F.col("page_id").isNotNull()).select("page_id", "digest").distinct()
    first = heads.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = heads.join(first, "digest").where("page_id < refers_to").select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "refers_to")
    again = WorkTable(again, "revisits").read()
    if again.count() <= BROADCAST_ROWS:
        again = F.broadcast(again)
    return pages.join(again, (F.col("page_id") == F.col("p")) & (F.col("digest") == F.col("d")), "left").drop("p", "d")


def _archives(limit: int):
    """Records joined to archives of at most so many bytes, or one record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        out = lambda: pa.record_batch([pa.array([END.join(held)], pa.large_string())], names=["value"])
        for batch in batches:
            for record, n in zip(batch.column("value"), batch.column("n").to_pylist(), strict=True):
                if held and size + n > limit:
                    yield out()
                    held, size = [], 0
                held.append(record.as_py())
                size += n + len(END)
        if held:
            yield out()

    return run


def write_archives(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, date: str = "2000-01-01T00:00:00Z") -> None:
    """One record per page; records of one task follow each other in its archives."""
    n = F.octet_length("html")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), n.cast("string"), F.lit(END))
    again = F.col("refers_to").isNotNull()
    block = F.when(again, http).otherwise(F.concat(http, F.col("html")))
    url = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    optional = lambda name, value: F.coalesce(line(name, value), F.lit(""))
    head = F.concat(
        F.lit(f"{VERSION}\r\n"),
        line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("digest"))),
        line("WARC-Date", F.lit(date)),
        optional("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(again, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _record_id(F.col("refers_to"), F.col("digest"))))).otherwise(F.lit("")),
        optional("X-Page-Id", F.col("page_id").cast("string")),
        optional("X-Refers-To-Page-Id", F.col("refers_to").cast("string")),
        F.lit("Content-Type: application/http;msgtype=response\r\n"),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    records_ = with_revisits(pages, least_bytes).select(F.concat(head, block).alias("value")).withColumn("n", F.octet_length("value"))
    archives = records_.mapInArrow(_archives(ARCHIVE_BYTES), "value string")
    archives.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)


LENGTH = re.compile(rb"\r\nContent-Length: *([0-9]+)", re.I)


def unzipped(data: bytes) -> Iterator[bytes]:
    """The content of a file of gzip members, piece by piece; a file cut short raises ValueError."""
    view, at, unzip = memoryview(data), 0, None
    while at < len(view):
        unzip = unzip or zlib.decompressobj(31)
        try:
            piece = unzip.decompress(view[at : at + PIECE], 16 * PIECE)
            while piece:
                yield piece
                piece = b"" if unzip.eof or not unzip.unconsumed_tail else unzip.decompress(unzip.unconsumed_tail, 16 * PIECE)
        except zlib.error as error:
            raise ValueError(f"an archive is damaged: {error}") from error
        at = min(at + PIECE, len(view)) - len(unzip.unused_data)
        if unzip.eof:
            unzip = None
            while at < len(view) and view[at] == 0:  # padding between members
                at += 1
    if unzip:
        raise ValueError("an archive ends within a member")


def records(data: bytes | Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive, given whole or in pieces; a damaged archive raises ValueError."""
    pieces = iter([data]) if isinstance(data, bytes) else data
    buffer, at, base = bytearray(), 0, 0

    def more(n: int) -> bool:
        """Whether n bytes follow the place reached."""
        while len(buffer) < at + n:
            piece = next(pieces, None)
            if piece is None:
                return False
            buffer.extend(piece)
        return True

    while more(1):
        end = buffer.find(b"\r\n\r\n", at)
        while end < 0 and more(len(buffer) - at + 1):
            end = buffer.find(b"\r\n\r\n", at)
        if end < 0 or buffer[at : at + 5] != b"WARC/":
            raise ValueError(f"no record at byte {base + at}")
        head = bytes(buffer[at : end + 2])
        length = LENGTH.search(head)
        if not length:
            raise ValueError(f"a record without a length at byte {base + at}")
        size = int(length[1])
        if not more(end - at + 8 + size) or buffer[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"a record ends early at byte {base + at}")
        block = bytes(buffer[end + 4 : end + 4 + size])
        at = end + 8 + size
        if at > 16 * PIECE:
            del buffer[:at]
            base, at = base + at, 0
        lines = head.decode("utf-8").split("\r\n")[1:-1]
        yield {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, block


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = [pa.int64() if x.endswith("long") else pa.string() for x in RECORD.split(", ")]
    for batch in batches:
        for content in batch.column("content"):
            rows = []
            for h, block in records(unzipped(content.as_py())):
                _, _, payload = block.partition(b"\r\n\r\n")
                stored = h["warc-type"] == "response"
                if not stored and h["warc-type"] != "revisit":
                    continue  # records about the archive itself
                number = lambda k: int(h[k]) if k in h else None  # noqa: B023, E731
                rows.append((h["warc-record-id"], h["warc-type"], number("x-page-id"), h.get("warc-target-uri"), h["warc-payload-digest"].removeprefix("sha1:"), len(payload) if stored else None, h.get("warc-refers-to"), number("x-refers-to-page-id"), hashlib.sha1(payload).hexdigest() if stored else None))
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 9, kinds, strict=True)], names=names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record. Digest and length of a response are those of its stored payload, of a revisit those of the response it refers to."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content").mapInArrow(_parse, RECORD)
    found = WorkTable(found, "warc-headers").read()  # archives are opened once
    stored = found.where("record_type = 'response'").groupBy("record_id").agg(F.max("payload_bytes").alias("of_bytes"), F.max("stored_digest").alias("of_digest")).withColumnRenamed("record_id", "of_record")
    again = found.where("record_type = 'revisit'").join(stored, F.col("refers_record") == F.col("of_record"), "left")
    again = again.withColumns({"payload_bytes": F.col("of_bytes"), "stored_digest": F.col("of_digest")}).drop("of_record", "of_bytes", "of_digest")
    good = F.col("stored_digest") == F.col("payload_digest")
    checked = F.when(good, F.col("stored_digest")).otherwise(F.raise_error(F.concat(F.lit("digest or revisit does not resolve: "), F.col("record_id"))))
    return found.where("record_type = 'response'").unionByName(again).withColumn("payload_digest", checked).drop("stored_digest")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Writes archives into the application's work folder and reads them back."""
    spark = pages.sparkSession
    path = f"{work_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "record_id")
