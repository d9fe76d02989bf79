"""Operator 9: WARC archives, written as Spark files and read back by a splittable reader.

Writing: every record is a gzip member of its own, written by Spark's text writer, so files appear only when their
task commits. The writer needs a separator between rows; it is an empty gzip member, so the file stays a plain
multi-member gzip archive. Of records with equal payloads of at least REVISIT_BYTES, the one with the smallest
page_id is the response and the others are revisits of it.

Reading: tasks take byte ranges of the files. A task looks for the gzip magic from its range's start, decodes each
candidate, drops those whose content does not begin as a WARC record, and owns the records that start inside its
range, reading on past its end to finish the last one.

Cases: a null html counts as empty; a null url gets a urn; a null page_id is written without one and read as null;
small equal payloads are all responses; of pages that share a page_id, only those with the repeated payload are
revisits.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, group_facts, salted, shared_folder

REVISIT_BYTES = 100
#: Bytes of a reading task's range.
SPLIT_BYTES = 8 << 20
MAGIC = b"\x1f\x8b\x08"
EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL name space of UUIDs


def _record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'page:{page_id}')}>"


def _member(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    block = _HTTP + payload if kind == "response" else _HTTP
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Target-URI: {(url or f'urn:page:{page_id}').translate({13: '%0D', 10: '%0A'})}", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    work = zlib.compressobj(1, zlib.DEFLATED, 31)
    return work.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + work.flush()


def plan_records(pages: DataFrame) -> DataFrame:
    """The pages with digest and refers_to, the smallest page_id of an equal payload or null."""
    base = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn("sha", F.unhex(F.sha2("html", 256)))
    slim = salted(base.select("page_id", F.octet_length("html").alias("size"), "sha"), "page_id").where(F.col("size") >= REVISIT_BYTES)
    slim = checkpoint(slim)
    first = group_facts(slim, ["sha"], [F.min("page_id").alias("first"), F.count("*").alias("n")], [F.min("first").alias("first"), F.sum("n").alias("n")]).where("n > 1")
    revisits = slim.join(first, ["sha", "_salt"]).where("page_id > first").groupBy("page_id", "sha").agg(F.min("first").alias("refers_to"))
    return base.join(revisits, ["page_id", "sha"], "left").drop("sha")


def write(records: DataFrame, folder: str) -> None:
    """Writes a folder of multi-member gzip WARC files."""

    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to")), strict=True)
            out = []
            for row in rows:
                page_id, url, html, refers_to = (x.as_py() for x in row)
                payload = html.encode()
                out.append(_member(page_id, url, payload, hashlib.sha256(payload).hexdigest(), refers_to))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])

    members = records.select("page_id", "url", "html", "refers_to").mapInArrow(run, "member binary")
    members.select(F.col("member").cast("string")).write.option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").text(folder)


def _open(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    system, inner = (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def _decode(file, at: int, block: int = 1 << 18) -> tuple[bytes, int] | None:
    """The content of the gzip member at a place and the place after it; None if there is no member."""
    work, out = zlib.decompressobj(31), []
    file.seek(at)
    try:
        while not work.eof:
            data = file.read(block)
            if not data:
                return None
            out.append(work.decompress(data))
            at += len(data)
            if out[0] and not out[0].startswith(b"WARC/1."[: len(out[0])]):
                return None
    except zlib.error:
        return None
    return b"".join(out), at - len(work.unused_data)


def members(file, start: int, end: int, block: int = 1 << 18) -> Iterator[tuple[int, bytes]]:
    """Places and contents of the members that start in a byte range."""
    at = start
    while at < end:
        file.seek(at)
        data = file.read(min(block, end - at) + len(MAGIC) - 1)
        k = data.find(MAGIC)
        if k < 0:
            at += block
            continue
        if at + k >= end:
            return
        found = _decode(file, at + k)
        if found is None:
            at += k + 1
        else:
            yield at + k, found[0]
            at = found[1]


def _parse(content: bytes) -> tuple | None:
    """(page_id, payload bytes, digest, type, refers_to) of a record; None for another kind of content."""
    head, _, block = content.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/1."):
        return None
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    number = lambda name: int(fields[name]) if name in fields else None
    digest, size = fields["WARC-Payload-Digest"].partition(":")[2], number("X-Payload-Length")
    if fields["WARC-Type"] == "response":
        payload = block[: number("Content-Length")].partition(b"\r\n\r\n")[2]
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return number("X-Page-Id"), size, digest, fields["WARC-Type"], number("X-Refers-To-Page")


def read(spark: SparkSession, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record of a folder of archives."""
    files = spark.read.format("binaryFile").load(folder).select("path", "length")
    ranges = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("start"))
    ranges = ranges.repartitionByRange(max(1, ranges.count()), "path", "start")  # a task for each range: rows this small would else be put together
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                rows = []
                with _open(path) as file:
                    for _, content in members(file, start, min(start + split_bytes, file.size())):
                        if content and (row := _parse(content)):
                            rows.append(row)
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return ranges.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes the pages as archives in the shared folder and reads them back."""
    spark = pages.sparkSession
    folder = folder or shared_folder(spark, "warc")
    write(plan_records(pages), folder)
    return read(spark, folder)


SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM f
"""
