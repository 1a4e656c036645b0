"""WARC archives with revisit records: writing, reading and resolving.

Headers are shuffled by payload digest, the smallest identifier of a digest becomes the original response,
and every other record a revisit that names it. Archives go through Spark's own text sink: a WARC record ends
with two line breaks, which is what the sink puts after every value. They are read back by Content-Length,
so a payload may hold anything.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
# records per archive file; a file is read by one task, record after record
RECORDS_PER_FILE = 20_000
READ_BYTES = 1 << 20
NO_ID = ""

RECORD = "record_id string, record_type string, target string, date string, payload_digest string, refers_to_id string, page_id long, block binary"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: five hex digits are four base32 digits."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit(NO_ID)) for p in parts]))
    pieces = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *pieces), F.lit(">"))


def _clean(value: Column) -> Column:
    """A header value on one line."""
    return F.regexp_replace(value, r"[\x00-\x20\x7F]+", "%20")


def write_warc(pages: DataFrame, path: str, date: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> None:
    """One WARC/1.1 record per row below ``path``, gzip-compressed, with payloads for responses only.

    Of the rows with one payload of at least ``min_bytes`` bytes the smallest id is the response and the others
    revisit it; smaller ones are responses all. Null ids come last; if a payload has no other, all its records are
    responses, and so are records that repeat the smallest id. A null payload is empty, a null url becomes ``urn:page:<id>``, line breaks in a url are escaped, and other
    columns are left out. Rows are never merged: repeated rows give repeated records.
    """
    read = pages.select(
        F.col(id_col).cast("long").alias("_id"),
        F.coalesce(F.col(url_col), F.concat(F.lit("urn:page:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("_url"),
        F.coalesce(F.col(payload_col), F.lit("")).alias("_payload"),
    )
    digested = read.select("_id", "_url", "_payload", base32_sha1("_payload").alias("_digest"), F.octet_length("_payload").cast("long").alias("_size"))
    # headers alone are shuffled and counted by digest; a digest that many rows share is one row here, and
    # adaptive execution splits the other side of the join
    heads = digested.groupBy("_digest").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1 AND _first IS NOT NULL")
    joined = digested.join(heads, "_digest", "left")
    revisit = (F.col("_size") >= min_bytes) & F.col("_first").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_first"))
    block = F.when(F.col("_revisit"), F.lit(HTTP_HEAD)).otherwise(F.concat(F.lit(HTTP_HEAD), "_payload"))
    first_record = _uuid(F.col("_first"), F.col("_digest"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(F.col("_revisit"), "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _uuid(F.col("_id"), F.col("_digest"))),
        F.concat(F.lit("WARC-Date: "), F.lit(date)),
        F.concat(F.lit("WARC-Target-URI: "), _clean(F.col("_url"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("_digest")),
        F.when(F.col("_id").isNotNull(), F.concat(F.lit("WARC-Page-ID: "), F.col("_id").cast("string"))),
        F.when(F.col("_revisit"), F.concat(F.lit("WARC-Refers-To: "), first_record)),
        F.when(F.col("_revisit"), F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    # concat_ws leaves out the lines that are null
    record = F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), block)
    (
        joined.withColumn("_revisit", revisit)
        .select(record.alias("value"))
        .write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE)
        .text(path)
    )


def _inflated(content: bytes) -> Iterator[bytes]:
    """The bytes of an archive in pieces; plain, or any number of gzip members."""
    if content[:2] != b"\x1f\x8b":
        for at in range(0, len(content), READ_BYTES):
            yield content[at : at + READ_BYTES]
        return
    left = content
    while left:
        member = zlib.decompressobj(31)
        piece = member.decompress(left, READ_BYTES)
        while piece or not member.eof:
            if not piece and not member.unconsumed_tail:
                raise ValueError("archive ends within a gzip member")
            yield piece
            piece = member.decompress(member.unconsumed_tail, READ_BYTES)
        left = member.unused_data


def records_in(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of every record of an archive, framed by Content-Length."""
    pieces, held = _inflated(content), bytearray()

    def fill() -> bool:
        piece = next(pieces, None)
        if piece is not None:
            held.extend(piece)
        return piece is not None

    while True:
        while held[:2] == b"\r\n":
            del held[:2]
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not fill():
                if held.strip():
                    raise ValueError("archive ends within a header")
                return
            while held[:2] == b"\r\n":
                del held[:2]
        lines = bytes(held[:end]).decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a record: {lines[0][:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(fields["content-length"])
        del held[: end + 4]
        while len(held) < size:
            if not fill():
                raise ValueError("archive ends within a block")
        yield fields, bytes(held[:size])
        del held[:size]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([*((n, pa.string()) for n in ("record_id", "record_type", "target", "date", "payload_digest", "refers_to_id")), ("page_id", pa.int64()), ("block", pa.binary())])
    for batch in batches:
        for content in batch.column("content"):
            rows, held = [], 0
            for fields, block in records_in(content.as_py()):
                page = fields.get("warc-page-id")
                rows.append(
                    (fields.get("warc-record-id"), fields.get("warc-type"), fields.get("warc-target-uri"), fields.get("warc-date"),
                     (fields.get("warc-payload-digest") or "").rpartition(":")[2], fields.get("warc-refers-to"), int(page) if page else None, block)
                )
                held += len(block)
                if held > READ_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """All records below ``path`` (plain or gzip), one row each. A damaged archive is an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInArrow(_rows, RECORD)


def payload_facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the size of each payload, and checks its digest where the record holds it."""
    for batch in batches:
        sizes = []
        for kind, block, digest in zip(batch.column("record_type").to_pylist(), batch.column("block"), batch.column("payload_digest").to_pylist()):
            payload = block.as_py().partition(b"\r\n\r\n")[2]
            if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                raise ValueError(f"payload does not match its digest {digest}")
            sizes.append(len(payload) if kind == "response" else None)
        kept = [n for n in batch.schema.names if n != "block"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(sizes, pa.int64())], [*kept, "payload_bytes"])


def resolved(records: DataFrame) -> DataFrame:
    """Records with payload_bytes and refers_to, revisits joined to the responses that they name."""
    schema = ", ".join(x for x in RECORD.split(", ") if not x.startswith("block")) + ", payload_bytes long"
    facts = records.mapInArrow(payload_facts, schema)
    # repeated rows repeat a record id: one original each is enough
    originals = facts.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to_id")).agg(F.max("payload_bytes").alias("_bytes"), F.max("page_id").alias("_page"))
    return facts.join(originals, "refers_to_id", "left").select(
        "page_id", "target", "date", "record_id", "record_type", "payload_digest",
        F.coalesce("payload_bytes", "_bytes").alias("payload_bytes"),
        F.when(F.col("record_type") == "revisit", F.col("_page")).alias("refers_to"),
    )
