"""Web archives: WARC files written by Spark, and transactions assembled from them.

One page becomes three records that name one another through
``WARC-Concurrent-To``: the *response* (or a *revisit* that refers to the
response with the same payload), the *request*, and a *metadata* record that
alone knows the page's id. ``assemble`` joins the three again and emits one
nested row per capture.

Plan. The payload is shuffled once, by its digest, for the join with the one
response id of each digest; that small table is written first, so both join
sides have an exchange of their own and AQE can split a digest that holds many
rows (a third of all pages may be empty). The files are written and read by
Spark's own sources (``text`` with CRLF CRLF between records, ``binaryFile``),
so they may lie in any store that Spark reaches. Reading unpacks a file as a
stream and never holds its unpacked form; a file holds at most
``records_per_file`` records. The side records are reduced to one row per hub
record before their join, and hub rows are joined, never gathered.

Edge cases. A null or empty payload has zero bytes and the digest of the empty
string. A null url leaves out the target header. A null page id is never chosen
as the response unless no row of that payload has an id; then all of them are
responses. Repeated rows of the chosen page are all responses. Extra columns
are ignored. An empty table gives empty archives and no captures.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialstats.llm.shared import written
from trialstats.session import ensure_checkpoint_dir

CRLF = "\r\n"
#: Base-32 digits of Spark's conv() and of RFC 4648, in order (fixed values).
CONV_DIGITS, BASE32_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: 40 hex digits are 8 times 5, and 5 hex digits are 4 base32 digits."""
    hexa = F.sha1(payload.cast("binary"))
    quarter = [F.lpad(F.conv(F.substring(hexa, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*quarter), CONV_DIGITS, BASE32_DIGITS)


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(kind: str | Column, record_id: Column, block: Column, date: str, headers: list[tuple[str, Column]]) -> Column:
    """One record without the closing CRLF CRLF; a null header value leaves its line out."""
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind),
             F.concat(F.lit("WARC-Record-ID: "), record_id), F.lit(f"WARC-Date: {date}")]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    lines += [F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF), block)


def write_archive(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                  min_revisit_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", records_per_file: int = 30_000) -> None:
    """Write ``pages`` as gzipped WARC files under ``path``.

    Of pages with equal payloads of at least ``min_revisit_bytes`` bytes, the one with the
    largest id is the response and the others are revisits of it.
    """
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    base = base.withColumn("digest", sha1_base32(F.col("payload")))
    chosen = written(base.groupBy("digest").agg(F.max("id").alias("response_id")), "warc-responses")
    rows = base.join(chosen, "digest")
    size = F.octet_length("payload")
    is_response = (size < min_revisit_bytes) | F.col("response_id").isNull() | F.col("id").eqNullSafe(F.col("response_id"))
    rows = rows.withColumn("is_response", is_response).withColumn("capture", F.uuid())
    own = F.concat(F.lit("<urn:uuid:"), F.col("capture"), F.lit(">"))
    shared = _urn(F.lit("response"), F.col("digest"), F.col("response_id").cast("string"))
    # the id of a response that others refer to follows from its payload and page, any other id is new
    hub = F.when(F.col("is_response") & F.col("id").eqNullSafe(F.col("response_id")) & F.col("id").isNotNull()
                 & (size >= min_revisit_bytes), shared).otherwise(own)
    rows = rows.withColumn("hub", hub)
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    target = F.coalesce(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1), F.lit("")), F.lit("/"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    size.cast("string"), F.lit(CRLF + CRLF))
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    answer = _record(
        F.when(F.col("is_response"), "response").otherwise("revisit"), F.col("hub"),
        F.when(F.col("is_response"), F.concat(http, "payload")).otherwise(http), date,
        [("WARC-Target-URI", url), ("WARC-Payload-Digest", digest),
         ("WARC-Refers-To", F.when(~F.col("is_response"), shared)),
         ("WARC-Profile", F.when(~F.col("is_response"), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
         ("Content-Type", F.lit("application/http; msgtype=response"))])
    request = _record("request", _urn(F.lit("request"), F.col("capture")),
                      F.concat(F.lit("GET "), F.coalesce(target, F.lit("/")), F.lit(f" HTTP/1.1{CRLF}Host: "), F.coalesce(host, F.lit("")), F.lit(CRLF + CRLF)),
                      date, [("WARC-Target-URI", url), ("WARC-Concurrent-To", F.col("hub")),
                             ("Content-Type", F.lit("application/http; msgtype=request"))])
    metadata = _record("metadata", _urn(F.lit("metadata"), F.col("capture")),
                       F.concat(F.lit("page-id: "), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(CRLF)),
                       date, [("WARC-Target-URI", url), ("WARC-Concurrent-To", F.col("hub")),
                              ("Content-Type", F.lit("application/warc-fields"))])
    (rows.select(F.explode(F.array(answer, request, metadata)).alias("value"))
     .write.option("lineSep", CRLF + CRLF).option("compression", "gzip")
     .option("maxRecordsPerFile", records_per_file).text(path))


RECORD = T.StructType([
    T.StructField("warc_type", T.StringType()), T.StructField("record_id", T.StringType()),
    T.StructField("concurrent_to", T.StringType()), T.StructField("refers_to", T.StringType()),
    T.StructField("url", T.StringType()), T.StructField("date", T.StringType()),
    T.StructField("declared_digest", T.StringType()), T.StructField("http_status", T.StringType()),
    T.StructField("http_bytes", T.LongType()), T.StructField("fields", T.StringType()),
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()),
    T.StructField("payload", T.BinaryType())])
_ARROW = pa.schema([(f.name, {"LongType": pa.int64(), "BinaryType": pa.binary()}.get(type(f.dataType).__name__, pa.string())) for f in RECORD])
_BATCH_BYTES = 8 << 20


def parse_records(stream: io.BufferedIOBase, payloads: bool = True) -> Iterator[tuple]:
    """Records of an unpacked WARC stream, in the column order of ``RECORD``."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not at the start of a WARC record: {line[:60]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        block = stream.read(int(head["content-length"]))
        status = length = fields = digest = size = payload = None
        kind = head.get("warc-type")
        if "application/http" in head.get("content-type", ""):
            top, _, body = block.partition(b"\r\n\r\n")
            first, *rest = top.decode("utf-8", "replace").split("\r\n")
            http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in rest)}
            status = first if kind == "request" else first.split(" ")[1]
            length = int(http["content-length"]) if "content-length" in http else None
            if kind == "response":
                size, payload = len(body), body if payloads else None
                digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        elif kind == "metadata":
            fields = block.decode("utf-8", "replace")
        yield (kind, head.get("warc-record-id"), head.get("warc-concurrent-to"), head.get("warc-refers-to"),
               head.get("warc-target-uri"), head.get("warc-date"), head.get("warc-payload-digest", "").rpartition(":")[2] or None,
               status, length, fields, size, digest, payload)


def read_archive(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of all (gzipped or plain) WARC files under ``path``; ``payloads=False`` leaves the bytes out after hashing them."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                raw = io.BytesIO(content.as_buffer())
                packed = raw.read(2) == b"\x1f\x8b"
                raw.seek(0)
                stream = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if packed else raw
                rows, held = [], 0
                for row in parse_records(stream, payloads):
                    rows.append(row)
                    held += len(row[-1] or b"") + 300
                    if held >= _BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(read, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: the response or revisit record with its request and metadata nested beside it.

    A request or metadata record belongs to the record that its ``WARC-Concurrent-To`` names. Of
    several with one target the one with the smallest record id counts; a hub without one has null.
    """
    side = [c for c in ("record_id", "url", "date", "http_status", "fields") if c in records.columns]

    def of(kind: str) -> DataFrame:
        return (records.where(F.col("warc_type") == kind).groupBy(F.col("concurrent_to").alias("hub"))
                .agg(F.min(F.struct(*side)).alias(kind)))

    hubs = records.where(F.col("warc_type").isin("response", "revisit"))
    hub = F.struct(*[c for c in records.columns if c not in ("concurrent_to", "fields")]).alias("response")
    return (hubs.select(F.col("record_id").alias("hub"), hub)
            .join(of("request"), "hub", "left").join(of("metadata"), "hub", "left"))


def captures(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Assembled captures with the page id of the metadata record, and the full payload's size, digest and source for revisits."""
    whole = assemble(read_archive(spark, path, payloads))
    page = F.nullif(F.regexp_extract("metadata.fields", r"(?m)^page-id: (-?[0-9]*)", 1), F.lit("")).cast("long")
    rows = written(whole.withColumn("page_id", page), "warc-captures")
    source = (rows.where(F.col("response.warc_type") == "response").groupBy(F.col("hub").alias("source"))
              .agg(F.max("page_id").alias("source_page"), F.max("response.payload_bytes").alias("source_bytes"),
                   F.max("response.payload_digest").alias("source_digest")))
    # responses refer to nothing: they stay out of the join, where their null keys would meet in one task
    first = F.col("response.warc_type") == "response"
    found = rows.where(~first).join(source, F.col("response.refers_to") == F.col("source"), "left")
    return found.unionByName(rows.where(first), allowMissingColumns=True)


def archive_round_trip(spark: SparkSession, pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write ``pages``, read the archives back, and return each page's payload size, digest, record type and source."""
    path = path or os.path.join(ensure_checkpoint_dir(spark), f"llm-warc-{uuid.uuid4().hex}")
    write_archive(pages, path, **options)
    both = captures(spark, path)
    kind = F.col("response.warc_type")
    return both.select(
        "page_id", F.coalesce("response.payload_bytes", "source_bytes").alias("payload_bytes"),
        F.coalesce("response.payload_digest", "source_digest").alias("payload_digest"),
        kind.alias("record_type"), F.when(kind == "revisit", F.col("source_page")).alias("refers_to"))
