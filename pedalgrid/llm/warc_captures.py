"""WARC archives of pages, and captures assembled from their records.

Writing: every page becomes a request, a response (or revisit) and a metadata record. The response
of a payload is the page with the smallest id; later pages with an equal payload become revisits.
Archives are written by Spark's text writer, whose line separator is the record separator, so they
lie wherever Spark can write.

Reading: the archives are parsed per file into records; response, request and metadata are joined
through WARC-Concurrent-To, one nested row per capture.

Defined results: a null payload is an empty one; line ends in a url are dropped; a null url becomes
``urn:page``. A null page_id comes after all others; a payload that only such pages hold has
responses alone. Rows that repeat id and payload are captures of their own, all of the same type.
Payloads below ``min_bytes`` are always stored. An empty table gives no captures.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pedalgrid.session import cut_lineage, fresh_path

#: A file is parsed in one piece; this bounds it.
RECORDS_PER_FILE = 15_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = (
    "record_type string, record_id string, concurrent_to string, target_uri string, digest string, "
    "payload string, payload_bytes long, http_head string, fields map<string,string>"
)

_HEX32, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(col: Column) -> Column:
    """The 160 bits in four pieces of ten hex digits, each eight base-32 digits."""
    hexed = F.sha1(col)
    pieces = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*pieces), _HEX32, _BASE32)


def _record(kind: str, uid: Column, headers: list[Column | str], block: Column) -> Column:
    lines = [
        F.lit("WARC/1.1"),
        F.lit(f"WARC-Type: {kind}"),
        F.concat(F.lit("WARC-Record-ID: <urn:uuid:"), uid, F.lit(">")),
        F.lit(f"WARC-Date: {DATE}"),
        *(F.lit(h) if isinstance(h, str) else h for h in headers),
        F.concat(F.lit("Content-Length: "), F.octet_length(block)),
        F.lit(""),
        block,
    ]
    return F.concat_ws("\r\n", *lines)


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in cuts))


def records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(value): the text of every record, three per page in a row."""
    own = pages.select(
        "page_id",
        F.coalesce(F.translate("url", "\r\n", ""), F.lit("urn:page")).alias("url"),
        F.coalesce("html", F.lit("")).alias("html"),
    ).withColumn("digest", sha1_base32(F.encode("html", "utf-8")))
    firsts = own.groupBy("digest").agg(F.min("page_id").alias("first"))
    known = own.join(firsts, "digest").withColumn("n", F.octet_length("html"))
    again = (
        F.col("first").isNotNull()
        & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first")))
        & (F.col("n") >= min_bytes)
    )
    row = F.monotonically_increasing_id().cast("string")  # written once, below
    made = known.withColumn("again", again).withColumn("row", row)
    ids = {
        kind: _uuid(F.lit(kind), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.col("digest"), F.col("row"))
        for kind in ("request", "response", "metadata")
    }
    target = F.concat(F.lit("WARC-Target-URI: "), F.col("url"))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"))
    beside = F.concat(F.lit("WARC-Concurrent-To: <urn:uuid:"), ids["response"], F.lit(">"))
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("n"),
        F.lit("\r\n\r\n"),
    )
    answer = "Content-Type: application/http;msgtype=response"
    stored = _record("response", ids["response"], [target, digest, answer], F.concat(head, F.col("html")))
    revisit = _record("revisit", ids["response"], [target, digest, f"WARC-Profile: {PROFILE}", answer], head)
    request = _record(
        "request",
        ids["request"],
        [target, beside, "Content-Type: application/http;msgtype=request"],
        F.concat(F.lit("GET "), F.col("url"), F.lit(" HTTP/1.1\r\n\r\n")),
    )
    field = lambda name, c: F.concat(F.lit(f"{name}: "), c.cast("string"))
    metadata = _record(
        "metadata",
        ids["metadata"],
        [target, beside, "Content-Type: application/warc-fields"],
        F.concat_ws(
            "\r\n",
            field("page-id", F.col("page_id")),
            field("payload-bytes", F.col("n")),
            F.when(F.col("again"), field("refers-to-page-id", F.col("first"))),
            F.lit(""),
        ),
    )
    return made.select(
        F.explode(F.array(request, F.when(F.col("again"), revisit).otherwise(stored), metadata)).alias("value")
    )


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, per_file: int = RECORDS_PER_FILE) -> str:
    (
        records(pages, min_bytes)
        .write.option("lineSep", "\r\n\r\n")
        .option("compression", "gzip")
        .option("maxRecordsPerFile", per_file)
        .text(path)
    )
    return path


def parse_records(data: bytes) -> Iterator[tuple]:
    """The records of one archive as rows of RECORD, whatever the order of their headers."""
    at = 0
    while True:
        while data[at : at + 2] == b"\r\n":
            at += 2
        if at >= len(data):
            return
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        block = data[end + 4 : end + 4 + int(head["content-length"])]
        at = end + 4 + int(head["content-length"])
        kind, digest = head["warc-type"], head.get("warc-payload-digest", "").removeprefix("sha1:") or None
        http, payload, size, fields = None, None, None, None
        if kind == "metadata":
            pairs = (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n") if x)
            fields = {k.strip(): v.strip() for k, _, v in pairs}
        else:
            start, _, body = block.partition(b"\r\n\r\n")
            http = start.decode("utf-8", "replace")
            if kind == "response":
                payload, size = body.decode("utf-8", "replace"), len(body)
                digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        ids = (head.get(h, "").strip("<>") or None for h in ("warc-record-id", "warc-concurrent-to"))
        yield (kind, *ids, head.get("warc-target-uri"), digest, payload, size, http, fields)


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in RECORD.split(", ")]
    for b in batches:
        for content in b["content"]:
            data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
            rows = []
            for r in parse_records(data):
                rows.append(r)
                if len(rows) == 512:
                    yield _frame(rows, names)
                    rows = []
            if rows:
                yield _frame(rows, names)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names, dtype=object)
    out["payload_bytes"] = pd.array(out["payload_bytes"], dtype="Int64")
    return out


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(_parse, RECORD)


def assemble(found: DataFrame) -> DataFrame:
    """One nested row per capture: record_id, target_uri, request, response, metadata."""
    kind = lambda *k: found.filter(F.col("record_type").isin(*k))
    answers = kind("response", "revisit").select(
        "record_id",
        "target_uri",
        F.struct("record_type", "digest", "payload", "payload_bytes", "http_head").alias("response"),
    )
    asked = kind("request").select(
        F.col("concurrent_to").alias("record_id"),
        F.struct(F.col("record_id").alias("id"), "http_head").alias("request"),
    )
    noted = kind("metadata").select(
        F.col("concurrent_to").alias("record_id"),
        F.struct(F.col("record_id").alias("id"), "fields").alias("metadata"),
    )
    return (
        answers.join(asked, "record_id", "left")
        .join(noted, "record_id", "left")
        .select("record_id", "target_uri", "request", "response", "metadata")
    )


def capture_digests(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    path = write_archives(pages, fresh_path(spark, "warc"))
    # Payloads are digested when an archive is parsed; the join needs the rest.
    found = cut_lineage(read_records(spark, path).withColumn("payload", F.lit(None).cast("string")), "records")
    noted = F.col("metadata.fields")
    number = lambda name, kind: F.element_at(noted, name).cast(kind)
    kind = dict(pages.dtypes)["page_id"]
    return assemble(found).select(
        number("page-id", kind).alias("page_id"),
        F.coalesce("response.payload_bytes", number("payload-bytes", "long")).alias("payload_bytes"),
        F.col("response.digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        number("refers-to-page-id", kind).alias("refers_to"),
    )


#: Base 32 in blocks of five hex digits, four digits each.
SQL = """
WITH payloads AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
firsts AS (SELECT h, min(page_id) AS first_id FROM payloads GROUP BY h)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT) + 1, 1)), '')
    AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM payloads JOIN firsts USING (h)
"""
