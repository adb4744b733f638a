"""WARC archives written by Spark's own text writer, and read back by boundary-chain verification.

Reading: each archive's candidates are all places that hold the record magic at the file's start or after a record end, which every
record has before it; each candidate's header gives the offset of its successor. So no two candidates' headers overlap. Pointer jumping from the file's start (doubling, log2 of the number of candidates rounds) keeps the reachable
candidates only, so that magic inside a payload, even a whole well-formed record, is never taken for a record.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm.common import discard, fresh_path, materialize, null_key, one

MAGIC = re.compile(rb"(?:\A|(?<=\r\n\r\n))WARC/1\.[01]\r\n")
CRLF = "\r\n"
SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, digest_ok boolean, record_offset long"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: each 40 bits are 8 digits of base 32, mapped to the alphabet of RFC 4648."""
    hexed = F.sha1(payload)
    quarter = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*quarter), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _revisits(pages: DataFrame, min_payload: int) -> DataFrame:
    """(row key, smallest page_id) of rows whose payload a smaller page_id has too. Rows hold digests, not payloads.

    Groups of one are dropped before the join back, and a group that holds a third of all rows is a key of that join that
    adaptive execution can split.
    """
    rows = pages.select("page_id", F.sha2("payload", 256).alias("h"), F.octet_length("payload").alias("n")).where(F.col("n") >= min_payload).drop("n")
    first = rows.groupBy("h").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "first")
    later = rows.join(first, "h").where("first is not null and (page_id is null or page_id > first)")
    return later.select(F.concat(null_key(F.col("page_id")), F.lit(":"), "h").alias("row_key"), "first").distinct()


def write_warc(pages: DataFrame, path: str, *, min_payload: int = 0, records_per_file: int = 1000, large: int = 1_000_000) -> None:
    """One record per row of `pages` (page_id, url, html): response, or revisit of the smallest page_id with an equal payload.

    Null html is an empty payload; null url is empty; a null page_id sorts last. Rows that repeat both page_id and payload are
    each a response if the id is the smallest one. An empty table gives no records. Payloads below `min_payload` bytes are
    never revisits. The records are strings that Spark writes with the record end of the format as line separator, so any
    file system that Spark writes to will do, and a lost task is written again. Archives hold `records_per_file` records at most;
    pages of more than `large` bytes have archives of their own, so an archive stays near `records_per_file` x `large` bytes.
    """
    source = one(pages, "page_id", "url", "html").select(F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("payload"))
    revisits = materialize(_revisits(source, min_payload), "warc-revisits")  # its size is then known: Catalyst broadcasts it only if small
    rows = source.withColumn("row_key", F.concat(null_key(F.col("page_id")), F.lit(":"), F.sha2("payload", 256))).join(revisits, "row_key", "left")
    again, n = F.col("first").isNotNull(), F.octet_length("payload")
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), n.cast("string"), F.lit(CRLF * 2))
    block = F.when(again, http).otherwise(F.concat(http, "payload"))
    head = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), page, F.lit(">")),
        F.lit("WARC-Date: 2024-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", "[\\r\\n]", "")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32_sha1(F.col("payload"))),
        F.concat(F.lit("WARC-Payload-Length: "), n.cast("string")),
        F.when(again, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("first").cast("string"), F.lit(">"))),
        F.when(again, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    record = F.concat(F.concat_ws(CRLF, *head), F.lit(CRLF * 2), block)
    for name, chosen, most in (("many", n <= large, records_per_file), ("single", n > large, 1)):
        rows.where(chosen).select(record.alias("value")).write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", most).text(f"{path}/{name}")
    discard(revisits)


def reachable(offsets: np.ndarray, successors: np.ndarray) -> np.ndarray:
    """Which candidates the chain from offset 0 meets. offsets: ascending; a successor that is no candidate ends the chain."""
    n = len(offsets)
    marked = np.zeros(n + 1, bool)
    if not n or offsets[0] != 0:
        return marked[:n]
    at = np.searchsorted(offsets, successors)
    jump = np.append(np.where((at < n) & (offsets[np.minimum(at, n - 1)] == successors), at, n), n)
    marked[0] = True
    for _ in range(max(1, int(n).bit_length())):
        marked[jump[marked]] = True
        jump = jump[jump]
    return marked[:n]


def candidates(data: bytes) -> tuple[np.ndarray, np.ndarray, list[dict[str, str]]]:
    """Offsets at which a header stands, the offsets of their successors (-1 if the header or the record end is broken), headers."""
    offsets, successors, headers = [], [], []
    for m in MAGIC.finditer(data):
        end = data.find(b"\r\n\r\n", m.end())
        fields, succ = {}, -1
        if end >= 0:
            for line in data[m.end() : end].decode("utf-8", "replace").split("\r\n"):
                name, _, value = line.partition(":")
                fields[name.strip().lower()] = value.strip()
            length = fields.get("content-length", "")
            if length.isascii() and length.isdigit():
                succ = end + 4 + int(length) + 4
                succ = succ if succ <= len(data) and data[succ - 4 : succ] == b"\r\n\r\n" else -1
        offsets.append(m.start())
        successors.append(succ)
        headers.append(fields | {"": str(end + 4)})
    return np.array(offsets, np.int64), np.array(successors, np.int64), headers


def records(data: bytes) -> Iterator[tuple]:
    """The records of one archive, as rows of SCHEMA; digests and lengths of responses are taken from the bytes read."""

    def number(value: str | None) -> int | None:
        m = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
        return int(m[1]) if m else None

    offsets, successors, headers = candidates(data)
    for i in np.flatnonzero(reachable(offsets, successors) & (successors > 0)).tolist():
        h = headers[i]
        block = data[int(h[""]) : int(successors[i]) - 4]
        kind, said = h.get("warc-type"), h.get("warc-payload-digest", "").removeprefix("sha1:")
        if kind == "response":
            payload = block[block.find(b"\r\n\r\n") + 4 :]
            size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        else:
            size, digest = int(h.get("warc-payload-length") or 0), said
        yield number(h.get("warc-record-id")), h.get("warc-target-uri"), kind, number(h.get("warc-refers-to")), size, digest, digest == said, int(offsets[i])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Rows of SCHEMA for each record reachable from its archive's start; a broken record ends its archive's chain.

    Archives are read whole, one at a time in a task, by Spark's binary reader: keep them below 2 GB, as write_warc does. A folder
    without archives, at any depth, gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
        for batch in batches:
            for i in range(batch.num_rows):
                rows = list(records(batch.column(0)[i].as_buffer().to_pybytes()))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[f.split()[1]]) for k, f in enumerate(SCHEMA.split(", "))], names)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(run, SCHEMA)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write `pages` to archives in the shared folder and return what reading them gives."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_warc(pages, path, **options)
    return read_warc(spark, path)


#: Base 32 is written by fives of hexadecimal digits, twenty bits or four letters each. pages has no repeated page_id.
ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex FROM p),
d AS (SELECT page_id, payload_bytes, list_transform(range(8), lambda i: ('0x' || substr(hex, (5 * i + 1)::INTEGER, 5))::BIGINT) AS fives FROM h),
b AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((fives[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31)::INTEGER + 1, 1)), '') AS payload_digest FROM d),
r AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM b)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN page_id <> first_id THEN first_id END AS refers_to, true AS digest_ok FROM r
"""
