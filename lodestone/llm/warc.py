"""Content-addressed WARC archive.

Two stores in the shared folder: payloads, each once and compressed, under the SHA-256 digest of its
bytes; and
record headers, exactly as they stand in the archive, with the digest of their payload. Records
are read back by joining the two; each payload is hashed again and must give its address.

Of records with equal payloads of at least ``LEAST_BYTES`` bytes the one with the smallest page_id
is a response, the others are revisits that name it; smaller ones are all responses.

Nulls: a null html is an empty payload; a null url is written as an empty target; a null page_id
sorts last and is written as an empty id. Of repeated rows with the smallest page_id one is the
response and the rest revisit it. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_ids, stored, utf8

LEAST_BYTES = 0
DATE = "2024-01-01T00:00:00Z"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def header_of(page_id, url, kind: str, digest: str, length: int, refers_to) -> bytes:
    """The header block of a record; of a revisit the block is empty, and the full payload's length is kept beside."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>", f"WARC-Payload-Length: {length}"]
    lines += ["Content-Type: text/html", f"Content-Length: {0 if kind == 'revisit' else length}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def fields_of(header: bytes) -> dict[str, str]:
    lines = header.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0]!r}")
    return dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:] if line)


KEYS = "rid long, page_id long, url string, sha256 binary, sha1 string, n long"


def keyed(pages: DataFrame) -> DataFrame:
    """Digests and length of each page's payload; without the payload."""
    names = [x.split()[0] for x in KEYS.split(", ")]

    def run(batches):
        ids = row_ids()
        for batch in batches:
            payloads = [v.as_py() for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([next(ids) for _ in payloads], pa.int64()), batch.column(0), batch.column(1), pa.array([hashlib.sha256(p).digest() for p in payloads], pa.binary()), pa.array([sha1_base32(p) for p in payloads], pa.string()), pa.array(list(map(len, payloads)), pa.int64())], names
            )

    return pages.mapInArrow(run, KEYS)


def write_archive(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> tuple[DataFrame, DataFrame]:
    """The stores of headers (header, sha256) and payloads (sha256, payload) for rows of page_id, url and html."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), utf8("html").alias("payload"))
    keys = stored(keyed(pages), "warc-keys")
    firsts = keys.groupBy("sha256").agg(F.min(F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "rid")).alias("one"), F.count("*").alias("copies"))
    copied = stored(firsts.filter("copies > 1").select(F.col("sha256").alias("same"), F.col("one.page_id").alias("first_id"), F.col("one.rid").alias("first_rid")), "warc-copied")
    told = keys.join(copied, keys["sha256"] == copied["same"], "left")

    def heads(batches):
        for batch in batches:
            rows = [header_of(p, u, "revisit" if again else "response", d, n, r) for p, u, d, n, again, r in zip(*(batch.column(k).to_pylist() for k in ("page_id", "url", "sha1", "n", "again", "first_id")), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column("sha256")], ["header", "sha256"])

    again = (F.col("first_rid") != F.col("rid")) & (F.col("n") >= least_bytes)
    headers = stored(told.select("page_id", "url", "sha1", "n", F.coalesce(again, F.lit(False)).alias("again"), "first_id", "sha256").mapInArrow(heads, "header binary, sha256 binary"), "warc-headers")

    def packed(batches):
        for batch in batches:
            found = [v.as_py() for v in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(p).digest() for p in found], pa.binary()), pa.array([zlib.compress(p, 1) for p in found], pa.binary())], ["sha256", "payload"])

    # Any of the copies will do, as they are equal; copies within a task meet before the exchange.
    every = pages.select("payload").mapInArrow(packed, "sha256 binary, payload binary")
    payloads = stored(every.groupBy("sha256").agg(F.first("payload").alias("payload")), "warc-payloads")
    return headers, payloads


def read_archive(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """Whole records rebuilt by the join: header, and the full payload (of a revisit that of its response)."""

    def unpacked(batches):
        for batch in batches:
            found = []
            for address, payload in zip(batch.column(1), batch.column(2), strict=True):
                found.append(zlib.decompress(payload.as_py()))
                if hashlib.sha256(found[-1]).digest() != address.as_py():
                    raise ValueError(f"payload at {address.as_py().hex()} has other bytes")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["header", "payload"])

    return headers.join(payloads, "sha256").select("header", "sha256", "payload").mapInArrow(unpacked, "header binary, payload binary")


def op10_warc_archive(pages: DataFrame) -> DataFrame:
    def parsed(batches):
        for batch in batches:
            out = [[] for _ in range(5)]
            for header, payload in zip(batch.column(0), batch.column(1), strict=True):
                fields, body = fields_of(header.as_py()), payload.as_py()
                number = lambda name: int(x) if (x := fields.get(name, "<urn:page:>")[len("<urn:page:") : -1]) else None  # noqa: B023,E731
                kind, digest = fields["WARC-Type"], sha1_base32(body)
                told = int(fields["WARC-Payload-Length" if kind == "revisit" else "Content-Length"])
                if told != len(body) or fields["WARC-Payload-Digest"] != f"sha1:{digest}":
                    raise ValueError("a record and its payload don't agree")
                for column, value in zip(out, (number("WARC-Record-ID"), len(body), digest, kind, number("WARC-Refers-To")), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return read_archive(*write_archive(pages)).mapInArrow(parsed, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


#: Base32 of a SHA-1: eight groups of five hexadecimal digits, each four letters.
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT *, octet_length(encode(html)) AS n, array_to_string(list_transform(range(0, 32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1, 1)), '') AS digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first_id FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN n >= {LEAST_BYTES} AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {LEAST_BYTES} AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
