"""Operator 9: content-addressed WARC archive.

Records are cut at the end of their header.  Payload bytes are stored once
under their SHA-256 digest; the exact header bytes of every record are kept in
a table of their own, with the digest they claim checked against the bytes.
Joining the two tables on the digest gives back the original records.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelume.llm.storage import dropped, row_id, written

_END = "\r\n\r\n"


class Archive(NamedTuple):
    """``headers`` (uid, key columns, header, trailer, digest, verified) and ``payloads`` (digest, payload)."""

    headers: DataFrame
    payloads: DataFrame


def page_record() -> Column:
    """A WARC response record of page_id, url and html, as bytes; nulls count as empty."""
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(F.col("url").cast("string"), F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha256:"),
        F.sha2(html, 256),
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length(html).cast("string"),
        F.lit(_END),
    )
    return F.concat(header.cast("binary"), html, F.lit(_END).cast("binary"))


#: Bytes of a record in which its header end is looked for first; only records without one there are searched whole.
HEAD_BYTES = 1 << 16


def _header_end(raw: Column) -> Column:
    """Place of the first blank line of each record, 0 without one."""
    near = F.locate(_END, F.decode(F.substring(raw, 1, HEAD_BYTES), "ISO-8859-1"))
    return F.when((near > 0) | (F.octet_length(raw) <= HEAD_BYTES), near).otherwise(F.locate(_END, F.decode(raw, "ISO-8859-1")))


def store(records: DataFrame, record: str = "record") -> Archive:
    """Write the two tables of an archive of ``records``; its other columns go with the headers.

    The header ends with the first blank line.  The payload has as many bytes
    as Content-Length says, or all there are if they are fewer, and the trailer
    is whatever follows it; without a usable Content-Length the trailer is the
    blank line that ends the record, if it is there.  A record without a header
    end, or an empty one, is all header with an empty payload; a null record
    has neither.  The records are cut and numbered once, in a table that is
    deleted when both tables of the archive are made; of records with equal
    payloads the first in it gives the bytes.
    """
    others = [c for c in records.columns if c != record]
    raw = F.col(f"`{record}`")
    cut = records.select(row_id().alias("uid"), F.struct(*[F.col(f"`{c}`") for c in others]).alias("key"), raw.alias("raw"), _header_end(raw).alias("at"))
    size = F.octet_length("raw")
    split = cut.select("uid", "key", "raw", F.when(F.col("at") == 0, size).otherwise(F.col("at") + 3).alias("head"))
    headed = split.select("uid", "key", "raw", "head", F.expr("substring(raw, 1, head)").alias("header"))
    text = F.decode("header", "ISO-8859-1")
    length = F.regexp_extract(text, r"(?i)\r\nContent-Length:[ \t]*(\d{1,18})[ \t]*\r\n", 1)
    left = size - F.col("head")
    closed = F.when((left >= 4) & (F.substring("raw", -4, 4) == F.lit(_END).cast("binary")), left - 4).otherwise(left)
    body = F.when(length == "", closed).otherwise(F.least(F.when(length != "", length).cast("bigint"), left.cast("bigint"))).cast("int")
    claim = F.regexp_extract(text, r"(?i)\r\nWARC-Payload-Digest: sha256:([0-9a-f]{64})\r\n", 1)
    sized = headed.select("uid", "key", "raw", "head", "header", body.alias("body"), claim.alias("claim"))
    parts = sized.select(
        "uid",
        "key",
        "header",
        F.expr("substring(raw, head + body + 1, octet_length(raw))").alias("trailer"),
        F.expr("substring(raw, head + 1, body)").alias("payload"),
        "claim",
    )
    digest = F.sha2("payload", 256)
    parts = written(parts.withColumn("digest", F.unhex(digest)).withColumn("verified", F.when(F.col("claim") == "", None).otherwise(F.col("claim") == digest)).drop("claim"), "warc-parts")
    headers = written(parts.drop("payload"), "warc-headers")
    repeats = written(_repeats(headers), "warc-repeats")
    payloads = written(parts.filter("payload is not null").join(repeats, "uid", "left_anti").select("digest", "payload"), "warc-payloads")
    dropped(parts)
    dropped(repeats)
    return Archive(headers, payloads)


def _repeats(headers: DataFrame) -> DataFrame:
    """uid of every record whose payload an earlier record has.

    Only digests are shuffled, reduced before that, and the numbers are joined
    by number, so no digest is hot.  As the result is a table of a size that is
    known, the join that leaves these records out broadcasts it if it is small,
    and payloads cross the network only beyond that.
    """
    seen = headers.filter("digest is not null")
    return seen.select("uid").join(seen.groupBy("digest").agg(F.min("uid").alias("uid")).select("uid"), "uid", "left_anti")


def rebuild(archive: Archive) -> DataFrame:
    """(uid, key, record, digest, verified) of every stored record, byte for byte.

    ``verified`` says that the stored bytes have the digest they are stored
    under and that the header claims; it is null for a header without a claim.
    """
    sound = archive.payloads.withColumn("sound", F.unhex(F.sha2("payload", 256)) == F.col("digest"))
    joined = archive.headers.join(sound, "digest", "left")
    return joined.select("uid", "key", F.concat("header", "payload", "trailer").alias("record"), "digest", (F.col("verified") & F.col("sound")).alias("verified"))


def archive_pages(pages: DataFrame) -> DataFrame:
    """(page_id, record, payload_sha256, verified) of every row of ``pages``, after a trip through the archive."""
    out = rebuild(store(pages.select("page_id", page_record().alias("record"))))
    return out.select("key.page_id", F.col("record").cast("string").alias("record"), F.lower(F.hex("digest")).alias("payload_sha256"), "verified")


def pages_sql() -> str:
    """The same as DuckDB SQL, straight from the pages."""
    crlf = "chr(13) || chr(10)"
    return (
        "with p as (select page_id, coalesce(url, '') as u, coalesce(html, '') as h from pages) select page_id, "
        f"'WARC/1.1' || {crlf} || 'WARC-Type: response' || {crlf} || 'WARC-Record-ID: <urn:page:' || coalesce(cast(page_id as varchar), '') || '>' || {crlf} || 'WARC-Target-URI: ' || u || {crlf} "
        f"|| 'WARC-Payload-Digest: sha256:' || sha256(h) || {crlf} || 'Content-Type: text/html; charset=utf-8' || {crlf} || 'Content-Length: ' || octet_length(encode(h)) || {crlf} || {crlf} "
        f"|| h || {crlf} || {crlf} as record, sha256(h) as payload_sha256, true as verified from p"
    )
