"""Content-addressed WARC archive.

Payload bytes are stored once, under their SHA-256; the records' header lines are stored as they are, one row for
each record.  Reading joins the two and gives every record back byte for byte; each stored payload is verified
against its key, length and SHA-1 first.  Both parts are Parquet tables in one folder; ``export`` writes plain
WARC files of the same records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerlake import session
from tickerlake.llm import common

#: Payloads of fewer bytes are never shared.
LEAST_SHARED = 0
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(value: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hex digits are four base32 digits."""
    digest = F.sha1(value)
    out = []
    for i in range(0, 40, 5):
        number = F.conv(F.substring(digest, i + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(BASE32), F.shiftright(number, 15 - 5 * k).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for k in range(4)]
    return F.concat(*out)


def headers(target: Column, record_id: Column, kind: Column, digest: Column, refers_to: Column, refers_uri: Column, length: Column) -> Column:
    """Header lines of a record, up to and with the empty line."""
    crlf = "\r\n"
    revisit = kind == "revisit"
    return F.concat(
        F.lit(f"WARC/1.1{crlf}WARC-Type: "), kind,
        F.lit(f"{crlf}WARC-Record-ID: <urn:page:"), record_id, F.lit(f">{crlf}WARC-Date: {DATE}"),
        F.when(target.isNull(), "").otherwise(F.concat(F.lit(f"{crlf}WARC-Target-URI: "), F.regexp_replace(target, "[\r\n]", " "))),
        F.lit(f"{crlf}WARC-Payload-Digest: sha1:"), digest,
        F.when(revisit, F.concat(
            F.lit(f"{crlf}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{crlf}WARC-Refers-To: <urn:page:"), refers_to, F.lit(">"),
            F.when(refers_uri.isNull(), "").otherwise(F.concat(F.lit(f"{crlf}WARC-Refers-To-Target-URI: "), F.regexp_replace(refers_uri, "[\r\n]", " "))),
        )).otherwise(""),
        F.lit(f"{crlf}Content-Type: text/html{crlf}Content-Length: "), F.when(revisit, "0").otherwise(length.cast("string")), F.lit(crlf * 2),
    )


def write_archive(pages: DataFrame, path: str, least_shared: int = LEAST_SHARED) -> None:
    """Writes ``path``/payloads (key, payload) and ``path``/records (page_id, key, headers).

    pages: page_id, url, html (further columns are ignored); a null html is empty.  Of records with equal payloads of
    at least ``least_shared`` bytes that with the largest page_id is the response, the others revisit it; smaller
    payloads are stored once too, but all their records are responses.  Repeated rows of a page give repeated
    records of one kind; a page without a page_id is a response only if no other has its payload.
    """
    body = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("payload")).withColumn("key", F.sha2("payload", 256))
    rows.groupBy("key").agg(F.first("payload").alias("payload")).write.parquet(f"{path}/payloads")
    named = rows.select("page_id", "url", "key", base32_sha1(F.col("payload")).alias("digest"), F.length("payload").cast("long").alias("length"))
    first = named.groupBy("key").agg(F.max_by(F.struct(F.col("page_id").alias("response"), F.col("url").alias("response_url")), F.struct("page_id", "url")).alias("r")).select("key", "r.*")
    shared = F.col("page_id").eqNullSafe(F.col("response")) | (F.col("length") < least_shared)
    kind = F.when(shared, "response").otherwise("revisit")
    text = headers(F.col("url"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), kind, F.col("digest"), F.coalesce(F.col("response").cast("string"), F.lit("none")), F.col("response_url"), F.col("length"))
    named.join(first, "key").select("page_id", "key", text.alias("headers")).write.parquet(f"{path}/records")


def field(name: str) -> Column:
    """A header's value, null where the record has no such header."""
    found = F.regexp_extract(F.col("headers"), rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.nullif(found, F.lit(""))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record with its payload: (page_id, record_type, target, refers_to, payload_digest, payload_bytes, payload, headers).

    The fields are parsed from the header lines.  A stored payload that does not give its key, or a record whose
    payload is missing or of another digest or length, fails the reading.
    """
    records = spark.read.schema("page_id long, key string, headers string").parquet(f"{path}/records")
    stored = spark.read.schema("key string, payload binary").parquet(f"{path}/payloads")
    stored = stored.select("key", "payload", F.length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("found"), (F.sha2("payload", 256) == F.col("key")).alias("sound"))
    both = records.join(stored, "key", "left").withColumns({"record_type": field("WARC-Type"), "target": field("WARC-Target-URI"), "digest": field("WARC-Payload-Digest"), "refers": field("WARC-Refers-To"), "content": field("Content-Length").cast("long")})
    whole = F.col("sound") & (F.concat(F.lit("sha1:"), F.col("found")) == F.col("digest")) & (F.col("content") == F.when(F.col("record_type") == "revisit", 0).otherwise(F.col("payload_bytes")))
    digest = F.when(F.coalesce(whole, F.lit(False)), F.substring("digest", 6, 32)).otherwise(F.raise_error(F.concat(F.lit("damaged record of page "), F.col("page_id").cast("string"))).cast("string"))
    return both.select(
        F.regexp_extract("headers", r"WARC-Record-ID: <urn:page:(-?[0-9]+)>", 1).try_cast("long").alias("page_id"),
        "record_type", "target", F.regexp_extract("refers", r"<urn:page:(-?[0-9]+)>", 1).try_cast("long").alias("refers_to"),
        digest.alias("payload_digest"), "payload_bytes", "payload", "headers",
    )


def export(records: DataFrame, path: str) -> None:
    """Plain WARC files: header lines, the payload of responses, and the two line ends that close a record."""
    body = F.when(F.col("record_type") == "revisit", "").otherwise(F.col("payload").cast("string"))
    records.select(F.concat("headers", body)).write.option("lineSep", "\r\n\r\n").text(path)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = session.work_dir(spark, "warc")
    write_archive(common.table(spark, sf_dir, "pages"), path)
    return read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_DIGITS = " || ".join(f"substr('{BASE32}', ((('0x' || substr(hash, {5 * (i // 4) + 1}, 5))::BIGINT >> {15 - 5 * (i % 4)}) & 31)::INT + 1, 1)" for i in range(32))
ORACLE = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hash FROM pages),
f AS (SELECT *, max(page_id) OVER (PARTITION BY hash) AS response FROM p)
SELECT page_id, payload_bytes, {_DIGITS} AS payload_digest, CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> response THEN response END AS refers_to FROM f
"""
