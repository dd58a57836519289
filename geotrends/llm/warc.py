"""Content-addressed web archive.

``write_archive`` stores each distinct payload once, under its SHA-256, and the
exact header bytes of every record apart from it. ``read_archive`` checks every
stored payload against its digests and joins headers and payloads back to the
original records. Both parts are Parquet tables in one folder.
``warc_records`` gives the records as they stand in a WARC 1.1 file.

Payloads are reduced inside each task before they are shuffled, so a payload
that a third of the rows share is sent once per task. Joins carry digests and
lengths only, never payloads, except where whole records are asked for.
"""

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

CRLF = "\r\n"
# Fixed values of WARC 1.1: the profile of revisits told by equal payloads.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# The date of pages whose time of capture is not known.
NO_DATE = "1970-01-01T00:00:00Z"


@F.arrow_udf(StringType())
def base32_of_hex(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Bare upper-case base32 of digests given in hex."""
    for batch in batches:
        yield pa.array([None if x is None else base64.b32encode(bytes.fromhex(x)).decode() for x in batch.to_pylist()])


def _field(name: str, value: Column) -> Column:
    """A header line; line ends inside a value are percent-encoded, a null value leaves the line out."""
    safe = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit(CRLF)), F.lit(""))


def _record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page.cast("string"), F.lit(">"))


def page_records(pages: DataFrame, min_bytes: int = 0, date: Column | str = NO_DATE) -> tuple[DataFrame, DataFrame]:
    """WARC records of pages (page_id, url, html): headers (header, sha256) and payloads (sha256, payload).

    The payload is the html in UTF-8, null html is empty. Of equal payloads of
    at least ``min_bytes`` bytes the one with the smallest page_id is a
    response and the others refer to it as revisits; smaller payloads are all
    responses. Rows that repeat the smallest page_id with the same payload are
    responses as well. A null page_id has a record id made of its payload's digest
    and url, and is never the smallest unless there is no other. Rows that repeat a
    page_id repeat its record id. ``date`` is the time of capture, a text such as
    ``NO_DATE`` or a column of ``pages`` with such texts (null: ``NO_DATE``). A
    revisit's block is empty, so its Content-Length is 0; the length of the
    payload follows from the digest. Other columns are left out.
    """
    rows = pages.select(
        "page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"),
        F.coalesce(F.lit(date) if isinstance(date, str) else date, F.lit(NO_DATE)).alias("date"),
    ).withColumns({"sha256": F.sha2("payload", 256), "sha1": F.sha1("payload"), "n_bytes": F.length("payload")})
    first = rows.groupBy("sha256").agg(F.min("page_id").alias("first_id"))
    heads = rows.select("page_id", "url", "date", "sha256", "sha1", "n_bytes").join(first, "sha256")
    revisit = (F.col("n_bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    unnamed = F.concat(F.lit("<urn:sha256:"), F.sha2(F.concat("sha256", F.coalesce("url", F.lit(""))), 256), F.lit(">"))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _field("WARC-Record-ID", F.coalesce(_record_id(F.col("page_id")), unnamed)),
        _field("WARC-Date", F.col("date")),
        _field("WARC-Target-URI", F.col("url")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_of_hex("sha1"))),
        _field("WARC-Refers-To", F.when(revisit, _record_id(F.col("first_id")))),
        _field("WARC-Profile", F.when(revisit, SAME_PAYLOAD)),
        _field("Content-Type", F.lit("text/html; charset=utf-8")),
        _field("Content-Length", F.when(revisit, "0").otherwise(F.col("n_bytes").cast("string"))),
        F.lit(CRLF),
    )
    return heads.select(F.encode(header, "UTF-8").alias("header"), "sha256"), rows.select("sha256", "payload")


def write_archive(headers: DataFrame, payloads: DataFrame, folder: str) -> None:
    """Store headers (header, sha256) as they are and each payload of (sha256, payload) once.

    A digest that does not belong to its payload stops the job.
    """
    checked = payloads.where(
        F.when(F.sha2("payload", 256) == F.col("sha256"), True).otherwise(F.raise_error(F.lit("wrong digest")).cast("boolean"))
    )
    once = checked.groupBy("sha256").agg(F.first("payload").alias("payload"))
    once.write.option("compression", "zstd").parquet(f"{folder}/payloads")
    headers.write.option("compression", "zstd").parquet(f"{folder}/headers")


def stored_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """(sha256, payload, n_bytes, digest) of each stored payload, recomputed from its bytes.

    A payload that no longer has the digest it is stored under stops the job.
    """
    stored = spark.read.schema("sha256 string, payload binary").parquet(f"{folder}/payloads")
    whole = F.when(F.sha2("payload", 256) == F.col("sha256"), F.length("payload").cast("bigint")).otherwise(
        F.raise_error(F.concat(F.lit("damaged payload "), "sha256")).cast("bigint")
    )
    return stored.select("sha256", "payload", whole.alias("n_bytes"), base32_of_hex(F.sha1("payload")).alias("digest"))


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """A row per record, from its header and the checked payload, without the payload's bytes.

    Columns: page_id, url, payload_bytes, payload_digest, record_type, refers_to.
    A header whose digest is not that of its payload stops the job.
    """
    headers = spark.read.schema("header binary, sha256 string").parquet(f"{folder}/headers")
    text = F.decode("header", "UTF-8")

    def value(name: str, pattern: str = "([^\r\n]*)") -> Column:
        found = F.regexp_extract(text, f"\r\n{name}: {pattern}\r\n", 1)
        return F.when(text.contains(f"{CRLF}{name}: "), found)

    page = "<urn:page:(-?[0-9]+)>"
    parsed = headers.select(
        value("WARC-Record-ID", page).try_cast("bigint").alias("page_id"),
        value("WARC-Target-URI").alias("url"),
        value("WARC-Payload-Digest", "sha1:([A-Z2-7]+)").alias("payload_digest"),
        value("WARC-Type").alias("record_type"),
        value("WARC-Refers-To", page).try_cast("bigint").alias("refers_to"),
        "sha256",
    )
    stored = stored_payloads(spark, folder).select("sha256", F.col("n_bytes").alias("payload_bytes"), "digest")
    same = F.when(F.col("payload_digest") == F.col("digest"), F.col("payload_digest")).otherwise(
        F.raise_error(F.lit("a header names another payload"))
    )
    return parsed.join(stored, "sha256").select(
        "page_id", "url", "payload_bytes", same.alias("payload_digest"), "record_type", "refers_to"
    )


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """The original records: exact header and payload bytes of each."""
    headers = spark.read.schema("header binary, sha256 string").parquet(f"{folder}/headers")
    return headers.join(stored_payloads(spark, folder).where("n_bytes is not null"), "sha256").select("header", "payload")


def warc_records(spark: SparkSession, folder: str) -> DataFrame:
    """(record binary) of each record as it stands in a WARC file: header, block and two line ends.

    A response's block is its payload; a revisit has none, so its payload is not read.
    """
    headers = spark.read.schema("header binary, sha256 string").parquet(f"{folder}/headers")
    empty = F.decode("header", "UTF-8").contains(f"{CRLF}Content-Length: 0{CRLF}")
    end = F.encode(F.lit(CRLF * 2), "UTF-8")
    payloads = stored_payloads(spark, folder).where("n_bytes is not null").select("sha256", "payload")
    full = headers.where(~empty).join(payloads, "sha256").select(F.concat("header", "payload", end).alias("record"))
    return full.unionByName(headers.where(empty).select(F.concat("header", end).alias("record")))
