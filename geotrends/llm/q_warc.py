"""Query of the web archive."""

from pyspark.sql import DataFrame, SparkSession

from geotrends.llm.registry import query, table
from geotrends.llm.shared_store import new_folder
from geotrends.llm.warc import page_records, read_index, write_archive

# Base32 of the 40 hex digits of a SHA-1: five digits are four characters.
SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (
  SELECT page_id, sha1(html) AS hex, octet_length(encode(html)) AS payload_bytes FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS BIGINT) >> (5 * (3 - i % 4))) & 31 AS INTEGER), 1)), '')
    AS payload_digest,
  CASE WHEN page_id = min(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> min(page_id) OVER w THEN min(page_id) OVER w END AS refers_to
FROM d WINDOW w AS (PARTITION BY hex)
"""


@query("op3_warc", SQL)
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record per page, written to an archive and read back."""
    folder = new_folder(spark, "warc")
    write_archive(*page_records(table(spark, sf_dir, "pages")), folder)
    return read_index(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
