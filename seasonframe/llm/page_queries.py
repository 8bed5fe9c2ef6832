"""Article text and archives of pages over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seasonframe.common import work_dir
from seasonframe.llm.common import table
from seasonframe.llm.extraction import extract
from seasonframe.llm.queries import query
from seasonframe.llm.warc import read_archives, write_archives

@query("op4_html_extraction")
def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


OP9_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS hex FROM p),
f AS (SELECT hex, n, min(page_id) AS first FROM h GROUP BY hex, n),
bits AS (
  SELECT h.page_id, h.n, h.hex, f.first,
    array_to_string([ 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[CAST('0b' || substr(
      array_to_string([['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100',
        '1101','1110','1111'][strpos('0123456789abcdef', hex[k])] FOR k IN range(1, 41)], ''), 5 * g + 1, 5) AS INTEGER) + 1]
      FOR g IN range(0, 32)], '') AS digest
  FROM h JOIN f USING (hex, n))
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM bits
"""


@query("op9_warc", OP9_SQL)
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark)
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
