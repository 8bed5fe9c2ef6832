"""The prefix trie over all conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seasonframe.llm.common import table
from seasonframe.llm.prefix_trie import prefix_trie
from seasonframe.llm.queries import query

# crc32 by its definition: eight shifts for every digit of the id.
OP12_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (
  SELECT conv_id, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role, left(text, 16), md5(concat(length(role), ':', role, text))) AS own
  FROM t GROUP BY conv_id),
h AS (
  SELECT conv_id, own, conv_id - conv_id % 20 AS family, CAST(xor(list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda crc, ch: list_reduce(list_prepend(xor(crc, ch), CAST(range(8) AS BIGINT[])),
      lambda a, i: CASE WHEN a % 2 = 1 THEN xor(a // 2, CAST(3988292384 AS BIGINT)) ELSE a // 2 END)),
    CAST(4294967295 AS BIGINT)) % 4 AS BIGINT) AS h FROM o),
c AS (
  SELECT a.conv_id, list_concat(list_slice(coalesce(b.own, []), 1, a.h), list_slice(a.own, a.h + 1, len(a.own))) AS turns
  FROM h AS a LEFT JOIN h AS b ON b.conv_id = a.family),
p AS (SELECT conv_id, d, list_slice(turns, 1, d) AS path, len(turns) = d AS ends FROM c, unnest(range(0, len(turns) + 1)) AS u(d)),
n AS (
  SELECT d, path, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM p GROUP BY d, path),
k AS (SELECT d - 1 AS d, list_slice(path, 1, d - 1) AS path, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
m AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children,
    CASE WHEN n.d = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(n.path[n.d].t, '[^\x20\x09-\x0D]+')) END AS saved
  FROM n LEFT JOIN k ON n.d = k.d AND n.path = k.path),
s AS (
  SELECT u.d AS d, list_slice(path, 1, u.d) AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved
  FROM m, unnest(range(0, m.d + 1)) AS u(d) GROUP BY ALL)
SELECT m.conv_id, m.d AS depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
  CAST(s.saved AS BIGINT) AS saved_tokens, m.ends_sha256
FROM m JOIN s ON m.d = s.d AND m.path = s.path LEFT JOIN m AS q ON q.d = m.d - 1 AND q.path = list_slice(m.path, 1, m.d - 1)
"""


@query("op12_conversation_prefix_trie", OP12_SQL)
def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))
