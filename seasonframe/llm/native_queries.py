"""Chat formatting and source mixing over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seasonframe.llm.chat import format_chat, read_loss, read_turns
from seasonframe.llm.common import table
from seasonframe.llm.mixing import mix
from seasonframe.llm.queries import query

OP1_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
    length(regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g')) AS text_chars,
    length(regexp_replace(role, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g')) AS role_chars
  FROM r)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), ''))
    AS loss_sha256,
  CAST(sum(text_chars + CASE WHEN before = role THEN 8 ELSE 24 + role_chars END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


@query("op1_chat_formatting", OP1_SQL)
def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    read = format_chat(rows).select(
        "conv_id", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("segments")).alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"))
    every = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(every.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s),
w AS (SELECT *, [5, 2, 1][place % 3 + 1] AS weight FROM p),
c AS (
  SELECT *, sum(source_size) OVER () AS total,
    coalesce(sum(source_size) OVER (ORDER BY CAST(source_size AS DOUBLE) / weight, place
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS met,
    sum(weight) OVER (ORDER BY CAST(source_size AS DOUBLE) / weight, place
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM w),
l AS (SELECT *, CAST(total - 3 * met AS DOUBLE) / CAST(rest AS DOUBLE) AS lev FROM c),
g AS (SELECT lev FROM l WHERE lev * weight <= CAST(3 * source_size AS DOUBLE) ORDER BY met, place LIMIT 1),
t AS (SELECT l.source, source_size, place, least(CAST(3 * source_size AS DOUBLE), weight * g.lev) AS target FROM l, g),
r AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, t.place,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY h, d.doc_id, d.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM r),
k AS (
  SELECT *, CASE WHEN size > 0 THEN whole + CASE WHEN before + size / 2 < target - whole * source_size AND whole < 3
    THEN 1 ELSE 0 END ELSE 0 END AS copies,
    least((before + size / 2) / target, 1.0) AS share FROM e)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies,
  CASE WHEN copies = 0 THEN NULL
    WHEN place % 3 = 0 THEN round(least(2 * share / (sqrt(2.25 - 2 * share) + 1.5), 1.0), 9)
    WHEN place % 3 = 1 THEN round(least(share, 1.0), 9)
    WHEN share * 0.875 <= 0.25 THEN round(2 * share * 0.875 / (sqrt(0.0625 + 2 * share * 0.875) + 0.25), 9)
    ELSE round(least(0.5 + 2 * (share * 0.875 - 0.25) / (sqrt(0.5625 + 4 * (share * 0.875 - 0.25)) + 0.75), 1.0), 9)
  END AS first_position
FROM k
"""


@query("op7_source_mixing", OP7_SQL)
def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id", "size", "source_size", "target", "taken", "copies",
        F.round(F.get("positions", F.lit(0)), 9).alias("first_position")).orderBy("first_position", "doc_id")
