"""Decontamination, quality and language-model scores over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seasonframe.llm.common import table
from seasonframe.llm.decontamination import find_leaks
from seasonframe.llm.language_model import score_documents
from seasonframe.llm.quality import classify
from seasonframe.llm.queries import query

_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

OP3_SQL = f"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
p AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, k, k + 9), ' ') AS win
  FROM i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(k) WHERE len(w) > 0),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
x AS (
  SELECT doc_id, k, n, array_to_string(list_slice(w, k, k + n - 1), ' ') AS win
  FROM d, (SELECT DISTINCT n FROM p) AS s, unnest(range(1, len(w) - n + 2)) AS t(k)),
h AS (SELECT x.doc_id, x.k, x.n, p.item_id FROM x JOIN p ON x.win = p.win AND x.n = p.n),
a AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM h, unnest(range(k, k + n)) AS t(j) GROUP BY doc_id),
b AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(a.n_hit, 0) AS n_hit, coalesce(b.n_items, 0) AS n_items,
  sha256(coalesce(b.ids, '')) AS items_sha256, coalesce(a.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id)
"""


@query("op3_benchmark_decontamination", OP3_SQL)
def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


@query("op8_quality_classifier")
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


@query("op10_lm_scoring")
def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
