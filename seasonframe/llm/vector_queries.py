"""Whitening and nearest neighbours over all embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seasonframe.llm.common import table
from seasonframe.llm.neighbours import nearest
from seasonframe.llm.queries import query
from seasonframe.llm.whitening import whiten


@query("op11_embedding_whitening")
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whiten(table(spark, sf_dir, "embeddings"))
    return found.select("*", F.posexplode("whitened").alias("_place", "_value")).select(
        "vec_id", (F.col("_place") + 1).alias("component"), "n",
        F.expr("try_cast(deviation AS bigint)").alias("deviation"),
        F.col("_value").alias("whitened"), F.get("explained", F.col("_place")).alias("explained"), "identity_error")


_DOT = "list_reduce(list_prepend(CAST(0 AS DOUBLE), list_transform(range(1, len({a}) + 1), lambda i: {a}[i] * {b}[i])), lambda s, p: s + p)"

OP13_SQL = f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (
  SELECT vec_id, e, sqrt({_DOT.format(a="e", b="e")}) AS n FROM v WHERE vec_id IS NOT NULL AND e IS NOT NULL
    AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, {_DOT.format(a="q.e", b="c.e")} / (q.n * c.n) AS score
  FROM ok AS q JOIN ok AS c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op13_nearest_neighbours", OP13_SQL)
def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
