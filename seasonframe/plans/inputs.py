"""Operator inputs derived from the given tables, each with the same definition as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(c: str):
    return F.col(c).cast(MONEY)


def facts(spark: SparkSession, d: str) -> DataFrame:
    """One row per order: entity = customer, season = year, week = month, team = priority."""
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("season"),
        F.month("o_orderdate").alias("week"), F.col("o_orderkey").alias("game"),
        F.col("o_orderpriority").alias("team"), F.col("o_orderstatus").alias("status"),
        F.to_date("o_orderdate").alias("day"), money("o_totalprice").alias("points"))


FACTS = """facts AS (
  SELECT o_custkey AS entity, year(o_orderdate)::BIGINT AS season, month(o_orderdate)::BIGINT AS week,
         o_orderkey AS game, o_orderpriority AS team, o_orderstatus AS status,
         o_orderdate::DATE AS day, o_totalprice::DECIMAL(18,2) AS points
  FROM orders)"""


def with_group(df: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    """Add the market segment and nation of the entity."""
    c = table(spark, d, "customer").select(
        F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("grp"),
        F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name"))
    return df.join(c, "entity")


GROUPED = FACTS + """, grouped AS (
  SELECT f.*, c_mktsegment AS grp, c_nationkey AS nation, c_name AS name
  FROM facts f JOIN customer ON c_custkey = entity)"""


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Line items summed by order."""
    li = table(spark, d, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("game")).agg(
        F.sum(money("l_quantity")).alias("qty"),
        F.sum(money("l_extendedprice")).alias("price"),
        F.sum(money("l_extendedprice") * F.col("l_discount").cast("decimal(4,2)")).alias("discounted"),
        F.sum(F.when(F.col("l_returnflag") == "R", money("l_quantity"))).alias("returned"),
        F.count(F.lit(1)).alias("n_lines"),
        F.min("l_suppkey").alias("first_supp"))


LINES = """lines AS (
  SELECT l_orderkey AS game, sum(l_quantity::DECIMAL(18,2)) AS qty,
         sum(l_extendedprice::DECIMAL(18,2)) AS price,
         sum(l_extendedprice::DECIMAL(18,2) * l_discount::DECIMAL(4,2)) AS discounted,
         sum(CASE WHEN l_returnflag = 'R' THEN l_quantity::DECIMAL(18,2) END) AS returned,
         count(*) AS n_lines, min(l_suppkey) AS first_supp
  FROM lineitem GROUP BY l_orderkey)"""


def season_rows(spark: SparkSession, d: str) -> DataFrame:
    """Entity-season totals used by the ranking operators."""
    joined = facts(spark, d).join(lines(spark, d), "game", "left")
    return joined.groupBy("entity", "season").agg(
        F.count(F.lit(1)).alias("games"), F.sum("points").alias("points"),
        F.coalesce(F.sum("qty"), F.lit(0)).cast(MONEY).alias("qty"),
        F.coalesce(F.sum("discounted"), F.lit(0)).cast("decimal(18,4)").alias("discounted"),
        F.sum("returned").cast(MONEY).alias("returned"))


SEASON = FACTS + ", " + LINES + """, season_rows AS (
  SELECT entity, season, count(*) AS games, sum(points) AS points,
         coalesce(sum(qty), 0)::DECIMAL(18,2) AS qty,
         coalesce(sum(discounted), 0)::DECIMAL(18,4) AS discounted,
         sum(returned)::DECIMAL(18,2) AS returned
  FROM facts LEFT JOIN lines USING (game) GROUP BY entity, season)"""


def matches(spark: SparkSession, d: str) -> DataFrame:
    """One match per order with lines: customer nation against the first supplier's nation."""
    f = with_group(facts(spark, d), spark, d).join(lines(spark, d), "game")
    s = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("first_supp"), F.col("s_nationkey").alias("away"))
    return f.join(s, "first_supp").select(
        "game", "season", "week", "day", F.col("nation").alias("home"), "away",
        F.col("qty").alias("home_score"), F.col("n_lines").alias("away_score"),
        "points", "qty", "n_lines")


MATCHES = GROUPED + ", " + LINES + """, matches AS (
  SELECT game, season, week, day, nation AS home, s_nationkey AS away, qty AS home_score,
         n_lines AS away_score, points, qty, n_lines
  FROM grouped JOIN lines USING (game) JOIN supplier ON s_suppkey = first_supp)"""


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Daily rank snapshot per user: the sum of values, its extremes and the last event type."""
    e = table(spark, d, "events")
    return e.groupBy(F.col("user_id").alias("player"), F.to_date("ts").alias("day")).agg(
        F.sum(money("value")).alias("total"), F.min(money("value")).alias("low"),
        F.max(money("value")).alias("high"),
        F.max_by("event_type", F.struct("ts", "event_id")).alias("grp"),
        F.count(F.lit(1)).alias("n"))


SNAPSHOTS = """snapshots AS (
  SELECT user_id AS player, ts::DATE AS day, sum(value::DECIMAL(18,2)) AS total,
         min(value::DECIMAL(18,2)) AS low, max(value::DECIMAL(18,2)) AS high,
         arg_max(event_type, (ts, event_id)) AS grp, count(*) AS n
  FROM events GROUP BY user_id, ts::DATE)"""


def stored_docs(spark: SparkSession, d: str) -> DataFrame:
    """Stored reports: the labelled documents; those of low quality were stored in a revised wording."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    text = F.when(F.col("quality") == 0, F.concat("text", F.lit(" (revised)"))).otherwise(F.col("text"))
    return docs.join(labels, "doc_id").select(
        "doc_id", text.alias("text"), "lang", "source", "quality", "toxic", F.sha2(text, 256).alias("hash"))


STORED = """stored AS (
  SELECT doc_id, CASE WHEN quality = 0 THEN text || ' (revised)' ELSE text END AS text, lang, source, quality, toxic,
         sha256(CASE WHEN quality = 0 THEN text || ' (revised)' ELSE text END) AS hash
  FROM documents JOIN labels USING (doc_id))"""


def feed_docs(spark: SparkSession, d: str) -> DataFrame:
    """Feed items: every document with the hash of its text."""
    return table(spark, d, "documents").select(
        "doc_id", "text", "lang", "source", "n_chars", F.sha2("text", 256).alias("hash"))


FEED = "feed AS (SELECT doc_id, text, lang, source, n_chars, sha256(text) AS hash FROM documents)"
