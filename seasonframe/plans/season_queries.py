"""Queries of the season, team and weekly aggregates."""

from pyspark.sql import functions as F

from ..functions.scalars import ratio
from ..operators import aggregates as agg
from ..operators import joins
from .inputs import (
    FACTS, GROUPED, LINES, MATCHES, SEASON, facts, lines, matches, money, season_rows, table, with_group,
)
from .registry import query


@query("A1_season_totals", f"""
WITH {FACTS}, {LINES}, base AS (
  SELECT f.*, qty, price, discounted, returned, n_lines, (status = 'P')::INT AS pending,
         CASE WHEN status = 'P' THEN points END AS pending_points
  FROM facts f LEFT JOIN lines USING (game)),
t AS (
  SELECT entity, season, count(DISTINCT game) AS games, coalesce(sum(points), 0) AS points,
         coalesce(sum(qty), 0) AS qty, coalesce(sum(price), 0) AS price,
         coalesce(sum(returned), 0) AS returned, coalesce(sum(pending), 0) AS pending,
         coalesce(sum(pending_points), 0) AS pp,
         sum(points * n_lines)::DOUBLE / nullif(sum(n_lines), 0)::DOUBLE AS weighted_points,
         arg_max(team, (week, game)) AS last_team, arg_max(status, (week, game)) AS last_status
  FROM base GROUP BY entity, season),
f AS (SELECT entity, season, team, min((week, game)) AS first_seen FROM base GROUP BY ALL),
l AS (SELECT entity, season, string_agg(team, '|' ORDER BY first_seen) AS teams FROM f GROUP BY entity, season)
SELECT entity, season, games, points::DOUBLE AS points, qty::DOUBLE AS qty, price::DOUBLE AS price,
       returned::DOUBLE AS returned, pending::BIGINT AS pending,
       CASE WHEN pending > 0 THEN pp END::DOUBLE AS pending_points, weighted_points,
       last_team, last_status, teams,
       CASE WHEN qty <> 0 THEN round_even(price::DOUBLE / qty::DOUBLE, 3) END AS price_per_unit,
       CASE WHEN qty <> 0 THEN round_even(returned::DOUBLE * 100 / qty::DOUBLE, 3) END AS return_rate
FROM t JOIN l USING (entity, season)""")
def season_totals(spark, d):
    base = facts(spark, d).join(lines(spark, d), "game", "left").withColumns({
        "pending": (F.col("status") == "P").cast("int"),
        "pending_points": F.when(F.col("status") == "P", F.col("points"))})
    out = agg.season_totals(
        base, ["entity", "season"], ["week", "game"], "game",
        ["points", "qty", "price", "returned", "pending", "pending_points"], ["team", "status"], "team",
        null_unless={"pending_points": "pending"}, weighted={"weighted_points": ("points", "n_lines")},
        rounded={"points": 2})
    out = agg.with_ratios(out, {"price_per_unit": ("price", "qty", 1), "return_rate": ("returned", "qty", 100)})
    return out.withColumn("teams", F.array_join("teams", "|"))


@query("A2_ratio", f"""
WITH {LINES} SELECT game,
  CASE WHEN discounted <> 0 THEN round_even(price::DOUBLE / discounted::DOUBLE, 3) END AS price_per_discount,
  CASE WHEN price <> 0 THEN round_even(discounted::DOUBLE * 100 / price::DOUBLE, 3) END AS discount_percent
FROM lines""")
def ratios(spark, d):
    return lines(spark, d).select(
        "game", ratio(F.col("price"), F.col("discounted")).alias("price_per_discount"),
        ratio(F.col("discounted"), F.col("price"), 100).alias("discount_percent"))


@query("A3_weighted_mean", """
SELECT l_suppkey AS supplier,
       sum(l_extendedprice::DECIMAL(18,2) * l_quantity::DECIMAL(18,2))::DOUBLE
         / nullif(sum(l_quantity::DECIMAL(18,2)), 0)::DOUBLE AS mean_price
FROM lineitem GROUP BY l_suppkey""")
def weighted_means(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("supplier")).agg(
        agg.weighted_mean(money("l_extendedprice"), money("l_quantity")).alias("mean_price"))


TEAM_SEASON = MATCHES + """, sides AS (
  SELECT season, home AS team, game, TRUE AS own, home_score AS pf, away_score AS pa, points, qty, n_lines,
         NULL::DECIMAL(18,2) AS points_a, NULL::DECIMAL(38,2) AS qty_a, NULL::BIGINT AS n_a FROM matches
  UNION ALL
  SELECT season, away, game, FALSE, NULL, NULL, NULL, NULL, NULL, points, qty, n_lines FROM matches),
team_season AS (
  SELECT season, team, count(DISTINCT CASE WHEN own THEN game END) AS games,
    coalesce(sum(pf), 0)::DOUBLE AS points_scored, coalesce(sum(pa), 0)::DOUBLE AS points_allowed,
    coalesce(sum(points), 0)::DOUBLE AS points, coalesce(sum(points_a), 0)::DOUBLE AS points_allowed_by,
    coalesce(sum(qty), 0)::DOUBLE AS qty, coalesce(sum(qty_a), 0)::DOUBLE AS qty_allowed,
    coalesce(sum(n_lines), 0)::BIGINT AS n_lines, coalesce(sum(n_a), 0)::BIGINT AS n_lines_allowed,
    sum(points * n_lines)::DOUBLE / nullif(sum(n_lines), 0) AS mean_points,
    sum(points_a * n_a)::DOUBLE / nullif(sum(n_a), 0) AS mean_points_allowed
  FROM sides GROUP BY season, team)"""


def team_season_frame(spark, d):
    m = matches(spark, d)
    weekly = m.select("game", "season", "week", F.col("home").alias("team"), F.col("away").alias("opponent"),
                      F.col("points").alias("value"), "qty", "n_lines")
    scores = m.select("game", F.col("home").alias("team"), F.col("home_score").alias("points_for"),
                      F.col("away_score").cast("decimal(28,2)").alias("points_against"))
    return agg.team_season(weekly, scores, "team", "opponent", "game", ["value", "qty", "n_lines"], ["season"],
                           weighted={"mean_points": ("value", "n_lines")})


@query("A4_team_season", f"""
WITH {TEAM_SEASON} SELECT season, team::BIGINT AS team, games, points_scored, points_allowed, points AS value,
  points_allowed_by AS value_allowed, qty, qty_allowed, n_lines, n_lines_allowed, mean_points,
  mean_points_allowed FROM team_season""")
def team_season(spark, d):
    return team_season_frame(spark, d)


@query("J9_mirror_opponent", f"""
WITH {MATCHES}, sides AS (
  SELECT home AS team, points, NULL AS points_allowed FROM matches
  UNION ALL SELECT away, NULL, points FROM matches)
SELECT team::BIGINT AS team, sum(points)::DOUBLE AS points, sum(points_allowed)::DOUBLE AS points_allowed
FROM sides GROUP BY team""")
def mirror(spark, d):
    sides = joins.mirror_opponent(matches(spark, d).select("game", "home", "away", "points"), "home", "away", ["points"])
    return sides.groupBy(F.col("home").alias("team")).agg(
        F.sum("points").alias("points"), F.sum("points_allowed").alias("points_allowed"))


@query("J8_both_sides", f"""
WITH {MATCHES}, s AS (
  SELECT DISTINCT game, season, day, 'home' AS side, home AS team, away AS opponent FROM matches
  UNION SELECT DISTINCT game, season, day, 'away', away, home FROM matches)
SELECT game, season, day, side, team::BIGINT AS team, opponent::BIGINT AS opponent FROM s""")
def sides(spark, d):
    return joins.both_sides(matches(spark, d).select("game", "season", "day", "home", "away"), "home", "away")


@query("A5_duplicate_keys", """
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, count(*) AS n_rows FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def duplicates(spark, d):
    return agg.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("A5_rule_violations", """
WITH c AS (SELECT count(*) AS n,
  count(*) FILTER (WHERE NOT coalesce(l_discount BETWEEN 0.01 AND 0.10, FALSE)) AS discounted,
  count(*) FILTER (WHERE NOT coalesce(l_quantity >= 1, FALSE)) AS quantity,
  count(*) FILTER (WHERE NOT coalesce(l_returnflag IN ('A', 'N'), FALSE)) AS flag FROM lineitem)
SELECT 'discount in range' AS rule, discounted AS n_violations, n AS n_rows FROM c
UNION ALL SELECT 'quantity positive', quantity, n FROM c
UNION ALL SELECT 'flag allowed', flag, n FROM c""")
def rules(spark, d):
    return agg.violations(table(spark, d, "lineitem"), {
        "discount in range": F.col("l_discount").between(0.01, 0.10),
        "quantity positive": F.col("l_quantity") >= 1,
        "flag allowed": F.col("l_returnflag").isin("A", "N")})


def weekly_facts(spark, d):
    f = with_group(facts(spark, d), spark, d).join(lines(spark, d), "game", "left")
    return f.groupBy("entity", "season", "week").agg(
        F.max("grp").alias("grp"), F.max_by("team", "game").alias("team"),
        F.sum("points").alias("points"), F.sum("qty").alias("qty"), F.sum("returned").alias("returned"))


def participation(spark, d):
    """Every month of a season in which the entity has any order, as one list; overdrawn ones rest until June."""
    seasons = facts(spark, d).select("entity", "season").distinct()
    # One row per season, bounded by the calendar.
    weeks = facts(spark, d).groupBy("season").agg(F.array_sort(F.collect_set("week")).alias("week"))
    c = table(spark, d, "customer").select(
        F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("grp"),
        F.col("c_nationkey").cast("string").alias("team"), "c_acctbal")
    status = F.transform("week", lambda w: F.when((F.col("c_acctbal") < 0) & (w <= 6), "RES").otherwise("ACT"))
    return seasons.join(F.broadcast(weeks), "season").join(c, "entity").select(
        "entity", "season", "week", "grp", "team", status.alias("status"))


THRESHOLD = GROUPED + ", " + LINES + """, wf AS (
  SELECT entity, season, week, max(grp) AS grp, arg_max(team, game) AS team, sum(points) AS points,
         sum(qty) AS qty, sum(returned) AS returned
  FROM grouped LEFT JOIN lines USING (game) GROUP BY entity, season, week),
part AS (
  SELECT entity, season, week, c_mktsegment AS grp, c_nationkey::VARCHAR AS team,
         CASE WHEN c_acctbal < 0 AND week <= 6 THEN 'RES' ELSE 'ACT' END AS status
  FROM (SELECT DISTINCT entity, season FROM facts) JOIN (SELECT DISTINCT season, week FROM facts) USING (season)
  JOIN customer ON c_custkey = entity),
weeks AS (
  SELECT entity, season, week, wf.entity IS NOT NULL AS has_fact, coalesce(part.status = 'ACT', FALSE) AS is_active,
         part.entity IS NOT NULL AS is_rostered, coalesce(part.grp, wf.grp) AS grp, coalesce(part.team, wf.team) AS team,
         CASE WHEN wf.entity IS NULL THEN 0 ELSE wf.returned END AS a, CASE WHEN wf.entity IS NULL THEN 0 ELSE wf.qty END AS b
  FROM wf FULL JOIN part USING (entity, season, week)),
"""
_TAIL = """ s AS (SELECT *, {inside} AS inside,
    CASE WHEN {inside} THEN {value} END AS v FROM weeks)
SELECT entity, season, arg_max(grp, week) FILTER (WHERE inside) AS grp, arg_max(team, week) FILTER (WHERE inside) AS team,
  count(*) FILTER (WHERE has_fact) AS stat_row_games, count(*) FILTER (WHERE is_active) AS active_games,
  count(*) FILTER (WHERE is_rostered) AS team_games, count(*) FILTER (WHERE inside) AS denominator_games,
  count(v) AS evaluated_games, count(*) FILTER (WHERE inside AND v IS NULL) AS undefined_games,
  coalesce(string_agg(week::VARCHAR, ',' ORDER BY week) FILTER (WHERE inside AND v IS NULL), '') AS undefined_weeks,
  count(*) FILTER (WHERE {hit}) AS qualifying_games,
  coalesce(string_agg(week::VARCHAR, ',' ORDER BY week) FILTER (WHERE {hit}), '') AS qualifying_weeks,
  round(avg(v), 6) AS average, round(median(v), 6) AS median,
  CASE WHEN count(*) FILTER (WHERE inside) > 0 THEN
    count(*) FILTER (WHERE {hit})::DOUBLE / count(*) FILTER (WHERE inside) END AS qualifying_rate
FROM s GROUP BY entity, season"""


def threshold(spark, d, formula, comparison, bound, basis):
    out = agg.threshold_analysis(
        weekly_facts(spark, d), participation(spark, d), ["entity", "season"], "week", ["grp", "team"],
        formula, ["returned", "qty", "points"], comparison, bound, basis)
    return out.withColumns({
        "undefined_weeks": F.array_join("undefined_weeks", ","),
        "qualifying_weeks": F.array_join("qualifying_weeks", ","),
        "average": F.round("average", 6), "median": F.round("median", 6)})


@query("A6_threshold_team_games", "WITH " + THRESHOLD + _TAIL.format(
    inside="is_rostered", value="a::DOUBLE / nullif(b, 0)::DOUBLE", hit="v >= 0.25"))
def threshold_team(spark, d):
    return threshold(spark, d, "returned / qty", "gte", 0.25, "team_games")


@query("A6_threshold_active_roster", "WITH " + THRESHOLD + _TAIL.format(
    inside="is_active", value="(b - a)::DOUBLE", hit="v < 40"))
def threshold_active(spark, d):
    return threshold(spark, d, "qty - returned", "lt", 40, "active_roster")


# Only stat rows: no roster says who took part, which position or which team.
_STAT_ROWS = THRESHOLD.replace("FROM wf FULL JOIN part USING", "FROM wf LEFT JOIN (SELECT * FROM part WHERE FALSE) AS part USING")


@query("A6_threshold_stat_row", "WITH " + _STAT_ROWS + _TAIL.format(
    inside="has_fact", value="a::DOUBLE", hit="v > 20"))
def threshold_stat(spark, d):
    return threshold(spark, d, "returned", "gt", 20, "stat_row")


@query("A17_latest_period", f"""
WITH {FACTS}, s AS (
  SELECT entity, season, bool_or(week = 12) AS is_complete, max(week) AS last_week FROM facts GROUP BY entity, season)
SELECT entity, season, is_complete, last_week FROM s QUALIFY row_number() OVER (PARTITION BY entity ORDER BY season DESC) = 1""")
def latest_period(spark, d):
    return agg.latest_period(facts(spark, d), ["entity"], "season", "week", 12)


@query("S_season_pipeline", f"""
WITH {SEASON} SELECT season, count(*) AS entities, sum(games)::BIGINT AS games, sum(points)::DOUBLE AS points,
  CASE WHEN sum(qty) <> 0 THEN round_even(sum(discounted)::DOUBLE / sum(qty)::DOUBLE, 3) END AS discount_per_unit
FROM season_rows GROUP BY season""")
def season_pipeline(spark, d):
    return season_rows(spark, d).groupBy("season").agg(
        F.count(F.lit(1)).alias("entities"), F.sum("games").alias("games"), F.sum("points").alias("points"),
        ratio(F.sum("discounted"), F.sum("qty")).alias("discount_per_unit"))
