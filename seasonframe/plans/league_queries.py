"""Entries of the public league queries: a league derived from the given tables, each query with its SQL.

Players are customers, teams nations, positions market segments, weekly rows orders, seasons years; expert ranks are
the daily snapshots of users. A query for one player or team is a lookup: its filters reach the scan.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import league as lg
from . import presets as P
from .inputs import GROUPED, LINES, MATCHES, SEASON, SNAPSHOTS, facts, lines, matches, season_rows, snapshots, table, with_group
from .registry import query

WEEKLY = GROUPED + """, weekly AS (
  SELECT entity AS player_id, season, week, game AS game_id, nation::BIGINT AS team, grp AS position, status, points::DOUBLE AS points FROM grouped)"""
TEAM_WEEKLY = WEEKLY + """, team_weekly AS (
  SELECT team, season, week, sum(points::DECIMAL(18,2))::DOUBLE AS points, count(*) AS games FROM weekly GROUP BY ALL)"""
# Place of each player of a team by a week's points; ties by id.
DEPTH = WEEKLY + """, summed AS (
  SELECT team, season, week, position, player_id, sum(points::DECIMAL(18,2)) AS p FROM weekly GROUP BY ALL),
depth AS (SELECT team, season, week, position, player_id,
  row_number() OVER (PARTITION BY team, season, week, position ORDER BY p DESC, player_id) AS depth_rank FROM summed)"""
ROSTERS = WEEKLY + """, rosters AS (
  SELECT player_id, team, season, week, max(status) AS status FROM weekly GROUP BY ALL),
player_status AS (SELECT player_id, team, max(season) AS last_season, 'R' AS status FROM weekly GROUP BY player_id, team)"""
SEASONS = SEASON + """, seasons AS (
  SELECT entity AS player_id, season, c_mktsegment AS position, c_nationkey::BIGINT AS last_team, games,
         points::DOUBLE AS fantasy_points, qty::DOUBLE AS attempts, c_name AS display_name
  FROM season_rows JOIN customer ON c_custkey = entity)"""
RANKS = SNAPSHOTS + """, ranks AS (
  SELECT player AS player_id, grp AS position, year(day)::BIGINT AS season, day AS scrape_date,
         total::DOUBLE AS overall_rank, low::DOUBLE AS best_rank, high::DOUBLE AS worst_rank FROM snapshots),
newest AS (SELECT * FROM ranks WHERE season = 2024 AND scrape_date = (SELECT max(scrape_date) FROM ranks WHERE season = 2024 AND scrape_date <= DATE '2024-01-15')),
ranked AS (SELECT *, rank() OVER (PARTITION BY position ORDER BY overall_rank) AS position_rank, worst_rank - best_rank AS rank_range FROM newest)"""


def weekly_rows(spark, d):
    return with_group(facts(spark, d), spark, d).select(
        F.col("entity").alias("player_id"), "season", "week", F.col("game").alias("game_id"), F.col("nation").alias("team"),
        F.col("grp").alias("position"), "status", "points")


def players(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("player_id"), F.col("c_name").alias("display_name"))


def expert_ranks(spark, d):
    return snapshots(spark, d).select(
        F.col("player").alias("player_id"), F.col("grp").alias("position"), F.year("day").alias("season"),
        F.col("day").alias("scrape_date"), F.lit("ppr").alias("scoring_format"), F.lit("redraft_1qb").alias("league_format"),
        F.lit("current").alias("snapshot_type"), F.col("total").cast("double").alias("overall_rank"),
        F.col("low").cast("double").alias("best_rank"), F.col("high").cast("double").alias("worst_rank"))


RANK_COLUMNS = ["player_id", "position", "scrape_date", "overall_rank", "best_rank", "worst_rank", "position_rank", "rank_range"]


@query("L1_find_players", "SELECT c_custkey AS player_id, c_name AS display_name FROM customer WHERE lower(c_name) LIKE '%#0000001%'")
def find_players(spark, d):
    return lg.find_players(lg.League(players=players(spark, d)), " CUSTOMER#0000001")


@query("L2_player_weekly_stats", f"WITH {WEEKLY} SELECT week, game_id, points FROM weekly WHERE player_id = 7 AND season = 1996")
def player_weekly(spark, d):
    return lg.get_player_weekly_stats(lg.League(weekly=weekly_rows(spark, d)), 7, 1996, None, ["game_id", "points"])


@query("L3_team_games", f"""
WITH {MATCHES} SELECT game AS game_id, season, week, day AS gameday, home::BIGINT AS home_team, away::BIGINT AS away_team
FROM matches WHERE (home = 3 OR away = 3) AND season = 1997""")
def team_games(spark, d):
    games = matches(spark, d).select(
        F.col("game").alias("game_id"), "season", "week", F.col("day").alias("gameday"), F.col("home").alias("home_team"), F.col("away").alias("away_team"))
    return lg.get_team_games(lg.League(games=games), 3, 1997)


def seasons(spark, d):
    c = table(spark, d, "customer").select(
        F.col("c_custkey").alias("player_id"), F.col("c_mktsegment").alias("position"), F.col("c_nationkey").alias("last_team"))
    return season_rows(spark, d).join(c, F.col("entity") == c.player_id).select(
        "player_id", "season", F.lit("REG").alias("season_type"), "position", "last_team", "games",
        F.col("points").cast("double").alias("fantasy_points"), F.col("qty").cast("double").alias("attempts"))


@query("L4_player_season_stats", f"WITH {SEASONS} SELECT player_id, season, 'REG' AS season_type, games, fantasy_points FROM seasons WHERE player_id = 7 AND season = 1996")
def player_season(spark, d):
    return lg.get_player_season_stats(lg.League(seasons=seasons(spark, d)), 7, 1996, ["games", "fantasy_points"])


@query("L5_team_weekly_stats", f"WITH {TEAM_WEEKLY} SELECT week, points, games FROM team_weekly WHERE team = 3 AND season = 1997")
def team_weekly(spark, d):
    rows = weekly_rows(spark, d).groupBy("team", "season", "week").agg(F.sum("points").alias("points"), F.count(F.lit(1)).alias("games"))
    return lg.get_team_weekly_stats(lg.League(team_weekly=rows), 3, 1997, None, ["points", "games"])


@query("L6_team_depth_chart", f"""
WITH {DEPTH} SELECT team, season, week, position, player_id, depth_rank FROM depth
WHERE team = 3 AND season = 1998 AND week = (SELECT max(week) FROM depth WHERE team = 3 AND season = 1998)""")
def depth_chart(spark, d):
    summed = weekly_rows(spark, d).groupBy("team", "season", "week", "position", "player_id").agg(F.sum("points").alias("p"))
    place = F.row_number().over(Window.partitionBy("team", "season", "week", "position").orderBy(F.col("p").desc(), "player_id"))
    depth = summed.select("team", "season", "week", "position", "player_id", place.alias("depth_rank"))
    return lg.get_team_depth_chart(lg.League(depth=depth), 3, 1998)


@query("L7_player_snap_counts", f"""
WITH {WEEKLY}, {LINES} SELECT player_id, season, week, sum(n_lines)::BIGINT AS snaps FROM weekly JOIN lines ON game = game_id
WHERE player_id = 7 AND season = 1996 GROUP BY player_id, season, week""")
def snap_counts(spark, d):
    snaps = weekly_rows(spark, d).join(lines(spark, d).withColumnRenamed("game", "game_id"), "game_id").groupBy(
        "player_id", "season", "week").agg(F.sum("n_lines").alias("snaps"))
    return lg.get_player_snap_counts(lg.League(snaps=snaps), 7, 1996)


def roster_league(spark, d):
    weekly = weekly_rows(spark, d)
    return lg.League(
        rosters=weekly.groupBy("player_id", "team", "season", "week").agg(F.max("status").alias("status")),
        player_status=weekly.groupBy("player_id", "team").agg(F.max("season").alias("last_season")).withColumn("status", F.lit("R")))


@query("L8_team_roster", f"""
WITH {ROSTERS} SELECT player_id, team, season, status, 'weekly_roster' AS source_snapshot FROM rosters
WHERE team = 3 AND season = 1997 AND week = (SELECT max(week) FROM rosters WHERE team = 3 AND season = 1997)""")
def team_roster(spark, d):
    return lg.get_team_roster(roster_league(spark, d), 3, 1997, 1998)


@query("L8_team_roster_from_status", f"""
WITH {ROSTERS} SELECT player_id, team, 1998::BIGINT AS season, status, 'current_player_status' AS source_snapshot
FROM player_status WHERE team = 3 AND last_season = 1998""")
def team_roster_status(spark, d):
    """The current season has no roster of its thirteenth week, so the status table answers."""
    return lg.get_team_roster(roster_league(spark, d), 3, 1998, 1998, week=13)


@query("L9_rank_players_by_formula", f"""
WITH {SEASONS}, t AS (
  SELECT *, fantasy_points / attempts AS v FROM seasons WHERE season = 1996 AND games >= 2 AND attempts <> 0
  ORDER BY v DESC, player_id LIMIT 10)
SELECT row_number() OVER (ORDER BY v DESC, player_id) AS rank, player_id, display_name, position, last_team, games,
       fantasy_points, attempts, round_even(v, 6) AS metric_value FROM t""")
def rank_players(spark, d):
    league = lg.League(players=players(spark, d), seasons=seasons(spark, d))
    return lg.rank_players_by_formula(league, 1996, "fantasy_points / attempts", minimum=("games", 2)).results


@query("L10_rank_teams_by_formula", f"""
WITH {MATCHES}, s AS (
  SELECT home AS team, game, n_lines::DECIMAL(18,2) AS allowed FROM matches WHERE home <> away AND season = 1997
  UNION ALL SELECT away, game, qty::DECIMAL(18,2) FROM matches WHERE home <> away AND season = 1997),
t AS (SELECT team::BIGINT AS team, count(DISTINCT game) AS games, sum(allowed)::DOUBLE AS qty_allowed FROM s GROUP BY team),
c AS (SELECT * FROM t WHERE games >= 10 ORDER BY qty_allowed / games, team LIMIT 10)
SELECT row_number() OVER (ORDER BY qty_allowed / games, team) AS rank, team, games, qty_allowed, round_even(qty_allowed / games, 6) AS metric_value FROM c""")
def rank_teams(spark, d):
    """What opponents did against a team: the away side's lines against the home team, the home side's quantity against the other."""
    m = matches(spark, d).filter("home <> away").withColumn("season_type", F.lit("REG"))
    games = m.select(F.col("game").alias("game_id"), F.col("home").alias("home_team"), F.col("away").alias("away_team"), "home_score", "away_score")
    side = lambda team, other, value: F.struct(
        F.col(team).alias("team"), F.col(other).alias("opponent_team"), F.col(value).cast("decimal(18,2)").alias("qty"))
    weekly = m.select(F.col("game").alias("game_id"), "season", "season_type", F.inline(F.array(side("home", "away", "qty"), side("away", "home", "n_lines"))))
    league = lg.League(games=games, team_weekly=weekly)
    return lg.rank_teams_by_formula(league, 1997, "defense", "qty_allowed / games", ["qty"], minimum_games=10, direction="asc").results


@query("L11_rank_players_by_weekly_threshold", f"""
WITH {WEEKLY}, w AS (SELECT player_id, week, sum(points::DECIMAL(18,2)) AS p FROM weekly WHERE season = 1996 GROUP BY player_id, week),
t AS (SELECT player_id, count(*) AS denominator_games, count(*) FILTER (p >= 150000) AS qualifying_games FROM w GROUP BY player_id),
c AS (SELECT * FROM t WHERE denominator_games >= 2 ORDER BY qualifying_games DESC, player_id LIMIT 20)
SELECT row_number() OVER (ORDER BY qualifying_games DESC, player_id) AS place, player_id, c_name AS display_name, denominator_games, qualifying_games
FROM c JOIN customer ON c_custkey = player_id""")
def rank_weekly(spark, d):
    rows = weekly_rows(spark, d).withColumn("season_type", F.lit("REG"))
    weekly = rows.groupBy("player_id", "season", "season_type", "week").agg(
        F.max("position").alias("position"), F.max("team").alias("team"), F.sum("points").alias("points"))
    rosters = rows.withColumn("game_type", F.lit("REG")).select("player_id", "team", "season", "week", "game_type", "position", "status").distinct()
    league = lg.League(players=players(spark, d), weekly=weekly, rosters=rosters)
    return lg.rank_players_by_weekly_threshold(league, 1996, "points", ["points"], "gte", 150000, "stat_row", minimum_games=2).select(
        "place", "player_id", "display_name", "denominator_games", "qualifying_games")


@query("L12_player_expert_rank", f"WITH {RANKS} SELECT {', '.join(RANK_COLUMNS)} FROM ranked WHERE player_id = 7")
def player_rank(spark, d):
    return lg.get_player_ecr(lg.League(ranks=expert_ranks(spark, d)), 7, 2024, "ppr", "redraft_1qb", "2024-01-15").select(*RANK_COLUMNS)


@query("L13_rank_players_by_expert_rank", f"""
WITH {RANKS}, t AS (SELECT * FROM ranked WHERE position IN ('click', 'view', 'error') ORDER BY rank_range DESC NULLS LAST, player_id LIMIT 20)
SELECT row_number() OVER (ORDER BY rank_range DESC NULLS LAST, player_id) AS place, {', '.join(RANK_COLUMNS)} FROM t""")
def rank_by_experts(spark, d):
    league = lg.League(ranks=expert_ranks(spark, d))
    return lg.rank_players_by_ecr(league, 2024, "ppr", "redraft_1qb", "rank_range", "desc", ["click", "view", "error"],
                                  as_of="2024-01-15").select("place", *RANK_COLUMNS)


# The five compared positions stand for the five market segments, in alphabetical order of both lists.
POSITION_OF = dict(zip(("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"), P.COMPARED_POSITIONS, strict=True))
POSITION_SQL = "CASE c_mktsegment " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in POSITION_OF.items()) + " END"


@query("L14_compare_ranks_to_results", f"""
WITH {SEASON}, k AS (
  SELECT c_custkey AS player_id, {POSITION_SQL} AS position, c_acctbal::DOUBLE AS overall_rank FROM customer),
r AS (SELECT entity AS player_id, games, points::DOUBLE AS points FROM season_rows WHERE season = 1997),
f AS (SELECT k.*, coalesce(games, 0) AS games, coalesce(points, 0) AS points,
        rank() OVER (ORDER BY coalesce(points, 0) DESC) AS actual_finish FROM k LEFT JOIN r USING (player_id)),
c AS (SELECT *, round_even(overall_rank - actual_finish, 6) AS rank_difference FROM f WHERE games >= 2 ORDER BY rank_difference DESC, player_id LIMIT 20)
SELECT row_number() OVER (ORDER BY rank_difference DESC, player_id) AS place, player_id, position, overall_rank AS expected_rank, actual_finish,
       rank_difference, games, round_even(points, 6) AS points, round_even(points / games, 6) AS points_per_game FROM c""")
def compare_to_results(spark, d):
    """The account balance stands for the expert rank, so that ranks and results cover the same players."""
    position = S.literal_map(POSITION_OF)[F.col("c_mktsegment")].alias("position")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("player_id"), position, F.col("c_acctbal").cast("double").alias("overall_rank"))
    ranks = c.withColumns({
        "season": F.lit(1997), "scoring_format": F.lit("standard"), "league_format": F.lit("redraft_1qb"), "snapshot_type": F.lit("current"),
        "scrape_date": F.lit("1996-12-31").cast("date"), "best_rank": F.col("overall_rank"), "worst_rank": F.col("overall_rank")})
    results = seasons(spark, d).drop("position").join(c.select("player_id", "position"), "player_id")
    return lg.compare_ecr_to_results(lg.League(ranks=ranks, seasons=results), 1997, "standard", "redraft_1qb", "overall", "rank_difference", min_games=2).select(
        "place", "player_id", "position", "expected_rank", "actual_finish", "rank_difference", "games", "points", "points_per_game")
