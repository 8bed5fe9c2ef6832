"""The public queries on a small league."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from seasonframe.plans import league as lg
from seasonframe.plans import presets as P


@pytest.fixture(scope="module")
def tables(spark):
    base = "player_id string, gsis_id string, season int, season_type string, week int, game_id string, team string, position string, position_group string"
    rows = [("p1", "g1", 2024, "REG", w, f"k{w}", "KC", "QB", "QB") for w in (1, 2, 3)] + [
        ("p2", "g2", 2024, "REG", w, f"k{w}", "LV" if w > 1 else "KC", "WR", "WR") for w in (1, 2)]
    weekly = spark.createDataFrame(rows, base)
    stats = {c: F.lit(0) for c in P.PLAYER_ADDITIVE}
    qb = F.col("player_id") == "p1"
    stats |= {"attempts": F.when(qb, 10).otherwise(0), "passing_yards": F.when(qb, 100 * F.col("week")).otherwise(0),
              "targets": F.when(qb, 0).otherwise(8), "receptions": F.when(qb, 0).otherwise(5),
              "fantasy_points": F.when(qb, 20.0).otherwise(10.0), "fantasy_points_ppr": F.when(qb, 20.0).otherwise(15.0),
              "passing_epa": F.lit(1.5), "rushing_epa": F.lit(None).cast("double"), "receiving_epa": F.lit(2.0),
              "passing_cpoe": F.when(qb & (F.col("week") < 3), 3.0)}
    weekly = weekly.withColumns(stats)
    team_weekly = spark.createDataFrame(
        [("KC", "LV", 2024, "REG", 1, "k1", 30, 10), ("LV", "KC", 2024, "REG", 1, "k1", 20, 5)],
        "team string, opponent_team string, season int, season_type string, week int, game_id string, attempts int, carries int")
    games = spark.createDataFrame([("k1", 2024, 1, date(2024, 9, 5), "KC", "LV", 27, 20)],
                                  "game_id string, season int, week int, gameday date, home_team string, away_team string, home_score int, away_score int")
    ranks = spark.createDataFrame(
        [(p, pos, 2024, date(2024, 8, d), "ppr", "redraft_1qb", kind, r, b, w) for kind, p, pos, d, r, b, w in (
            ("final_preseason", "p1", "QB", 25, 7.0, 1, 3), ("current", "p1", "QB", 1, 9.0, 1, 3), ("current", "p1", "QB", 20, 2.0, 1, 9),
            ("current", "p2", "WR", 20, 1.0, 1, None), ("current", "p3", "WR", 20, 3.5, 2, 4))],
        "player_id string, position string, season int, scrape_date date, scoring_format string, league_format string, snapshot_type string, overall_rank double, best_rank int, worst_rank int")
    rosters = spark.createDataFrame(
        [("p1", "KC", 2024, w, "REG", "QB", "ACT" if w < 4 else "RES") for w in (1, 2, 3, 4)],
        "player_id string, team string, season int, week int, game_type string, position string, status string")
    status = spark.createDataFrame([("p9", "KC", 2025, "ACT")], "player_id string, team string, last_season int, status string")
    players = spark.createDataFrame([("p1", "Pat Q"), ("p2", "Will R"), ("p3", "Bust W")], "player_id string, display_name string")
    seasons = lg.build_player_seasons(weekly)
    return lg.League(players, status, games, weekly, seasons, team_weekly, rosters, None, None, ranks)


def test_player_seasons(tables):
    r = {x["player_id"]: x for x in tables.seasons.collect()}
    assert (r["p1"]["games"], r["p1"]["passing_yards"], r["p1"]["passing_yards_per_attempt"], r["p1"]["passing_cpoe"]) == (3, 600, 20.0, 2.0)
    assert (r["p1"]["passing_epa"], r["p1"]["receiving_epa"], r["p1"]["rushing_epa"], r["p1"]["catch_percentage"]) == (4.5, None, None, None)
    assert (r["p2"]["teams"], r["p2"]["last_team"], r["p2"]["catch_percentage"], r["p2"]["fantasy_points_ppr_per_game"]) == (["KC", "LV"], "LV", 62.5, 15.0)


def test_rankings(tables):
    r = lg.rank_players_by_formula(tables, 2024, "receptions / targets", minimum=("games", 1))
    assert [(x["player_id"], x["display_name"]) for x in r.results.collect()] == [("p2", "Will R")]
    assert [x["player_id"] for x in r.zero_denominator.collect()] == ["p1"]
    t = lg.rank_teams_by_formula(tables, 2024, "defense", "points_allowed + carries_allowed / games", ["attempts", "carries"], direction="asc")
    assert [(x["team"], x["metric_value"]) for x in t.results.orderBy("rank").collect()] == [("KC", 25.0), ("LV", 37.0)]
    for limit in (0, 21):
        with pytest.raises(ValueError):
            lg.rank_players_by_formula(tables, 2024, "receptions / targets", limit=limit)
    w = lg.rank_players_by_weekly_threshold(tables, 2024, "passing_yards", ["passing_yards"], "gte", 200, "team_games").collect()
    assert [(x["player_id"], x["denominator_games"], x["qualifying_weeks"], x["median"], x["display_name"]) for x in w] == [("p1", 4, [2, 3], 150.0, "Pat Q")]


def test_weekly_threshold_options(tables, spark):
    late = tables.weekly.filter("player_id = 'p1' AND week < 3").withColumns({"week": F.col("week") + 18, "season_type": F.lit("POST")})
    games = spark.createDataFrame([("p1", "KC", 2024, w, kind, "QB", "ACT") for w, kind in ((19, "WC"), (20, "DIV"), (22, "SB"))], tables.rosters.schema)
    both = tables._replace(weekly=tables.weekly.unionByName(late), rosters=tables.rosters.unionByName(games))

    def ask(**options):
        out = lg.rank_players_by_weekly_threshold(both, 2024, "targets", ["targets"], "gte", 8, options.pop("basis", "stat_row"), **options)
        return [(x["player_id"], x["denominator_games"], x["qualifying_games"], x["team_games"]) for x in out.orderBy("place").collect()]

    assert ask() == [("p2", 2, 2, 0), ("p1", 3, 0, 0)]
    assert ask(direction="asc") == [("p1", 3, 0, 0), ("p2", 2, 2, 0)]
    assert ask(position="WR") == [("p2", 2, 2, 0)] and ask(player_ids=["p1"]) == [("p1", 3, 0, 0)]
    assert ask(season_type="POST") == [("p1", 2, 0, 0)] and ask(season_type="POST", basis="team_games") == [("p1", 3, 0, 3)]



def test_expert_ranks(tables):
    one = lg.get_player_ecr(tables, "p1", 2024, "ppr", "redraft_1qb").first()
    assert (one["overall_rank"], one["position_rank"], one["rank_range"]) == (2.0, 1, 8)
    assert lg.get_player_ecr(tables, "p1", 2024, "ppr", "redraft_1qb", "2024-08-10").first()["overall_rank"] == 9.0
    old = lg.get_player_ecr(tables, "p1", 2024, "ppr", "redraft_1qb", snapshot_type="final_preseason").first()
    assert old["overall_rank"] == 7.0
    assert lg.get_player_ecr(tables, "p1", 2024, "ppr", "redraft_1qb", "2024-08-31").first()["overall_rank"] == 2.0
    top = lg.rank_players_by_ecr(tables, 2024, "ppr", "redraft_1qb", "rank_range", "desc").orderBy("place").collect()
    assert [x["player_id"] for x in top] == ["p1", "p3", "p2"]
    c = {x["player_id"]: x for x in lg.compare_ecr_to_results(tables, 2024, "ppr", "redraft_1qb", "overall", "rank_difference").collect()}
    assert (c["p1"]["actual_finish"], c["p1"]["rank_difference"], c["p3"]["games"], c["p3"]["actual_finish"]) == (1, 1.0, 0, 3)


def test_lookups(tables):
    assert [x["player_id"] for x in lg.find_players(tables, "PAT").collect()] == ["p1"]
    assert lg.get_team_games(tables, "LV", 2024).count() == 1
    assert [x["passing_yards"] for x in lg.get_player_weekly_stats(tables, "p1", 2024, None, ["passing_yards"]).collect()] == [100, 200, 300]
    assert {(x["player_id"], x["source_snapshot"]) for x in lg.get_team_roster(tables, "KC", 2024, 2025).collect()} == {("p1", "weekly_roster")}
    assert {(x["player_id"], x["source_snapshot"]) for x in lg.get_team_roster(tables, "KC", 2025, 2025).collect()} == {("p9", "current_player_status")}
    assert lg.get_player_season_stats(tables, "p1", 2024, ["games"]).first()["games"] == 3
