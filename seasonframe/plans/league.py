"""The fourteen public analytic queries over league tables, each a short plan of the operators."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import joins as jn
from ..operators import ranking as rk
from . import presets as P


class League(NamedTuple):
    """League tables; a query needs only the ones it reads."""

    players: DataFrame | None = None
    player_status: DataFrame | None = None
    games: DataFrame | None = None
    weekly: DataFrame | None = None
    seasons: DataFrame | None = None
    team_weekly: DataFrame | None = None
    rosters: DataFrame | None = None
    snaps: DataFrame | None = None
    depth: DataFrame | None = None
    ranks: DataFrame | None = None


def build_player_seasons(weekly: DataFrame) -> DataFrame:
    """Player season table from weekly rows: totals, last attributes, weighted completion rate, ratios."""
    out = agg.season_totals(
        weekly, ["player_id", "gsis_id", "season", "season_type"], ["week", "game_id"], "game_id",
        [*P.PLAYER_ADDITIVE, *P.EPA_TOTALS], ["team", "position", "position_group"], "team",
        null_unless=P.EPA_TOTALS, weighted={"passing_cpoe": ("passing_cpoe", "attempts")},
        rounded={"fantasy_points": 2, "fantasy_points_ppr": 2, "passing_cpoe": 3})
    out = agg.with_ratios(out, P.PLAYER_RATIOS)
    out = out.withColumnsRenamed({"last_position": "position", "last_position_group": "position_group"})
    return agg.assert_unique(out, ["player_id", "season", "season_type"], "player seasons")


def _where(**equal) -> list[Column]:
    return [F.col(c) == v for c, v in equal.items() if v is not None]


def find_players(t: League, text: str) -> DataFrame:
    return rk.find_by_name(t.players, "display_name", text)


def get_player_weekly_stats(t: League, player_id: str, season: int, week: int | None, fields: list[str]) -> DataFrame:
    return rk.stat_lookup(t.weekly, _where(player_id=player_id, season=season, week=week), ["week", *fields], [F.col("week")])


def get_team_games(t: League, team: str, season: int, week: int | None = None) -> DataFrame:
    sides = (F.col("home_team") == team) | (F.col("away_team") == team)
    return rk.stat_lookup(t.games, [sides, *_where(season=season, week=week)], t.games.columns, [F.col("gameday"), F.col("game_id")])


def get_player_season_stats(t: League, player_id: str, season: int, fields: list[str], season_type: str = "REG") -> DataFrame:
    return t.seasons.filter((F.col("player_id") == player_id) & (F.col("season") == season)
                            & (F.col("season_type") == season_type)).select("player_id", "season", "season_type", *fields)


def get_team_weekly_stats(t: League, team: str, season: int, week: int | None, fields: list[str]) -> DataFrame:
    return rk.stat_lookup(t.team_weekly, _where(team=team, season=season, week=week), ["week", *fields], [F.col("week")])


def get_team_depth_chart(t: League, team: str, season: int, week: int | None = None, position: str | None = None) -> DataFrame:
    """The chart of a week, or of the newest stored week."""
    rows = t.depth.filter((F.col("team") == team) & (F.col("season") == season))
    rows = rows.filter(F.col("week") == week) if week is not None else jn.latest_per_group(rows, ["team", "season"], "week")
    return rk.stat_lookup(rows, _where(position=position), rows.columns, [F.col("position"), F.col("depth_rank")])


def get_player_snap_counts(t: League, player_id: str, season: int, week: int | None = None) -> DataFrame:
    return rk.stat_lookup(t.snaps, _where(player_id=player_id, season=season, week=week), t.snaps.columns, [F.col("week")])


def get_team_roster(t: League, team: str, season: int, current_season: int, week: int | None = None) -> DataFrame:
    """Weekly roster of a week or the newest one; for the current season without rows, the status table."""
    cols = ["player_id", "team", "season", "status"]
    rows = t.rosters.filter((F.col("team") == team) & (F.col("season") == season))
    rows = rows.filter(F.col("week") == week) if week is not None else jn.latest_per_group(rows, ["team", "season"], "week")
    status = t.player_status.filter((F.col("team") == team) & (F.col("last_season") == season)).withColumn("season", F.lit(season))
    return jn.with_fallback(rows.select(*cols), status.select(*cols), ["team", "season"], "season", F.lit(current_season),
                            ("weekly_roster", "current_player_status"))


def rank_players_by_formula(t: League, season: int, formula: str, season_type: str = "REG", position: str | None = None,
                            minimum: tuple[str, float] | None = None, direction: str = "desc", limit: int = 10) -> rk.FormulaRanking:
    """Names join after the cut, so only the listed players are looked up."""
    rows = t.seasons
    for c in _where(season=season, season_type=season_type, position=position):
        rows = rows.filter(c)
    r = rk.rank_by_formula(rows, formula, P.PLAYER_FORMULA_FIELDS, "player_id", minimum, direction, _limited(limit), ["position", "last_team", "games"])
    names = t.players.select("player_id", "display_name")
    return rk.FormulaRanking(r.results.join(names, "player_id", "left"), r.zero_denominator.join(names, "player_id", "left"), r.counts)


def rank_teams_by_formula(t: League, season: int, perspective: str, formula: str, stats: list[str], season_type: str = "REG",
                          minimum_games: int | None = None, direction: str = "desc", limit: int = 10) -> rk.FormulaRanking:
    """Offence fields, or what opponents did against the team."""
    games = jn.both_sides(t.games.select("game_id", "home_team", "away_team", "home_score", "away_score"), "home_team", "away_team")
    home = F.col("side") == "home"
    scores = games.select(
        "game_id", "team", F.when(home, F.col("home_score")).otherwise(F.col("away_score")).alias("points_for"),
        F.when(home, F.col("away_score")).otherwise(F.col("home_score")).alias("points_against"))
    weekly = t.team_weekly.filter((F.col("season") == season) & (F.col("season_type") == season_type))
    weighted = {"passing_cpoe": ("passing_cpoe", "attempts")} if "passing_cpoe" in weekly.columns else None
    rows = agg.team_season(weekly, scores, "team", "opponent_team", "game_id", stats, ["season", "season_type"], weighted)
    names = [*stats, *(weighted or {})]
    allowed = ["games", "points_scored", *names] if perspective == "offense" else [
        "games", "points_allowed", *[f"{s}_allowed" for s in names]]
    minimum = ("games", minimum_games) if minimum_games is not None else None
    return rk.rank_by_formula(rows, formula, allowed, "team", minimum, direction, _limited(limit), ["games"])


def rank_players_by_weekly_threshold(t: League, season: int, formula: str, fields: list[str], comparison: str, threshold: float,
                                     basis: str, rank_by: str = "qualifying_games", minimum_games: int = 1, limit: int = 20,
                                     season_type: str = "REG", position: str | None = None, player_ids: list[str] | None = None,
                                     direction: str = "desc") -> DataFrame:
    """Postseason rosters come under four game types; names join after the cut."""
    games = P.POSTSEASON_GAMES if season_type == "POST" else [season_type]
    weekly = t.weekly.filter((F.col("season") == season) & (F.col("season_type") == season_type))
    rosters = t.rosters.filter((F.col("season") == season) & F.col("game_type").isin(games))
    if player_ids:
        weekly, rosters = (x.filter(F.col("player_id").isin(player_ids)) for x in (weekly, rosters))
    rosters = jn.latest_membership(rosters, "player_id", "week", "team", ["position", "status"])
    rows = agg.threshold_analysis(weekly, rosters, ["player_id"], "week", ["position", "team"], formula, fields, comparison, threshold, basis)
    filters = [F.col("denominator_games") >= minimum_games, *_where(position=position)]
    top = rk.leaderboard(rows, rank_by, "player_id", direction, filters, _limited(limit))
    return top.join(t.players.select("player_id", "display_name"), "player_id", "left")


def _snapshot(t: League, season: int, scoring: str, league: str, as_of: str | None, snapshot_type: str) -> DataFrame:
    """The newest snapshot of one type; historical and current snapshots never mix."""
    rows = t.ranks.filter((F.col("season") == season) & (F.col("scoring_format") == scoring) & (F.col("league_format") == league)
                          & (F.col("snapshot_type") == snapshot_type))
    day = F.lit(as_of).cast("date") if as_of else F.lit("9999-12-31").cast("date")
    newest = jn.asof_snapshot(rows, ["season", "scoring_format", "league_format"], "scrape_date", day)
    return rk.snapshot_ranks(newest, "overall_rank", "position", "best_rank", "worst_rank")


def _limited(limit: int) -> int:
    if not 1 <= limit <= 20:
        raise ValueError("limit must be between 1 and 20")
    return limit


def get_player_ecr(t: League, player_id: str, season: int, scoring: str, league: str, as_of: str | None = None,
                   snapshot_type: str = "current") -> DataFrame:
    return _snapshot(t, season, scoring, league, as_of, snapshot_type).filter(F.col("player_id") == player_id)


def rank_players_by_ecr(t: League, season: int, scoring: str, league: str, sort_by: str, direction: str = "asc",
                        positions: list[str] | None = None, low: float | None = None, high: float | None = None,
                        as_of: str | None = None, limit: int = 20, snapshot_type: str = "current") -> DataFrame:
    filters = []
    if positions:
        filters.append(F.col("position").isin(positions))
    if low is not None:
        filters.append(F.col("overall_rank") >= low)
    if high is not None:
        filters.append(F.col("overall_rank") <= high)
    return rk.leaderboard(_snapshot(t, season, scoring, league, as_of, snapshot_type), sort_by, "player_id", direction, filters, _limited(limit))


def fantasy_value(scoring: str) -> Column:
    """Points of a season row by scoring format."""
    zero = F.lit(0.0)
    base = F.coalesce("fantasy_points", zero)
    return {
        "ppr": F.coalesce("fantasy_points_ppr", zero),
        "half_ppr": base + 0.5 * F.coalesce("receptions", zero),
    }.get(scoring, base)


def compare_ecr_to_results(t: League, season: int, scoring: str, league: str, basis: str, sort_by: str, direction: str = "desc",
                           min_games: int | None = None, rank_range: tuple = (None, None), as_of: str | None = None,
                           limit: int = 20, snapshot_type: str = "current") -> DataFrame:
    ranks = _snapshot(t, season, scoring, league, as_of, snapshot_type).filter(F.col("position").isin(P.COMPARED_POSITIONS)).select(
        "player_id", "position", "overall_rank", "position_rank")
    results = t.seasons.filter((F.col("season") == season) & (F.col("season_type") == "REG")
                               & F.col("position").isin(P.COMPARED_POSITIONS)).withColumn("value", fantasy_value(scoring))
    compared = rk.expected_vs_actual(ranks, results, "player_id", "position", "overall_rank", "position_rank", "value", "games")
    return rk.outperformers(compared, "player_id", basis, "overall_rank", "position_rank", min_games, rank_range, sort_by, direction, _limited(limit))
