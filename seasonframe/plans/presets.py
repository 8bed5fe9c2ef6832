"""Sports presets: the column lists and code tables the generic operators are used with."""

# Summed columns of a player season, in table order.
PLAYER_ADDITIVE = [
    "completions", "attempts", "passing_yards", "passing_tds", "passing_interceptions", "sacks_suffered",
    "sack_yards_lost", "passing_air_yards", "passing_yards_after_catch", "passing_first_downs",
    "passing_2pt_conversions", "carries", "rushing_yards", "rushing_tds", "rushing_fumbles",
    "rushing_fumbles_lost", "rushing_first_downs", "rushing_2pt_conversions", "receptions", "targets",
    "receiving_yards", "receiving_tds", "receiving_fumbles", "receiving_fumbles_lost", "receiving_air_yards",
    "receiving_yards_after_catch", "receiving_first_downs", "receiving_2pt_conversions", "fantasy_points",
    "fantasy_points_ppr",
]

# Totals that are null without attempts of their kind.
EPA_TOTALS = {"passing_epa": "attempts", "rushing_epa": "carries", "receiving_epa": "targets"}

# Ratios of season totals as name: (numerator, denominator, scale).
PLAYER_RATIOS = {
    "completion_percentage": ("completions", "attempts", 100),
    "passing_yards_per_attempt": ("passing_yards", "attempts", 1),
    "passing_epa_per_attempt": ("passing_epa", "attempts", 1),
    "pacr": ("passing_yards", "passing_air_yards", 1),
    "rushing_yards_per_carry": ("rushing_yards", "carries", 1),
    "rushing_epa_per_carry": ("rushing_epa", "carries", 1),
    "catch_percentage": ("receptions", "targets", 100),
    "receiving_yards_per_reception": ("receiving_yards", "receptions", 1),
    "receiving_yards_per_target": ("receiving_yards", "targets", 1),
    "receiving_epa_per_target": ("receiving_epa", "targets", 1),
    "racr": ("receiving_yards", "receiving_air_yards", 1),
    "fantasy_points_per_game": ("fantasy_points", "games", 1),
    "fantasy_points_ppr_per_game": ("fantasy_points_ppr", "games", 1),
}

PLAYER_FORMULA_FIELDS = ["games", *PLAYER_ADDITIVE, *EPA_TOTALS, *PLAYER_RATIOS, "passing_cpoe"]

# Code aliases.
TEAM_ALIASES = {"AZ": "ARI", "LAR": "LA"}

# Relocated teams with their current code and its first season.
FRANCHISE_RELOCATIONS = {"OAK": ("LV", 2020), "SD": ("LAC", 2017), "STL": ("LA", 2016)}

# Columns that hold team codes.
TEAM_CODE_COLUMNS = [
    "team_abbr", "team", "opponent", "opponent_team", "away_team", "home_team", "latest_team", "draft_team",
    "last_team",
]

# Ranking pages with scoring format, league format and historical snapshot label.
RANKING_PAGES = [
    ("redraft-overall", "ppr", "redraft_1qb", "final_preseason"),
    ("redraft-op", "ppr", "redraft_superflex", "final_preseason"),
    ("dynasty-overall", "source_default", "dynasty_1qb", "season_opening"),
    ("dynasty-op", "source_default", "dynasty_superflex", "season_opening"),
    ("dynasty-rk", "source_default", "dynasty_rookie", "season_opening"),
    ("best-overall", "source_default", "best_ball", "season_opening"),
    ("redraft-idp", "source_default", "redraft_idp", "final_preseason"),
    ("dynasty-idp", "source_default", "dynasty_idp", "season_opening"),
]

# Game types that make up the postseason, and positions compared with results.
POSTSEASON_GAMES = ["WC", "DIV", "CON", "SB"]
COMPARED_POSITIONS = ["QB", "RB", "WR", "TE", "K"]
