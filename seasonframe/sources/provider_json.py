"""Provider payloads (JSON text rows) to flat tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PROJECTION = """struct<player_id string, team string, opponent string, season string, week string,
  game_id string, date string, status string, stats map<string,string>,
  player struct<first_name string, last_name string, position string,
                fantasy_positions array<string>, injury_status string>>"""
_MARKET = """struct<value string, overallRank string, positionRank string, trend30Day string,
  player struct<id string, name string, position string, sleeperId string, maybeTeam string>>"""
_PICK = """struct<pick_no string, round string, draft_slot string, roster_id string, player_id string,
  metadata struct<first_name string, last_name string, position string, team string>>"""


def _full_name(first: Column, last: Column) -> Column:
    parts = F.filter(F.array(F.trim(first), F.trim(last)), lambda x: x.isNotNull() & (x != ""))
    return F.nullif(F.array_join(parts, " "), F.lit(""))


def _required_int(col: Column, name: str) -> Column:
    value = col.try_cast("int")
    return F.when(value.isNotNull(), value).otherwise(
        F.raise_error(F.lit(f"{name} must be an integer")).cast("int"))


def projections(df: DataFrame, json_col: str, positions: list[str] | None = None) -> DataFrame:
    """Weekly projections: name parts joined, position falls back to the first listed one, `DEF`
    names get ` D/ST`, stats that are not numbers are dropped."""
    p = df.select(F.from_json(json_col, _PROJECTION).alias("p")).select("p.*").filter("player_id IS NOT NULL")
    position = F.upper(F.coalesce(F.nullif(F.col("player.position"), F.lit("")),
                                  F.get(F.col("player.fantasy_positions"), 0), F.lit("")))
    name = _full_name(F.col("player.first_name"), F.col("player.last_name"))
    name = F.when(position == "DEF", F.concat(name, F.lit(" D/ST"))).otherwise(name)
    numbers = F.map_filter(F.transform_values("stats", lambda k, v: v.try_cast("double")), lambda k, v: v.isNotNull())
    out = p.select(
        "player_id", F.coalesce(name, F.col("player_id")).alias("display_name"), position.alias("position"),
        F.upper("team").alias("team"), F.upper("opponent").alias("opponent"),
        F.col("season").try_cast("int").alias("season"), F.col("week").try_cast("int").alias("week"),
        "game_id", F.col("date").alias("game_date"), F.col("status").alias("game_status"),
        F.col("player.injury_status").alias("injury_status"),
        F.coalesce(numbers, F.create_map().cast("map<string,double>")).alias("stats"))
    return out.filter(F.col("position").isin(positions)) if positions else out


def market_values(df: DataFrame, json_col: str) -> DataFrame:
    """Market values: rows without name or position are skipped, ranks must be integers."""
    p = df.select(F.from_json(json_col, _MARKET).alias("p")).select("p.*")
    name, position = F.trim("player.name"), F.upper(F.trim("player.position"))
    rows = p.filter((name != "") & (position != ""))
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return rows.select(
        F.col("player.id").alias("market_id"), blank(F.col("player.sleeperId")).alias("player_id"),
        name.alias("display_name"), position.alias("position"),
        F.upper(blank(F.col("player.maybeTeam"))).alias("team"),
        _required_int(F.col("value"), "value").alias("value"),
        _required_int(F.col("overallRank"), "overallRank").alias("overall_rank"),
        _required_int(F.col("positionRank"), "positionRank").alias("position_rank"),
        _required_int(F.coalesce("trend30Day", F.lit("0")), "trend30Day").alias("trend_30_day"))


def draft_picks(df: DataFrame, json_col: str) -> DataFrame:
    """Draft picks; a pick without a roster belongs to its draft slot."""
    p = df.select(F.from_json(json_col, _PICK).alias("p")).select("p.*")
    slot = _required_int(F.col("draft_slot"), "draft_slot")
    return p.select(
        _required_int(F.col("pick_no"), "pick_no").alias("pick_no"),
        _required_int(F.col("round"), "round").alias("round"), slot.alias("draft_slot"),
        F.coalesce(F.col("roster_id").try_cast("int"), slot).alias("roster_id"),
        F.col("player_id").alias("external_id"),
        _full_name(F.col("metadata.first_name"), F.col("metadata.last_name")).alias("display_name"),
        F.col("metadata.position").alias("position"), F.col("metadata.team").alias("team"))


def flatten_provider_json(df: DataFrame, json_col: str, kind: str) -> DataFrame:
    """Flat table of one payload kind."""
    kinds = {"projections": projections, "market_values": market_values, "draft_picks": draft_picks}
    if kind not in kinds:
        raise ValueError(f"unknown payload kind {kind!r}")
    return kinds[kind](df, json_col)
