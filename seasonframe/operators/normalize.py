"""Table-level normalisation: codes, schema generations, casts, reports, ranking pages."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .joins import attach_id


def canonical_codes(df: DataFrame, cols: Iterable[str], aliases: Mapping[str, str],
                    relocations: Mapping[str, tuple[str, int]] | None = None,
                    season_col: str | None = None) -> DataFrame:
    """Replace alias codes in every listed column that is present.

    A relocation (old -> (new, first season)) applies when the season is null or late enough.
    """
    present = [c for c in cols if c in df.columns]
    out = df.replace(dict(aliases), subset=present) if aliases and present else df
    for old, (new, first_season) in (relocations or {}).items():
        moved = F.lit(True)
        if season_col:
            moved = F.col(season_col).isNull() | (F.col(season_col) >= first_season)
        out = out.withColumns(
            {c: F.when((F.col(c) == old) & moved, new).otherwise(F.col(c)) for c in present}
        )
    return out


def normalize_by_schema(df: DataFrame,
                        adapters: list[tuple[str, set[str], Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """Apply the first adapter whose required columns are all present, most specific first."""
    for _, required, adapter in adapters:
        if set(required) <= set(df.columns):
            return adapter(df)
    raise ValueError(f"no adapter fits columns {sorted(df.columns)}")


def position_group(label: Column) -> Column:
    """Group of a formation label: special teams, defence (ends with D) or offence."""
    return (
        F.when(label == "Special Teams", "Special Teams")
        .when(label.endswith("D"), "Defense")
        .otherwise("Offense")
    )


def lenient_cast(df: DataFrame, spec: Mapping[str, str]) -> DataFrame:
    """Cast columns so that a bad value becomes null and never an error."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in spec.items()})


def with_season(df: DataFrame, date_col: str, name: str = "season") -> DataFrame:
    """Add the season of a date column."""
    return df.withColumn(name, S.season_of(F.col(date_col)))


def normalize_report(feed: DataFrame, extraction: DataFrame, provider: str) -> DataFrame:
    """One report row per feed item joined with its extracted metadata.

    The body has up to two sections, made only from non-blank parts; a blank or `FA` team gives an
    empty list; the publish text is read as UTC and decides the season.
    """
    def part(heading: str, col: Column) -> Column:
        return F.when(F.trim(col) != "", F.concat(F.lit(f"# {heading}\n\n"), F.trim(col)))

    published = F.try_to_timestamp(F.col("created"), F.lit("yyyy-MM-dd HH:mm:ss"))
    team = F.upper(F.trim(F.col("team_id")))
    teams = F.when((team != "") & (team != "FA"), F.array(team)).otherwise(F.array().cast("array<string>"))
    joined = feed.join(extraction, "external_id", "left")
    return joined.select(
        F.concat(F.lit(f"{provider}:"), F.col("external_id").cast("string")).alias("report_id"),
        F.lit(provider).alias("provider"),
        F.col("external_id").cast("string").alias("external_id"),
        F.trim("title").alias("title"),
        F.concat_ws("\n\n", part("News", F.col("desc")), part("Fantasy impact", F.col("impact"))).alias("body"),
        teams.alias("teams"),
        published.alias("published_at"),
        S.season_of(F.to_date(published)).alias("season"),
        *[F.col(c) for c in extraction.columns if c != "external_id"],
    )


def normalize_rankings(pages: DataFrame, config: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keep configured ranking pages, label them and attach ids; also count unmatched rows per page.

    `config` holds page, scoring_format, league_format, snapshot_type and is fixed by the caller.
    """
    labelled = pages.join(F.broadcast(config), "page")
    matched = attach_id(labelled, ids, "external_id", "player_id")
    rows = matched.matched.select(
        "player_id", "page", "scoring_format", "league_format", "snapshot_type", "scrape_date",
        F.col("ecr").alias("overall_rank"),
        F.col("best").try_cast("int").alias("best_rank"),
        F.col("worst").try_cast("int").alias("worst_rank"),
        F.col("position"),
        F.coalesce("team", "tm").alias("team"),
    )
    dropped = matched.unmatched.groupBy("page").agg(F.count(F.lit(1)).alias("n_unmatched"))
    return rows, dropped
