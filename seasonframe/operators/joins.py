"""Joins: id crosswalks, as-of joins, snapshots, availability, membership."""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import all_of, assert_unique, first_by, left_join_spread
from ..functions import scalars as S


class Matched(NamedTuple):
    matched: DataFrame
    unmatched: DataFrame


def unique_ids(ids: DataFrame, key: str, id_col: str) -> DataFrame:
    """One id per key, the smallest; null keys out. Map-side combinable."""
    return ids.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(id_col).alias(id_col))


def attach_id(df: DataFrame, ids: DataFrame, key: str, id_col: str, heavy: bool = False) -> Matched:
    """Split rows into those whose key has an id and those without; null keys never match, and spread over all tasks
    (with `heavy` so do keys that hold a large share of the rows)."""
    joined = left_join_spread(df, unique_ids(ids, key, id_col), key, heavy)
    return Matched(joined.filter(F.col(id_col).isNotNull()), joined.filter(F.col(id_col).isNull()))


def attach_id_fallback(df: DataFrame, ids: DataFrame, key1: str, key2: str, id_col: str, heavy: bool = False) -> Matched:
    """As `attach_id`, preferring the first key and using the second when it gives nothing."""
    by_second = unique_ids(ids, key2, id_col).withColumnRenamed(id_col, "_second")
    first = left_join_spread(df, unique_ids(ids, key1, id_col), key1, heavy)
    joined = left_join_spread(first, by_second, key2, heavy).withColumn(id_col, F.coalesce(id_col, "_second")).drop("_second")
    return Matched(joined.filter(F.col(id_col).isNotNull()), joined.filter(F.col(id_col).isNull()))


def unpivot_ids(df: DataFrame, id_col: str, cols: list[str],
                rename: Mapping[str, str] | None = None) -> DataFrame:
    """Wide id columns to (id, provider, external_id); blanks out; one row per external id."""
    bare = provider = F.regexp_replace("provider", "_id$", "")
    for old, new in (rename or {}).items():
        provider = F.when(bare == old, new).otherwise(provider)
    wide = df.select(id_col, *[F.col(c).cast("string").alias(c) for c in cols])
    long = (
        wide.unpivot([id_col], cols, "provider", "external_id")
        .select(id_col, provider.alias("provider"), F.trim("external_id").alias("external_id"))
        .filter(F.col("external_id") != "")
    )
    return long.groupBy("provider", "external_id").agg(F.min(id_col).alias(id_col))


def asof_forward(left: DataFrame, right: DataFrame, by: list[str], left_t: str, right_t: str,
                 payload: list[str], bucket: str = "week") -> DataFrame:
    """Each left row with the nearest right row of its group at or after it; others are dropped.

    No range join: both sides meet in one union, ordered in a window per (group, time bucket).
    A left row with nothing later in its bucket takes the first right row of the group's next
    bucket that has one; that table has one row per group and bucket. A hot group is therefore
    spread over its buckets. Right rows tied on time: the smallest payload wins.
    """
    cut = lambda c: F.date_trunc(bucket, F.col(c).cast("timestamp"))
    # One right row per group and time before anything is sorted: the smallest payload.
    smallest = F.struct(*payload) if len(payload) > 1 else F.col(payload[0])
    one = right.filter(F.col(right_t).isNotNull()).groupBy(*by, right_t).agg(F.min(smallest).alias("_least"))
    right = one.select(*by, right_t, *([F.col("_least").alias(payload[0])] if len(payload) == 1 else ["_least.*"]))
    nearest = F.struct(F.col(right_t).alias("_t"), *payload)
    empty = F.lit(None).cast(right.select(nearest.alias("r")).schema["r"].dataType)
    left_cols = F.struct(*left.columns)
    a = left.select(*by, F.col(left_t).alias("_time"), cut(left_t).alias("_bucket"),
                    F.lit(0).alias("_side"), left_cols.alias("_left"), empty.alias("_right"))
    none_left = F.lit(None).cast(a.schema["_left"].dataType)
    rights = right.filter(F.col(right_t).isNotNull())
    b = rights.select(*by, F.col(right_t).alias("_time"), cut(right_t).alias("_bucket"),
                      F.lit(1).alias("_side"), none_left.alias("_left"), nearest.alias("_right"))
    ahead = (
        Window.partitionBy(*by, "_bucket").orderBy("_time", "_side", "_right")
        .rowsBetween(0, Window.unboundedFollowing)
    )
    rows = (
        a.union(b)
        .withColumn("_hit", F.first("_right", ignorenulls=True).over(ahead))
        .filter("_side = 0")
    )
    # First right row per group and bucket, and for every bucket in use the next one after it.
    first_right = rights.groupBy(*by, cut(right_t).alias("_bucket")).agg(F.min(nearest).alias("_first"))
    used = left.select(*by, cut(left_t).alias("_bucket")).distinct()
    later = (
        Window.partitionBy(*by).orderBy("_bucket").rowsBetween(1, Window.unboundedFollowing)
    )
    next_right = (
        used.unionByName(first_right, allowMissingColumns=True)
        .groupBy(*by, "_bucket").agg(F.min("_first").alias("_first"))
        .withColumn("_next", F.first("_first", ignorenulls=True).over(later))
        .select(*by, "_bucket", "_next")
    )
    found = rows.join(next_right, [*by, "_bucket"], "left").withColumn("_hit", F.coalesce("_hit", "_next"))
    return found.filter(F.col("_hit").isNotNull()).select(
        "_left.*", F.col("_hit._t").alias(right_t),
        *[F.col(f"_hit.{c}").alias(c) for c in payload],
    )


def pregame_snapshot(snapshots: DataFrame, games: DataFrame, entity: str, snapshot_t: str,
                     game_t: str, period: list[str]) -> DataFrame:
    """Rows of the newest snapshot taken on or before each entity's game day.

    Rows that carry their period already, by value and not by column name, pass through without
    duplicates; the others are mapped to the period of the next game.
    """
    columns = [*[c for c in snapshots.columns if c not in period], *period]
    given = [c for c in period if c in snapshots.columns]
    if len(given) == len(period):
        known = all_of([F.col(c).isNotNull() for c in period])
        passed = snapshots.filter(known).select(*columns).distinct()
        snapshots = snapshots.filter(~known)
    else:
        passed = None
    snapshots = snapshots.drop(*given)
    times = snapshots.select(entity, snapshot_t).distinct().withColumn("_day", F.to_date(snapshot_t))
    mapped = asof_forward(times, games.select(entity, game_t, *period).distinct(),
                          [entity], "_day", game_t, period)
    newest = mapped.groupBy(entity, *period).agg(F.max(snapshot_t).alias(snapshot_t))
    mapped = snapshots.join(newest, [entity, snapshot_t]).select(*columns).distinct()
    return mapped if passed is None else passed.unionByName(mapped)


def latest_per_group(df: DataFrame, by: list[str], ts: str) -> DataFrame:
    """All rows at the group's newest time, ties kept; untimed rows count only in untimed frames.

    Written as an aggregate and a join, so a hot group never sits in one window.
    """
    newest = df.groupBy(*by).agg(F.max(ts).alias("_newest"))
    any_time = newest.agg(F.max(F.col("_newest")).isNotNull().alias("t")).scalar()
    joined = df.join(newest, by)
    return joined.filter(
        (F.col(ts) == F.col("_newest")) | ~any_time
    ).drop("_newest")


def asof_snapshot(df: DataFrame, by: list[str], day: str, as_of: Column,
                  strict: bool = False, same_year: bool = False, dated: bool = False) -> DataFrame:
    """Rows of each group's newest snapshot not after (or strictly before) a date.

    `dated` is for a stored table in folders of `day`: the days some group needs (no more than the calendar has) are
    found first, from `by` and `day` alone, and only their folders are read whole. Where `by` are folders too
    (`write_snapshot` with `by`), finding them reads no column.
    """
    usable = F.col(day) < as_of if strict else F.col(day) <= as_of
    if same_year:
        usable = usable & (F.year(day) == F.year(as_of))
    newest = df.filter(usable).groupBy(*by).agg(F.max(day).alias(day))
    if dated:
        # Groups without a name match nothing below, so their days are not wanted.
        df = df.filter(F.array_contains(newest.dropna(subset=by).agg(F.collect_set(day).alias("d")).scalar(), F.col(day)))
    return df.join(newest, [*by, day])


def missing_pages(df: DataFrame, config: DataFrame, by: list[str]) -> DataFrame:
    """Configured groups for which no snapshot was found."""
    return config.join(df, by, "left_anti")


def both_sides(games: DataFrame, home: str, away: str, entity: str = "team", period: list[str] | None = None) -> DataFrame:
    """One row per entity and game, with the opponent and which side it was.

    With a period, reading the result fails when an entity has two games in one period.
    """
    sides = F.array(
        F.struct(F.lit("home").alias("side"), F.col(home).alias(entity), F.col(away).alias("opponent")),
        F.struct(F.lit("away").alias("side"), F.col(away).alias(entity), F.col(home).alias("opponent")),
    )
    rest = [c for c in games.columns if c not in (home, away)]
    out = games.select(*rest, F.inline(sides)).distinct()
    return assert_unique(out, [entity, *period], "more than one game in a period") if period else out


def mirror_opponent(df: DataFrame, entity: str, opponent: str, cols: list[str]) -> DataFrame:
    """Own values, and the same values as `<col>_allowed` of the opponent; one stacked frame."""
    rest = [c for c in df.columns if c not in (entity, opponent, *cols)]
    empty = {c: F.lit(None).cast(df.schema[c].dataType) for c in cols}
    own = F.struct(
        F.lit(True).alias("is_own"), F.col(entity).alias(entity),
        *[F.col(c).alias(c) for c in cols], *[empty[c].alias(f"{c}_allowed") for c in cols],
    )
    other = F.struct(
        F.lit(False).alias("is_own"), F.col(opponent).alias(entity),
        *[empty[c].alias(c) for c in cols], *[F.col(c).alias(f"{c}_allowed") for c in cols],
    )
    return df.select(*rest, F.inline(F.array(own, other)))


def available(pool: DataFrame, taken: DataFrame, id_col: str, name_col: str | None = None) -> DataFrame:
    """Pool rows not taken: by id, and by name key where the taken row has no known id."""
    left = pool.join(taken.filter(F.col(id_col).isNotNull()).select(id_col).distinct(), id_col, "left_anti")
    if name_col is None:
        return left
    nameless = taken.filter(F.col(id_col).isNull()).select(
        S.name_key(F.col(name_col), "ascii").alias("_key")).distinct()
    return left.withColumn("_key", S.name_key(F.col(name_col), "ascii")).join(
        nameless, "_key", "left_anti").drop("_key")


def merge_sources(sources: list[DataFrame], id_col: str, identity: list[str],
                  attachments: list[DataFrame]) -> DataFrame:
    """One row per id; the first source that has it gives its identity; attachments join by id."""
    stacked = None
    for priority, source in enumerate(sources):
        part = source.select(id_col, *identity, F.lit(priority).alias("_priority"))
        stacked = part if stacked is None else stacked.unionByName(part)
    merged = first_by(stacked, [id_col], [F.col("_priority"), *[F.col(c) for c in identity]])
    for extra in attachments:
        merged = merged.join(extra, id_col, "left")
    return merged.withColumnRenamed("_priority", "source_priority")


def opponent_of(matchups: DataFrame, match_col: str, roster_col: str, by: list[str]) -> DataFrame:
    """Each row with the other roster of the same matchup; rows without a matchup keep null.

    A matchup holds two rows, so the smallest and largest roster say who the other one is; this is
    one aggregate instead of a self join that would emit pairs.
    """
    pair = (
        matchups.filter(F.col(match_col).isNotNull()).groupBy(*by, match_col)
        .agg(F.min(roster_col).alias("_low"), F.max(roster_col).alias("_high"))
    )
    other = F.when(F.col(roster_col) == F.col("_low"), F.col("_high")).otherwise(F.col("_low"))
    return (
        matchups.join(pair, [*by, match_col], "left")
        .withColumn("opponent_id", F.nullif(other, F.col(roster_col)))
        .drop("_low", "_high")
    )


_COMPARE = {
    "eq": lambda c, v: c == F.lit(v),
    "in": lambda c, v: c.isin(list(v)),
    "gte": lambda c, v: c >= F.lit(v),
    "lte": lambda c, v: c <= F.lit(v),
}


class Criterion(NamedTuple):
    table: str
    field: str
    op: str
    value: object


def select_entities(base: DataFrame, tables: Mapping[str, DataFrame], criteria: list[Criterion],
                    id_col: str, allowed: Mapping[str, set[str]], seasonal: set[str] = frozenset(),
                    season: int | None = None) -> tuple[DataFrame, list[Criterion]]:
    """Ids that meet every criterion (intersection over tables), and the unresolved criteria.

    A criterion on a field that is not allowed is an error; one on a seasonal table without a
    season is reported back as unresolved.
    """
    unresolved, per_table = [], {}
    for c in criteria:
        if c.op not in _COMPARE or c.field not in allowed.get(c.table, set()):
            raise ValueError(f"criterion not allowed: {c}")
        if c.table in seasonal and season is None:
            unresolved.append(c)
        else:
            per_table.setdefault(c.table, []).append(_COMPARE[c.op](F.col(c.field), c.value))
    out = base
    for name, conditions in per_table.items():
        source = tables[name].filter(all_of(conditions))
        if name in seasonal:
            source = source.filter(F.col("season") == season)
        out = out.join(source.select(id_col), id_col, "left_semi")
    return out, unresolved


def membership(df: DataFrame, array_col: str, values: list[str]) -> DataFrame:
    """Rows whose list holds the value (one value) or any of the values (several)."""
    if len(values) == 1:
        return df.filter(F.array_contains(array_col, values[0]))
    return df.filter(F.arrays_overlap(array_col, F.lit(list(values))))


def latest_membership(rosters: DataFrame, entity: str, season: str, week: str, keep: list[str]) -> DataFrame:
    """Latest roster week per entity and season."""
    return (
        rosters.groupBy(entity, season)
        .agg(F.max_by(F.struct(week, *keep), F.struct(week, *keep)).alias("_r"))
        .select(entity, season, "_r.*")
    )


def hydrate(ids: DataFrame, profiles: DataFrame, status: DataFrame, teams: DataFrame,
            id_col: str = "player_id") -> DataFrame:
    """Profile and status per id; ids of 2-4 capital letters fall back to team rows; others stay.

    profiles: id, display_name, position. status: id, status. teams: code, team_name.
    """
    joined = ids.join(profiles, id_col, "left").join(status, id_col, "left")
    team_like = F.col(id_col).rlike("^[A-Z]{2,4}$") & F.col("display_name").isNull()
    code = F.when(team_like, F.col(id_col))
    # Few ids are team codes: the others have none and spread over all tasks.
    joined = left_join_spread(joined.withColumn("_code", code), teams.withColumnRenamed("code", "_code"), "_code")
    kind = (
        F.when(F.col("display_name").isNotNull(), "player")
        .when(F.col("team_name").isNotNull(), "team").otherwise("placeholder")
    )
    return joined.select(
        id_col, kind.alias("kind"),
        F.coalesce("display_name", "team_name", id_col).alias("display_name"),
        F.coalesce("position", F.when(F.col("team_name").isNotNull(), "DEF")).alias("position"),
        "status",
    )


def with_fallback(primary: DataFrame, secondary: DataFrame, by: list[str], season_col: str,
                  current_season: Column, labels: tuple[str, str]) -> DataFrame:
    """Secondary rows only for groups without primary rows and only for the current season."""
    extra = secondary.filter(F.col(season_col) == current_season).join(
        primary.select(*by).distinct(), by, "left_anti")
    return primary.withColumn("source_snapshot", F.lit(labels[0])).unionByName(
        extra.withColumn("source_snapshot", F.lit(labels[1])))


def link_names(docs: DataFrame, doc_id: str, names_col: str, entities: DataFrame,
               entity_id: str, name_col: str) -> DataFrame:
    """Distinct sorted entity ids per document by case-insensitive name equality."""
    mentions = docs.select(doc_id, F.explode(F.array_distinct(F.transform(names_col, F.lower))).alias("_name")).distinct()
    # Namesakes are gathered per name first: a mention meets one row of its name, not every bearer.
    named = entities.filter(F.col(name_col).isNotNull()).groupBy(F.lower(name_col).alias("_name")).agg(
        F.collect_set(entity_id).alias("_ids"))
    return mentions.join(named, "_name").groupBy(doc_id).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("_ids")))).alias("entity_ids"))


def new_by_url(docs: DataFrame, existing: DataFrame, url: str = "url") -> DataFrame:
    """Documents whose normalised URL is not stored yet."""
    stored = existing.select(S.normalize_url(F.col(url)).alias("normalized_url")).distinct()
    return docs.withColumn("normalized_url", S.normalize_url(F.col(url))).join(
        stored, "normalized_url", "left_anti")
