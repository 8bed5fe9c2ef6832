"""Ranks, leaderboards, top-k, shortlists."""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import all_of, counts_below, numbered
from ..functions.formulas import INVALID, ZERO, compile_formula
from ..functions.scalars import literal_map, ratio, snake_pick


def competition_ranks(df: DataFrame, value: str, ranks: Mapping[str, list[str]], desc: bool = False) -> DataFrame:
    """Add ranks 1, 2, 2, 4 of one value under several groupings {name: group columns}; a null sorts as 0.

    A rank is one more than the rows that sort before, taken from counts per distinct value, so
    neither a hot group nor the whole table passes through one window. Nothing runs while the plan is
    built.
    """
    out = keyed = df.withColumn("_v", F.coalesce(F.col(value), F.lit(0)))
    for name, by in ranks.items():
        below = counts_below(keyed, "_v", by, desc).withColumn(name, F.col("n_before") + 1)
        same = all_of([F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*by, "_v"]])
        out = out.alias("l").join(below.alias("r"), same).select("l.*", f"r.{name}")
    return out.drop("_v")


def competition_rank(df: DataFrame, value: str, by: list[str] | None = None, desc: bool = False,
                     name: str = "rank") -> DataFrame:
    """One competition rank, within a group or over all rows."""
    return competition_ranks(df, value, {name: by or []}, desc)


def rank_of_one(df: DataFrame, value: str, wanted: Column) -> DataFrame:
    """Rank of a single row: one more than the rows with a lower value."""
    mine = df.filter(wanted).agg(F.max(value).alias("v")).scalar()
    return df.filter(F.col(value) < mine).agg((F.count(F.lit(1)) + 1).alias("rank"))


class FormulaRanking(NamedTuple):
    results: DataFrame
    zero_denominator: DataFrame
    counts: DataFrame


def rank_by_formula(df: DataFrame, formula: str, allowed: list[str], id_col: str,
                    minimum: tuple[str, float] | None = None, direction: str = "desc",
                    limit: int = 10, keep: list[str] | None = None) -> FormulaRanking:
    """Top rows by a user formula; zero denominators apart; eligible and invalid rows counted.

    The cut comes first (top-k per task, then one short merge); only the cut rows are numbered.
    """
    if direction not in ("asc", "desc"):
        raise ValueError("direction must be asc or desc")
    if limit < 1:
        raise ValueError("limit must be positive")
    compiled = compile_formula(formula, allowed)
    keep = list(dict.fromkeys([*(keep or []), *compiled.fields, *([minimum[0]] if minimum else [])]))
    if minimum and minimum[0] not in allowed:
        raise ValueError(f"minimum field {minimum[0]!r} is not allowed")
    eligible = df.filter(F.col(minimum[0]) >= minimum[1]) if minimum else df
    scored = eligible.select(
        id_col, *[c for c in keep if c != id_col],
        compiled.value.alias("metric_value"), compiled.status.alias("_status"))
    value = F.col("metric_value")
    order = [value.desc() if direction == "desc" else value.asc(), F.col(id_col).asc()]
    top = scored.filter(F.col("_status").isNull()).drop("_status").orderBy(*order).limit(limit)
    results = numbered(top, order).withColumn("metric_value", F.bround("metric_value", 6))
    zero = scored.filter(F.col("_status") == ZERO).drop("_status", "metric_value").orderBy(id_col).limit(limit)
    counts = scored.agg(
        F.count(F.lit(1)).alias("eligible"), F.count_if(F.col("_status") == INVALID).alias("invalid"),
        F.count_if(F.col("_status") == ZERO).alias("zero_denominator"))
    return FormulaRanking(results, zero, counts)


def leaderboard(df: DataFrame, sort_by: str, id_col: str, direction: str = "asc",
                filters: list[Column] | None = None, limit: int = 20) -> DataFrame:
    """Filtered top rows; nulls last in both directions, ties by id; numbered after the cut."""
    key = F.col(sort_by).desc_nulls_last() if direction == "desc" else F.col(sort_by).asc_nulls_last()
    order = [key, F.col(id_col).asc()]
    return numbered(df.filter(all_of(filters or [])).orderBy(*order).limit(limit), order, "place")


def snapshot_ranks(df: DataFrame, rank_col: str, group_col: str, best: str, worst: str) -> DataFrame:
    """Position rank of a snapshot and the spread between worst and best rank (null-safe)."""
    grouped = df.withColumn("_g", F.coalesce(F.col(group_col), F.lit("UNKNOWN")))
    ranked = competition_rank(grouped, rank_col, ["_g"], name="position_rank").drop("_g")
    return ranked.withColumn("rank_range", F.col(worst) - F.col(best))


def expected_vs_actual(ranks: DataFrame, results: DataFrame, id_col: str, group_col: str,
                       rank_col: str, position_rank_col: str, points: str, games: str) -> DataFrame:
    """Every ranked entity with its actual finish; no result means 0 games and 0 points.

    Finishes rank the union of results and ranked entities, overall and per group. That union is one full join, which
    carries what the result needs, so neither input is joined again; both hold an id once.
    """
    placed = ranks.select(id_col, F.struct(*ranks.columns).alias("_ranked"))
    actual = results.select(id_col, F.struct(F.col(group_col).alias("g"), F.col(games).alias("n"), F.col(points).alias("p")).alias("_actual"))
    group = F.when(F.col("_actual").isNotNull(), F.col("_actual.g")).otherwise(F.col(f"_ranked.{group_col}"))
    pool = placed.join(actual, id_col, "full").select(
        "_ranked", "_actual", F.coalesce(group, F.lit("UNKNOWN")).alias("_g"), F.coalesce("_actual.p", F.lit(0)).alias("_p"))
    finish = competition_ranks(
        pool, "_p", {"actual_overall_finish": [], "actual_position_finish": ["_g"]}, desc=True)
    n = F.coalesce("_actual.n", F.lit(0))
    total = F.coalesce("_actual.p", F.lit(0)).cast("double")
    joined = finish.filter(F.col("_ranked").isNotNull()).select(
        "_ranked.*", n.alias("games"), F.bround(total, 6).alias("points"),
        ratio(total, n, digits=6).alias("points_per_game"), "actual_overall_finish", "actual_position_finish")
    return joined.withColumns({
        "overall_rank_difference": F.bround(F.col(rank_col) - F.col("actual_overall_finish"), 6),
        "position_rank_difference": F.col(position_rank_col) - F.col("actual_position_finish")})


OUTPERFORMER_SORTS = ["rank_difference", "expected_rank", "actual_finish", "points", "points_per_game"]


def outperformers(compared: DataFrame, id_col: str, basis: str, rank_col: str, position_rank_col: str,
                  min_games: int | None, rank_range: tuple, sort_by: str, direction: str,
                  limit: int) -> DataFrame:
    """Leaderboard of expected against actual on the overall or the position basis."""
    if sort_by not in OUTPERFORMER_SORTS:
        raise ValueError(f"sort_by must be one of {OUTPERFORMER_SORTS}")
    overall = basis == "overall"
    chosen = compared.withColumns({
        "expected_rank": F.col(rank_col if overall else position_rank_col).cast("double"),
        "actual_finish": F.col("actual_overall_finish" if overall else "actual_position_finish"),
        "rank_difference": F.col("overall_rank_difference" if overall else "position_rank_difference").cast("double"),
    })
    low, high = rank_range
    filters = []
    if min_games is not None:
        filters.append(F.col("games") >= min_games)
    if low is not None:
        filters.append(F.col("expected_rank") >= low)
    if high is not None:
        filters.append(F.col("expected_rank") <= high)
    return leaderboard(chosen, sort_by, id_col, direction, filters, limit)


def best_per_group(df: DataFrame, entity: str, team: str, position: str, points: str, game: str,
                   mode: str = "total") -> DataFrame:
    """Best entity per (team, position) by total or per-game points; ties by total, then id.

    An ordered aggregate, so a hot (team, position) group shrinks before the shuffle.
    """
    totals = df.groupBy(entity, team, position).agg(
        F.sum(points).cast("double").alias("total_points"), F.count_distinct(game).alias("games"))
    score = ratio(F.col("total_points"), F.col("games"), digits=None) if mode == "ppg" else F.col("total_points")
    scored = totals.withColumn("score", score)
    rank_key = F.struct(-F.col("score"), -F.col("total_points"), F.col(entity))
    return scored.groupBy(team, position).agg(
        F.min_by(F.struct(entity, "score", "total_points", "games"), rank_key).alias("_b")).select(
        team, position, "_b.*")


def balanced_shortlist(df: DataFrame, rank_col: str, id_col: str, group_col: str, groups: list[str],
                       n: int, k: int = 3) -> DataFrame:
    """The best max(8, n-8) overall plus the k best of each listed group, cut to n by rank."""
    order = [F.col(rank_col).asc(), F.col(id_col).asc()]
    overall = df.orderBy(*order).limit(max(8, n - 8))
    in_group = Window.partitionBy(group_col).orderBy(*order)
    grouped = (
        df.filter(F.col(group_col).isin(groups)).withColumn("_rn", F.row_number().over(in_group))
        .filter(F.col("_rn") <= k).drop("_rn")
    )
    picked = overall.unionByName(grouped).dropDuplicates([id_col])
    return numbered(picked.orderBy(*order).limit(n), order, "place")


def slot_picks(drafts: DataFrame, teams: Column, slot: Column, rounds: Column, current: Column) -> DataFrame:
    """The next two overall picks of a draft slot from the current pick on (null when none is left)."""
    picks = F.transform(F.sequence(F.lit(1), rounds.cast("int")), lambda r: snake_pick(r, slot, teams))
    ahead = F.filter(picks, lambda p: p >= current)
    return drafts.withColumns({"next_pick": F.get(ahead, 0), "following_pick": F.get(ahead, 1)})


def rank_available(df: DataFrame, sort_by: str, current_week: Column | None, limit: int) -> DataFrame:
    """Ranked available players by market value, trend, expert rank or projection; ties by name, then id.

    Columns: player_id, display_name, market_value, trend, expert_rank, projected_points, projection_week.
    """
    value = F.coalesce("market_value", F.lit(0)).desc()
    down = lambda c: [F.col(c).isNull().asc(), F.coalesce(c, F.lit(0)).desc()]
    chains = {
        "market_value": down("market_value"),
        "trend": [*down("trend"), value],
        "expert_rank": [F.col("expert_rank").asc_nulls_last(), value],
        "projected_points": [
            (~F.coalesce(F.col("projection_week") == current_week, F.lit(False))).asc(),
            *down("projected_points"), value,
        ] if current_week is not None else [],
    }
    order = [*chains[sort_by], F.col("display_name").asc(), F.col("player_id").asc()]
    return numbered(df.orderBy(*order).limit(limit), order, "place")


def lookahead_rank(projections: DataFrame, entity: str, name: str, week_col: str, points: str,
                   weeks: list[int], taken: DataFrame, held: DataFrame, limit: int) -> DataFrame:
    """Free entities by projected points over some weeks: full coverage, average, opening week, name.

    `advantage` compares the opening week with the best entity already held.
    """
    by_week = projections.filter(F.col(week_col).isin(weeks)).groupBy(entity).agg(
        F.min_by(name, week_col).alias(name),
        *[F.max(F.when(F.col(week_col) == w, F.col(points))).alias(f"week_{w}") for w in weeks])
    cols = [F.col(f"week_{w}") for w in weeks]
    covered = sum((c.isNotNull().cast("int") for c in cols), F.lit(0))
    total = sum((F.coalesce(c, F.lit(0)) for c in cols), F.lit(0)).cast("double")
    opening = F.col(f"week_{weeks[0]}")
    table = by_week.withColumn("covered", covered).withColumns({
        "total": F.when(F.col("covered") > 0, F.bround(total, 2)),
        "average": ratio(total, F.col("covered"), digits=2)})
    best_held = table.join(held.select(entity), entity, "left_semi").agg(F.max(opening).alias("m")).scalar()
    order = [(F.col("covered") < len(weeks)).asc(), F.coalesce("average", F.lit(0)).desc(),
             F.coalesce(opening, F.lit(0)).desc(), F.col(name).asc(), F.col(entity).asc()]
    free = table.filter(opening.isNotNull()).join(taken.select(entity), entity, "left_anti")
    top = free.orderBy(*order).limit(limit)
    return numbered(top, order, "place").withColumn("advantage", F.bround(opening.cast("double") - best_held, 2))


def top_n_per_group(df: DataFrame, by: str, value: str, tie: list[str], n_map: Mapping[str, int]) -> DataFrame:
    """The best n rows of each group, n given per group; null values and unlisted groups out.

    The widest n bounds the window first (per task, before the shuffle), then each group's own n.
    """
    window = Window.partitionBy(by).orderBy(F.col(value).desc(), *tie)
    ranked = (
        df.filter(F.col(value).isNotNull() & F.col(by).isin(list(n_map)))
        .withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= max(n_map.values()))
    )
    return ranked.filter(F.col("rank") <= F.element_at(literal_map(dict(n_map)), F.col(by)))


def numbered_slots(df: DataFrame, by: list[str], slot_type: str, order: list[str]) -> DataFrame:
    """`RB1`, `RB2` when a slot type repeats in a roster, plain `RB` when it is single."""
    group = Window.partitionBy(*by, slot_type)
    place = F.row_number().over(group.orderBy(*order)).cast("string")
    size = F.count(F.lit(1)).over(group)
    return df.withColumn(
        "slot_id", F.when(size > 1, F.concat(F.col(slot_type), place)).otherwise(F.col(slot_type)))


def priority_queue(sources: list[DataFrame], id_col: str, rank_col: str, mapped: DataFrame, limit: int) -> DataFrame:
    """Ordered union of ranked lists: the first source that has an id wins; only mapped ids; cut to limit."""
    stacked = None
    for priority, source in enumerate(sources):
        part = source.select(id_col, F.lit(priority).alias("priority"), F.col(rank_col).alias("source_rank"))
        stacked = part if stacked is None else stacked.unionByName(part)
    key = F.struct("priority", "source_rank")
    firsts = stacked.groupBy(id_col).agg(F.min(key).alias("_k")).select(id_col, "_k.*")
    order = [F.col("priority"), F.col("source_rank"), F.col(id_col)]
    top = firsts.join(mapped.select(id_col), id_col, "left_semi").orderBy(*order).limit(limit)
    return numbered(top, order, "place")


def stat_lookup(df: DataFrame, filters: list[Column], fields: list[str], order: list[Column],
                limit: int | None = None) -> DataFrame:
    """Filtered, ordered rows of the chosen fields; the filters reach the scan."""
    out = df.filter(all_of(filters)).select(*fields).orderBy(*order)
    return out if limit is None else out.limit(limit)


# Which stat view a position opens by default.
DEFAULT_VIEWS = {"QB": "passing", "RB": "rushing", "FB": "rushing", "WR": "receiving", "TE": "receiving"}


def default_view(position: Column) -> Column:
    """Default stat view of a position."""
    return F.coalesce(F.try_element_at(literal_map(DEFAULT_VIEWS), F.upper(position)), F.lit("fantasy"))


def find_by_name(df: DataFrame, name: str, text: str, limit: int | None = None) -> DataFrame:
    """Rows whose name contains the text, ignoring case, ordered by name."""
    found = df.filter(F.lower(name).contains(text.strip().lower())).orderBy(name)
    return found if limit is None else found.limit(limit)
