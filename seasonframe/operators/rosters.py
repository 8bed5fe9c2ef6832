"""Roster, lineup and league operators."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Positions that may fill the flexible slot types.
FLEX_ELIGIBILITY = {
    "FLEX": ["RB", "WR", "TE"],
    "REC_FLEX": ["WR", "TE"],
    "WRRB_FLEX": ["RB", "WR"],
    "SUPER_FLEX": ["QB", "RB", "WR", "TE"],
    "IDP_FLEX": ["DL", "LB", "DB"],
}
# From the narrowest to the widest; a roster that is solved has at most one of the first two.
FLEX_LEVELS = ["REC_FLEX", "WRRB_FLEX", "FLEX", "SUPER_FLEX", "IDP_FLEX"]
CORE_POSITIONS = ["QB", "RB", "WR", "TE"]


def open_slots(picks: DataFrame, by: list[str], position: str, need: Mapping[str, int]) -> DataFrame:
    """Open starter slots per roster: base need first, flex from RB/WR/TE excess, super-flex from the rest."""
    counts = picks.groupBy(*by).agg(
        *[F.count_if(F.col(position) == p).alias(f"have_{p}") for p in CORE_POSITIONS])
    have = {p: F.col(f"have_{p}") for p in CORE_POSITIONS}
    zero = F.lit(0)
    excess = {p: F.greatest(zero, have[p] - need.get(p, 0)) for p in CORE_POSITIONS}
    flex_excess = excess["RB"] + excess["WR"] + excess["TE"]
    flex = F.least(F.lit(need.get("FLEX", 0)), flex_excess)
    rest = flex_excess + excess["QB"] - flex
    return counts.select(
        *by, *have.values(),
        *[F.greatest(zero, need.get(p, 0) - have[p]).alias(f"open_{p}") for p in CORE_POSITIONS],
        (need.get("FLEX", 0) - flex).alias("open_FLEX"),
        (need.get("SUPER_FLEX", 0) - F.least(F.lit(need.get("SUPER_FLEX", 0)), rest)).alias("open_SUPER_FLEX"))


def flatten_transactions(tx: DataFrame) -> DataFrame:
    """One row per player move: the adds and drops maps exploded, millisecond epoch to UTC time."""
    def entries(field: str, action: str) -> Column:
        pairs = F.map_entries(F.coalesce(F.col(field), F.create_map().cast("map<string,int>")))
        return F.transform(pairs, lambda e: F.struct(
            F.lit(action).alias("action"), e["key"].alias("player_id"), e["value"].alias("roster_id")))

    moves = F.concat(entries("adds", "add"), entries("drops", "drop"))
    return tx.select(
        "transaction_id", "type", "status", F.timestamp_millis("created_ms").alias("created_at"), F.inline(moves))


def trend_counts(moves: DataFrame) -> DataFrame:
    """How often each player was added and dropped."""
    return moves.groupBy("player_id").agg(
        F.count_if(F.col("action") == "add").alias("n_adds"),
        F.count_if(F.col("action") == "drop").alias("n_drops"))


def roster_groups(rosters: DataFrame, by: list[str]) -> DataFrame:
    """One row per rostered player with its group, slot and place; points = fpts + decimal / 100.

    players, starters, reserve, taxi, slots are arrays of one roster; bench is what is in none.
    """
    empty = F.array().cast("array<string>")
    lists = {c: F.coalesce(F.col(c), empty) for c in ("players", "starters", "reserve", "taxi", "slots")}
    bench = F.array_except(F.array_except(F.array_except(
        lists["players"], lists["starters"]), lists["reserve"]), lists["taxi"])

    def entries(items: Column, group: str, slots: Column | None = None) -> Column:
        return F.transform(items, lambda p, i: F.struct(
            F.lit(group).alias("roster_group"), (i + 1).alias("place"), p.alias("player_id"),
            (F.get(slots, i) if slots is not None else F.lit(None).cast("string")).alias("slot")))

    all_rows = F.concat(
        entries(lists["starters"], "starter", lists["slots"]), entries(bench, "bench"),
        entries(lists["reserve"], "reserve"), entries(lists["taxi"], "taxi"))
    points = F.coalesce("fpts", F.lit(0)) + F.coalesce("fpts_decimal", F.lit(0)) / 100
    return rosters.select(*by, points.alias("points_for"), F.inline(all_rows))


def lineup_totals(starters: DataFrame, by: list[str], points: str, name: str) -> DataFrame:
    """Rounded total of projected points per roster; null when no starter has a projection."""
    return starters.groupBy(*by).agg(
        F.bround(F.sum(points).cast("double"), 2).alias(name),
        F.count(points).alias(f"{name}_projected"), F.count(F.lit(1)).alias(f"{name}_starters"))


def eligible_slots(position: Column) -> Column:
    """Slot types a position may fill: its own and the flexible ones that list it."""
    flex = [F.when(position.isin(ps), s) for s, ps in FLEX_ELIGIBILITY.items()]
    return F.filter(F.array(position, *flex), lambda x: x.isNotNull())


def best_lineup(players: DataFrame, slots: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Best legal lineup of every roster at once: most slots filled, then most points.

    players: by, player_id, position, points, usable (bool), locked_slot (null when free).
    slots: by, slot_type, n_slots (one row per roster and type).
    Slot types nest (base position within REC_FLEX or WRRB_FLEX within FLEX within SUPER_FLEX, and
    base position within IDP_FLEX) and a player has one position, so one top-n pass per level is
    exact. Locked starters keep their slot and use it up. Only REC_FLEX beside WRRB_FLEX overlaps
    without nesting; rosters with both are returned apart, not solved.
    A roster is a small group by nature; every window is one roster or one of its positions.
    """
    overlapping = (
        slots.filter(F.col("slot_type").isin("REC_FLEX", "WRRB_FLEX") & (F.col("n_slots") > 0))
        .groupBy(*by).agg(F.count_distinct("slot_type").alias("_kinds")).filter("_kinds = 2").drop("_kinds")
    )
    candidates = players.join(overlapping, by, "left_anti")
    locked = candidates.filter(F.col("locked_slot").isNotNull()).withColumn("slot_type", F.col("locked_slot"))
    used = locked.groupBy(*by, "slot_type").agg(F.count(F.lit(1)).alias("_used"))
    room = (
        slots.join(used, [*by, "slot_type"], "left")
        .withColumn("_room", F.greatest(F.lit(0), F.col("n_slots") - F.coalesce("_used", F.lit(0))))
        .groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("slot_type", "_room"))).alias("_rooms"))
    )
    free = candidates.filter(F.col("locked_slot").isNull() & F.col("usable")).join(room, by)
    # Each row takes along the numbers it may need, not the map.
    seats = lambda slot: F.coalesce(F.try_element_at("_rooms", slot), F.lit(0))
    free = free.select(
        *by, "player_id", "position", "points", F.coalesce("points", F.lit(0)).alias("_p"),
        seats(F.col("position")).alias("_base"), *[seats(F.lit(s)).alias(f"_{s}") for s in FLEX_LEVELS])
    best_first = [F.col("_p").desc(), F.col("player_id").asc()]
    rank = F.row_number().over(Window.partitionBy(*by, "position").orderBy(*best_first))
    rows = free.withColumn("slot_type", F.when(rank <= F.col("_base"), F.col("position")))
    # All levels count those who wait along one order of the roster, so one sort serves them.
    so_far = Window.partitionBy(*by).orderBy(*best_first).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for flex in FLEX_LEVELS:
        waiting = F.col("slot_type").isNull() & F.col("position").isin(FLEX_ELIGIBILITY[flex])
        rows = rows.withColumn("_place", F.count(F.when(waiting, 1)).over(so_far)).withColumn(
            "slot_type", F.when(waiting & (F.col("_place") <= F.col(f"_{flex}")), F.lit(flex)).otherwise(F.col("slot_type")))
    keep = [*by, "player_id", "position", "slot_type", "points"]
    lineup = rows.filter(F.col("slot_type").isNotNull()).select(*keep).unionByName(locked.select(*keep))
    return lineup, overlapping


def kickoff_slates(players: DataFrame, by: list[str], kickoff: str, as_of: Column, lead_minutes: int,
                   listed: tuple[str, str, str] | None = None) -> DataFrame:
    """Per roster and exact kickoff after `as_of`: starters and bench to review, order, and whether due.

    `listed` = (slot, name, id) adds `players`, the ids of a slate: starters first, then by slot and name. A
    slate is part of one roster, so the list is short.
    """
    if lead_minutes < 1:
        raise ValueError("lead_minutes must be positive")
    open_rows = players.filter(F.col("roster_group").isin("starter", "bench") & (F.col(kickoff) > as_of))
    extra = []
    if listed:
        slot, name, player = listed
        place = F.struct((F.col("roster_group") != "starter").alias("late"), F.coalesce(slot, F.lit("")).alias("slot"),
                         F.col(name).alias("name"), F.col(player).alias("id"))
        extra = [F.transform(F.array_sort(F.collect_list(place)), lambda x: x["id"]).alias("players")]
    slates = open_rows.groupBy(*by, kickoff).agg(
        *extra,
        F.count_if(F.col("roster_group") == "starter").alias("n_starters"),
        F.count_if(F.col("roster_group") == "bench").alias("n_bench"))
    next_kickoff = slates.groupBy(*by).agg(F.min(kickoff).alias("_next"))
    opens = F.col(kickoff) - F.expr(f"interval {int(lead_minutes)} minutes")
    return slates.join(next_kickoff, by).select(
        *by, kickoff, *(["players"] if listed else []), "n_starters", "n_bench", (F.col(kickoff) == F.col("_next")).alias("is_next"),
        ((opens <= as_of) & (as_of < F.col(kickoff))).alias("is_due"))


def lineup_diff(current: DataFrame, proposed: DataFrame, by: list[str], slot: str, player: str,
                due: DataFrame | None = None) -> DataFrame:
    """Changed slots with the player going out and in; due now when either plays in a due slate."""
    a = current.select(*by, slot, F.col(player).alias("outgoing"), F.lit(True).alias("_has_slot"))
    b = proposed.select(*by, slot, F.col(player).alias("incoming"))
    changed = a.join(b, [*by, slot], "full").filter(~F.col("outgoing").eqNullSafe(F.col("incoming")))
    changed = changed.withColumn("known_slot", F.coalesce("_has_slot", F.lit(False))).drop("_has_slot")
    if due is None:
        return changed
    now = due.select(*by, F.col(player).alias("_d")).distinct().withColumn("_due", F.lit(True))
    for side in ("outgoing", "incoming"):
        changed = changed.join(
            now.withColumnRenamed("_d", side).withColumnRenamed("_due", f"_due_{side}"), [*by, side], "left")
    return changed.withColumn(
        "due_now", F.coalesce("_due_outgoing", F.lit(False)) | F.coalesce("_due_incoming", F.lit(False))
    ).drop("_due_outgoing", "_due_incoming")


def lineup_problems(proposed: DataFrame, players: DataFrame, slots: DataFrame, by: list[str]) -> DataFrame:
    """Broken lineup rules, one row per (roster, slot, rule).

    proposed: by, slot_id, player_id. players: by, player_id, position, usable. slots: by, slot_id, slot_type.
    """
    filled = proposed.join(slots, [*by, "slot_id"], "left").join(
        players.select(*by, "player_id", "position", "usable"), [*by, "player_id"], "left")
    counts = proposed.filter(F.col("player_id").isNotNull()).groupBy(*by, "player_id").agg(
        F.count(F.lit(1)).alias("_uses"))
    per_slot = proposed.groupBy(*by, "slot_id").agg(F.count(F.lit(1)).alias("_in_slot"))
    filled = filled.join(counts, [*by, "player_id"], "left").join(per_slot, [*by, "slot_id"])
    # Unused players that could still play, counted per position: one row per roster and position.
    spare = (
        players.filter("usable").join(
            proposed.filter(F.col("player_id").isNotNull()).select(*by, "player_id"), [*by, "player_id"], "left_anti")
        .groupBy(*by).agg(F.collect_set("position").alias("_spare"))
    )
    filled = filled.join(spare, by, "left")
    takers = F.when(F.col("slot_type").isin(list(FLEX_ELIGIBILITY)),
                    F.element_at(F.create_map(*[x for k, v in FLEX_ELIGIBILITY.items() for x in (F.lit(k), F.lit(v))]),
                                 F.col("slot_type"))).otherwise(F.array("slot_type"))
    has = F.col("player_id").isNotNull()
    rules = {
        "unknown slot": F.col("slot_type").isNull(),
        "slot given twice": F.col("_in_slot") > 1,
        "player not on roster": has & F.col("position").isNull(),
        "player used twice": has & (F.col("_uses") > 1),
        "player not eligible": has & F.col("position").isNotNull()
            & (~F.array_contains(eligible_slots(F.col("position")), F.col("slot_type")) | ~F.col("usable")),
        "fillable slot left empty": ~has & F.arrays_overlap(takers, "_spare"),
    }
    broken = F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), n) for n, bad in rules.items()]),
                      lambda x: x.isNotNull())
    return filled.select(*by, "slot_id", "player_id", F.explode(broken).alias("rule"))
