"""What one task has to hold at once, read from the plans."""

from pyspark.sql import functions as F

from seasonframe.operators import aggregates as agg
from seasonframe.operators import rosters as ro
from seasonframe.plans import load_all
from seasonframe.plans.registry import QUERIES


def lines_of(df):
    return [line.lstrip(" :+-*()0123456789") for line in df._jdf.queryExecution().executedPlan().toString().splitlines()]


def test_best_lineup_sorts_a_roster_once_for_all_flex_levels(spark):
    players = spark.createDataFrame(
        [(r, p, "QB RB WR TE DL".split()[p % 5], float((p * 7 + r) % 11), True, None) for r in range(3) for p in range(20)],
        "r int, player_id int, position string, points double, usable boolean, locked_slot string")
    slots = spark.createDataFrame([(r, s, 1) for r in range(3) for s in ("QB", "RB", "REC_FLEX", "FLEX", "SUPER_FLEX", "IDP_FLEX")],
                                  "r int, slot_type string, n_slots int")
    lineup = ro.best_lineup(players, slots, ["r"])[0]
    sorts = [line for line in lines_of(lineup) if line.startswith("Sort [") and " DESC" in line]
    # One by position, one for the whole roster; the rows in them carry no map of rooms.
    assert len(sorts) == 2
    assert all("_rooms" not in line for line in lines_of(lineup) if line.startswith("Window ["))
    got = {(x.r, x.player_id): x.slot_type for x in lineup.collect()}
    assert len(got) == 18 and all(sum(k[0] == r for k in got) == 6 for r in range(3))


def test_weeks_of_a_season_are_no_rows(spark):
    # Rows per sort follow entities and facts: neither seasons nor weeks are joined or sorted as rows of their own.
    load_all()
    out = QUERIES["A6_threshold_team_games"](spark, "/root/testdata/sf0.001")
    lines = lines_of(out)
    assert not [x for x in lines if x.startswith(("Sort [season", "Exchange hashpartitioning(season")) and "week" in x]
    assert not [x for x in lines if x.startswith("SortAggregate(key=[entity") and "_p" in x]


def test_participation_in_lists_is_the_same_as_in_rows(spark):
    facts = spark.createDataFrame(
        [("p", 1, "QB", 10.0, 2.0), ("p", 2, "QB", None, 1.0), ("p", 3, "QB", 4.0, 0.0), ("r", 2, "K", 7.0, 1.0), (None, 1, "X", 1.0, 1.0)],
        "e string, week int, pos string, y double, a double")
    lists = spark.createDataFrame(
        [("p", [1, 4], "WR", ["ACT", None]), ("p", [5], "TE", ["RES"]), ("q", [1, 2], "K", ["RES", "ACT"]), ("s", [], "K", []), (None, [1, 2], "Y", ["ACT", "ACT"])],
        "e string, week array<int>, pos string, status array<string>")
    rows = lists.select("e", "pos", F.inline(F.arrays_zip("week", "status")))
    for basis in agg.BASES:
        for formula in ("y", "y / a"):
            a, b = (sorted(map(str, agg.threshold_analysis(facts, x, ["e"], "week", ["pos"], formula, ["y", "a"], "gte", 5, basis)
                               .where("team_games + stat_row_games > 0").collect())) for x in (lists, rows))
            assert a == b and a
