"""Queries of the roster, lineup and league operators.

A roster is twenty consecutive customers, so the number of rosters grows with the data and a
roster stays small. A market segment is a position.
"""

from pyspark.sql import functions as F

from ..functions.scalars import literal_map
from ..operators import ranking as rk
from ..operators import rosters as ro
from .inputs import FACTS, MONEY, facts, table
from .registry import query

POSITION = {"BUILDING": "QB", "MACHINERY": "RB", "HOUSEHOLD": "WR", "FURNITURE": "TE", "AUTOMOBILE": "K"}
NEED = {"QB": 1, "RB": 2, "WR": 2, "TE": 1, "FLEX": 1, "SUPER_FLEX": 1}
SLOT_LIST = ["QB", "RB", "RB", "WR", "WR", "TE", "FLEX"]

_POSITION_SQL = "CASE c_mktsegment " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in POSITION.items()) + " END"
PLAYERS = FACTS + f""", proj AS (
  SELECT entity, round(sum(points) / 1000, 2)::DOUBLE AS points,
         arg_max(status, (day, game)) AS status, min(day) FILTER (WHERE day >= DATE '1998-06-01') AS next_day
  FROM facts GROUP BY entity),
players AS (
  SELECT c_custkey // 20 AS roster, c_custkey AS player_id, {_POSITION_SQL} AS position, points,
         status IS DISTINCT FROM 'P' AS usable, next_day, c_acctbal AS balance,
         CASE WHEN c_acctbal < -900 THEN {_POSITION_SQL} END AS locked_slot,
         row_number() OVER (PARTITION BY c_custkey // 20 ORDER BY c_custkey) AS place
  FROM customer LEFT JOIN proj ON entity = c_custkey)"""


def players(spark, d):
    f = facts(spark, d)
    last = F.struct("day", "game")
    proj = f.groupBy(F.col("entity").alias("player_id")).agg(
        F.round(F.sum("points") / 1000, 2).cast("double").alias("points"),
        F.max_by("status", last).alias("status"),
        F.min(F.when(F.col("day") >= F.lit("1998-06-01").cast("date"), F.col("day"))).alias("next_day"))
    c = table(spark, d, "customer").select(
        F.floor(F.col("c_custkey") / 20).alias("roster"), F.col("c_custkey").alias("player_id"),
        F.element_at(literal_map(POSITION), F.col("c_mktsegment")).alias("position"), F.col("c_acctbal").alias("balance"))
    # Customer numbers are dense, so the place inside a roster needs no window.
    out = c.join(proj, "player_id", "left").withColumn("place", F.col("player_id") % 20 + 1)
    return out.withColumns({
        "usable": ~F.col("status").eqNullSafe(F.lit("P")),
        "locked_slot": F.when(F.col("balance") < -900, F.col("position"))}).drop("status")


@query("A12_open_slots", f"""
WITH {PLAYERS}, h AS (SELECT roster, count(*) FILTER (WHERE position = 'QB') AS q, count(*) FILTER (WHERE position = 'RB') AS r,
  count(*) FILTER (WHERE position = 'WR') AS w, count(*) FILTER (WHERE position = 'TE') AS t FROM players GROUP BY roster),
e AS (SELECT *, greatest(0, q - 1) AS xq, greatest(0, r - 2) + greatest(0, w - 2) + greatest(0, t - 1) AS xf FROM h),
f AS (SELECT *, least(1, xf) AS flex FROM e)
SELECT roster, q AS "have_QB", r AS "have_RB", w AS "have_WR", t AS "have_TE", greatest(0, 1 - q) AS "open_QB", greatest(0, 2 - r) AS "open_RB",
  greatest(0, 2 - w) AS "open_WR", greatest(0, 1 - t) AS "open_TE", 1 - flex AS "open_FLEX", 1 - least(1, xf + xq - flex) AS "open_SUPER_FLEX" FROM f""")
def open_slots(spark, d):
    return ro.open_slots(players(spark, d), ["roster"], "position", NEED)


TX = """moves AS (SELECT l_orderkey AS transaction_id, CASE WHEN l_returnflag = 'R' THEN 'drop' ELSE 'add' END AS action,
  l_partkey::VARCHAR AS player_id, min(l_linenumber)::BIGINT AS roster_id FROM lineitem GROUP BY ALL)"""


def transactions(spark, d):
    li = table(spark, d, "lineitem")
    side = F.when(F.col("l_returnflag") == "R", "drops").otherwise("adds")
    one = li.groupBy("l_orderkey", side.alias("side"), F.col("l_partkey").cast("string").alias("player")).agg(
        F.min("l_linenumber").cast("int").alias("r"))
    # An order has few lines, so its maps stay small.
    entry = lambda s: F.map_from_entries(F.collect_list(F.when(F.col("side") == s, F.struct("player", "r"))))
    maps = one.groupBy(F.col("l_orderkey").alias("transaction_id")).agg(entry("adds").alias("adds"), entry("drops").alias("drops"))
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("transaction_id"), F.col("o_orderpriority").alias("type"), F.col("o_orderstatus").alias("status"),
        (F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) * 1000 + F.col("o_custkey")).alias("created_ms"))
    return o.join(maps, "transaction_id", "left")


@query("A13_flatten_transactions", f"""
WITH {TX} SELECT transaction_id, o_orderpriority AS type, o_orderstatus AS status,
  o_orderdate + to_milliseconds(o_custkey) AS created_at, action, player_id, roster_id
FROM moves JOIN orders ON o_orderkey = transaction_id""")
def flatten(spark, d):
    return ro.flatten_transactions(transactions(spark, d))


@query("A13_trend_counts", f"""
WITH {TX} SELECT player_id, count(*) FILTER (WHERE action = 'add') AS n_adds, count(*) FILTER (WHERE action = 'drop') AS n_drops
FROM moves GROUP BY player_id""")
def trends(spark, d):
    return ro.trend_counts(ro.flatten_transactions(transactions(spark, d)))


@query("A14_roster_groups", f"""
WITH {PLAYERS}, g AS (SELECT *, CASE WHEN place <= 7 THEN 'starter' WHEN balance < 0 THEN 'reserve' WHEN place >= 18 THEN 'taxi' ELSE 'bench' END AS roster_group FROM players),
p AS (SELECT roster, sum(coalesce(points, 0)::DECIMAL(18,2)) AS s, count(*) AS n FROM players GROUP BY roster)
SELECT roster, (floor(s) + n / 100)::DOUBLE AS points_for, roster_group,
  row_number() OVER (PARTITION BY roster, roster_group ORDER BY player_id) AS place, player_id::VARCHAR AS player_id,
  CASE WHEN roster_group = 'starter' THEN {SLOT_LIST}[place] END AS slot FROM g JOIN p USING (roster)""")
def groups(spark, d):
    p = players(spark, d)
    group = (F.when(F.col("place") <= 7, "starter").when(F.col("balance") < 0, "reserve")
             .when(F.col("place") >= 18, "taxi").otherwise("bench"))
    pid = F.col("player_id").cast("string")
    ids = lambda ok: F.transform(F.array_sort(F.collect_list(F.when(ok, F.struct("place", pid.alias("p"))))), lambda x: x["p"])
    rosters = p.groupBy("roster").agg(
        ids(F.lit(True)).alias("players"), ids(group == "starter").alias("starters"),
        ids(group == "reserve").alias("reserve"), ids(group == "taxi").alias("taxi"),
        F.floor(F.sum(F.coalesce("points", F.lit(0)).cast(MONEY))).alias("fpts"), F.count(F.lit(1)).alias("fpts_decimal"))
    return ro.roster_groups(rosters.withColumn("slots", F.lit(SLOT_LIST)), ["roster"])


@query("A15_lineup_totals", f"""
WITH {PLAYERS}, g AS (SELECT *, CASE WHEN place <= 7 THEN 'starter' ELSE 'bench' END AS roster_group FROM players)
SELECT roster, roster_group, round_even(sum(points::DECIMAL(18,2))::DOUBLE, 2) AS current_total, count(points) AS current_total_projected,
  count(*) AS current_total_starters FROM g GROUP BY roster, roster_group""")
def totals(spark, d):
    grouped = players(spark, d).withColumns({
        "points": F.col("points").cast(MONEY), "roster_group": F.when(F.col("place") <= 7, "starter").otherwise("bench")})
    return ro.lineup_totals(grouped, ["roster", "roster_group"], "points", "current_total")


@query("W11_numbered_slots", f"""
WITH {PLAYERS}, s AS (SELECT roster, place, {SLOT_LIST}[(place - 1) % 7 + 1] AS slot_type FROM players)
SELECT roster, place::BIGINT AS place, slot_type, CASE WHEN count(*) OVER (PARTITION BY roster, slot_type) > 1
  THEN slot_type || row_number() OVER (PARTITION BY roster, slot_type ORDER BY place) ELSE slot_type END AS slot_id FROM s""")
def slots(spark, d):
    s = players(spark, d).select(
        "roster", "place", F.element_at(F.lit(SLOT_LIST), ((F.col("place") - 1) % 7 + 1).cast("int")).alias("slot_type"))
    return rk.numbered_slots(s, ["roster"], "slot_type", ["place"])


LINEUP = PLAYERS + """, need(slot_type, n_slots) AS (VALUES ('QB', 1), ('RB', 2), ('WR', 2), ('TE', 1), ('FLEX', 1), ('SUPER_FLEX', 1)),
locked AS (SELECT roster, player_id, position, locked_slot AS slot_type, points FROM players WHERE locked_slot IS NOT NULL),
used AS (SELECT roster, slot_type, count(*) AS used FROM locked GROUP BY ALL),
room AS (SELECT r.roster, slot_type, greatest(0, n_slots - coalesce(used, 0)) AS room
  FROM (SELECT DISTINCT roster FROM players) r CROSS JOIN need LEFT JOIN used USING (roster, slot_type)),
free AS (SELECT roster, player_id, position, points FROM players WHERE locked_slot IS NULL AND usable),
base AS (SELECT f.*, f.position AS slot_type FROM free f JOIN room m ON m.roster = f.roster AND m.slot_type = f.position
  QUALIFY row_number() OVER (PARTITION BY f.roster, f.position ORDER BY coalesce(points, 0) DESC, player_id) <= room),
left1 AS (SELECT * FROM free WHERE player_id NOT IN (SELECT player_id FROM base)),
flex AS (SELECT f.*, 'FLEX' AS slot_type FROM left1 f JOIN room m ON m.roster = f.roster AND m.slot_type = 'FLEX' WHERE position IN ('RB', 'WR', 'TE')
  QUALIFY row_number() OVER (PARTITION BY f.roster ORDER BY coalesce(points, 0) DESC, player_id) <= room),
left2 AS (SELECT * FROM left1 WHERE player_id NOT IN (SELECT player_id FROM flex)),
sflex AS (SELECT f.*, 'SUPER_FLEX' AS slot_type FROM left2 f JOIN room m ON m.roster = f.roster AND m.slot_type = 'SUPER_FLEX' WHERE position IN ('QB', 'RB', 'WR', 'TE')
  QUALIFY row_number() OVER (PARTITION BY f.roster ORDER BY coalesce(points, 0) DESC, player_id) <= room),
lineup AS (SELECT roster, player_id, position, slot_type, points FROM base UNION ALL SELECT roster, player_id, position, slot_type, points FROM flex
  UNION ALL SELECT roster, player_id, position, slot_type, points FROM sflex UNION ALL SELECT roster, player_id, position, slot_type, points FROM locked)"""


def lineup(spark, d):
    p = players(spark, d)
    need = F.explode(literal_map(NEED)).alias("slot_type", "n_slots")
    slot_rows = p.select("roster").distinct().select("roster", need)
    return ro.best_lineup(p, slot_rows, ["roster"])[0]


@query("W13_best_lineup", f"WITH {LINEUP} SELECT * FROM lineup")
def best(spark, d):
    return lineup(spark, d)


@query("W14_kickoff_slates", f"""
WITH {PLAYERS}, s AS (SELECT roster, next_day::TIMESTAMP + to_hours(17) AS kickoff, count(*) FILTER (WHERE place <= 7) AS n_starters,
  count(*) FILTER (WHERE place > 7) AS n_bench,
  string_agg(player_id::VARCHAR, ',' ORDER BY place > 7, CASE WHEN place <= 7 THEN position ELSE '' END, player_id) AS players FROM players WHERE next_day::TIMESTAMP + to_hours(17) > TIMESTAMP '1998-06-03 12:00:00' GROUP BY ALL)
SELECT roster, kickoff, players, n_starters, n_bench, kickoff = min(kickoff) OVER (PARTITION BY roster) AS is_next,
  kickoff - to_minutes(7500) <= TIMESTAMP '1998-06-03 12:00:00' AS is_due FROM s""")
def slates(spark, d):
    p = players(spark, d).select(
        "roster", "player_id", F.when(F.col("place") <= 7, "starter").otherwise("bench").alias("roster_group"),
        F.when(F.col("place") <= 7, F.col("position")).alias("slot"),
        (F.col("next_day").cast("timestamp") + F.expr("interval 17 hours")).alias("kickoff"))
    slates = ro.kickoff_slates(p, ["roster"], "kickoff", F.lit("1998-06-03 12:00:00").cast("timestamp"), 7500, ("slot", "player_id", "player_id"))
    return slates.withColumn("players", F.array_join("players", ","))


SLOTTED = LINEUP + """, proposed AS (SELECT roster, slot_type || '#' || row_number() OVER (PARTITION BY roster, slot_type ORDER BY player_id) AS slot_id, player_id FROM lineup),
cur AS (SELECT roster, position || '#' || row_number() OVER (PARTITION BY roster, position ORDER BY player_id) AS slot_id, player_id FROM players WHERE place <= 7)"""


def slotted(df, kind):
    from pyspark.sql import Window

    w = Window.partitionBy("roster", kind).orderBy("player_id")
    return df.select("roster", F.concat(F.col(kind), F.lit("#"), F.row_number().over(w).cast("string")).alias("slot_id"), "player_id")


@query("W16_lineup_diff", f"""
WITH {SLOTTED}, due AS (SELECT roster, player_id FROM players WHERE next_day < DATE '1998-07-01')
SELECT roster, slot_id, c.player_id AS outgoing, p.player_id AS incoming, c.player_id IS NOT NULL AS known_slot,
  EXISTS (SELECT 1 FROM due WHERE due.roster = roster AND due.player_id IN (c.player_id, p.player_id)) AS due_now
FROM cur c FULL JOIN proposed p USING (roster, slot_id) WHERE c.player_id IS DISTINCT FROM p.player_id""")
def diff(spark, d):
    p = players(spark, d)
    current = slotted(p.filter("place <= 7"), "position")
    due = p.filter("next_day < DATE '1998-07-01'").select("roster", "player_id")
    return ro.lineup_diff(current, slotted(lineup(spark, d), "slot_type"), ["roster"], "slot_id", "player_id", due)


@query("W16_lineup_problems", f"""
WITH {PLAYERS}, slots AS (SELECT roster, slot_type, unnest(range(1, n + 1)) AS k FROM (SELECT DISTINCT roster FROM players) CROSS JOIN
    (VALUES ('QB', 1), ('RB', 2), ('WR', 2), ('TE', 1)) s(slot_type, n)),
sl AS (SELECT roster, slot_type || '#' || k AS slot_id, slot_type FROM slots),
pr AS (SELECT roster, position || '#' || row_number() OVER (PARTITION BY roster, position ORDER BY player_id) AS slot_id,
         CASE WHEN balance < 0 THEN NULL WHEN balance > 9500 THEN player_id + 1000000 ELSE player_id END AS player_id FROM players WHERE place <= 7),
j AS (SELECT pr.roster, pr.slot_id, pr.player_id, sl.slot_type, p.position, p.usable FROM pr LEFT JOIN sl USING (roster, slot_id)
  LEFT JOIN players p ON p.roster = pr.roster AND p.player_id = pr.player_id),
spare AS (SELECT roster, position FROM players WHERE usable AND (roster, player_id) NOT IN (SELECT roster, player_id FROM pr WHERE player_id IS NOT NULL))
SELECT roster, slot_id, player_id, 'unknown slot' AS rule FROM j WHERE slot_type IS NULL
UNION ALL SELECT roster, slot_id, player_id, 'player not on roster' FROM j WHERE player_id IS NOT NULL AND position IS NULL
UNION ALL SELECT roster, slot_id, player_id, 'player not eligible' FROM j WHERE position IS NOT NULL AND (NOT coalesce(position = slot_type, TRUE) OR NOT usable)
UNION ALL SELECT roster, slot_id, player_id, 'fillable slot left empty' FROM j WHERE player_id IS NULL AND (roster, slot_type) IN (SELECT roster, position FROM spare)""")
def problems(spark, d):
    p = players(spark, d)
    pick = F.when(F.col("balance") < 0, F.lit(None)).when(F.col("balance") > 9500, F.col("player_id") + 1000000).otherwise(F.col("player_id"))
    proposed = slotted(p.filter("place <= 7"), "position").join(
        p.select("roster", "player_id", pick.alias("_p")), ["roster", "player_id"]).select("roster", "slot_id", F.col("_p").alias("player_id"))
    ids = F.lit(["QB#1", "RB#1", "RB#2", "WR#1", "WR#2", "TE#1"])
    slot_rows = p.select("roster").distinct().select("roster", F.explode(ids).alias("slot_id")).withColumn(
        "slot_type", F.substring_index("slot_id", "#", 1))
    return ro.lineup_problems(proposed, p, slot_rows, ["roster"])
