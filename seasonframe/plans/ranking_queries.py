"""Queries of ranks, leaderboards, top-k and shortlists."""

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import ranking as rk
from .inputs import (
    FACTS, GROUPED, LINES, SEASON, SNAPSHOTS, facts, lines, season_rows, snapshots, table, with_group,
)
from .registry import query
from .season_queries import TEAM_SEASON, team_season_frame

RANK_SNAPSHOT = SNAPSHOTS + """, latest AS (
  SELECT player, day, total, low, high, grp, n FROM snapshots
  QUALIFY day = max(day) OVER (PARTITION BY player)),
ranked AS (
  SELECT player, grp, n, rank() OVER (ORDER BY total DESC) AS overall_rank,
         round(100 / low)::BIGINT AS worst_rank, CASE WHEN n > 1 THEN round(100 / high)::BIGINT END AS best_rank
  FROM latest)"""


def rank_snapshot(spark, d):
    """Latest snapshot of every user as an expert-rank row; an extreme of zero gives no rank."""
    snaps = snapshots(spark, d)
    newest = snaps.groupBy("player").agg(F.max("day").alias("day"))
    latest = snaps.join(newest, ["player", "day"])
    ranked = rk.competition_rank(latest, "total", desc=True, name="overall_rank")
    return ranked.select(
        "player", "grp", "n", "overall_rank", F.round(F.try_divide(F.lit(100), "low")).cast("bigint").alias("worst_rank"),
        F.when(F.col("n") > 1, F.round(F.try_divide(F.lit(100), "high")).cast("bigint")).alias("best_rank"))


@query("W1_competition_rank_overall", f"""
WITH {SEASON} SELECT entity, season, qty::DOUBLE AS qty, rank() OVER (ORDER BY qty DESC) AS rank FROM season_rows""")
def rank_overall(spark, d):
    return rk.competition_rank(season_rows(spark, d), "qty", desc=True).select("entity", "season", "qty", "rank")


@query("W1_competition_rank_in_group", f"""
WITH {SEASON} SELECT entity, season, returned::DOUBLE AS returned,
  rank() OVER (PARTITION BY season ORDER BY coalesce(returned, 0)) AS rank FROM season_rows""")
def rank_in_group(spark, d):
    return rk.competition_rank(season_rows(spark, d), "returned", ["season"]).select(
        "entity", "season", "returned", "rank")


@query("W1_rank_of_one", f"""
WITH {SEASON} SELECT count(*) + 1 AS rank FROM season_rows WHERE points < (
  SELECT max(points) FROM season_rows WHERE entity = 7)""")
def rank_one(spark, d):
    return rk.rank_of_one(season_rows(spark, d), "points", F.col("entity") == 7)


@query("W1_snapshot_ranks", f"""
WITH {RANK_SNAPSHOT} SELECT player, grp, overall_rank, worst_rank, best_rank, worst_rank - best_rank AS rank_range,
  rank() OVER (PARTITION BY grp ORDER BY overall_rank) AS position_rank FROM ranked""")
def snapshot_rank(spark, d):
    return rk.snapshot_ranks(rank_snapshot(spark, d), "overall_rank", "grp", "best_rank", "worst_rank").drop("n")


FORMULA = """, scored AS (
  SELECT *, CASE WHEN {null} THEN 'invalid' WHEN {zero} THEN 'zero' END AS status FROM eligible),
top AS (SELECT {id} AS id, {expr} AS v FROM scored WHERE status IS NULL ORDER BY v {dir}, id LIMIT {n}),
zeros AS (SELECT {id} AS id FROM scored WHERE status = 'zero' ORDER BY 1 LIMIT {n}),
c AS (SELECT count(*) AS eligible, count(*) FILTER (WHERE status = 'invalid') AS invalid,
             count(*) FILTER (WHERE status = 'zero') AS zero FROM scored)
SELECT 'ranked' AS part, row_number() OVER (ORDER BY v {dir}, id) AS rank, id::BIGINT AS id, round_even(v, 6) AS value,
       eligible, invalid, zero FROM top, c
UNION ALL SELECT 'zero_denominator', NULL, id, NULL, eligible, invalid, zero FROM zeros, c"""


def formula_frame(r, id_col):
    """The three parts of a formula ranking as one frame, with the counts on every row."""
    counts = r.counts
    cols = {"eligible": "eligible", "invalid": "invalid", "zero_denominator": "zero"}
    ranked = r.results.select(F.lit("ranked").alias("part"), "rank", F.col(id_col).alias("id"),
                              F.col("metric_value").alias("value"))
    zero = r.zero_denominator.select(F.lit("zero_denominator").alias("part"), F.lit(None).cast("int").alias("rank"),
                                     F.col(id_col).alias("id"), F.lit(None).cast("double").alias("value"))
    return ranked.unionByName(zero).withColumns({new: counts.select(old).scalar() for old, new in cols.items()})


@query("W2_rank_entities_by_formula", f"""
WITH {SEASON}, eligible AS (
  SELECT entity, sum(games)::DOUBLE AS games, sum(points)::DOUBLE AS points FROM season_rows GROUP BY entity HAVING sum(games) >= 3)
""" + FORMULA.format(null="points IS NULL", zero="games = 0", expr="points / games", id="entity", dir="DESC", n=10))
def rank_entities(spark, d):
    totals = season_rows(spark, d).groupBy("entity").agg(F.sum("games").alias("games"), F.sum("points").alias("points"))
    r = rk.rank_by_formula(totals, "points / games", ["games", "points"], "entity", ("games", 3))
    return formula_frame(r, "entity")


@query("W2_rank_with_zero_denominators", f"""
WITH {SEASON}, eligible AS (
  SELECT entity, qty::DOUBLE AS qty, discounted::DOUBLE AS discounted, returned::DOUBLE AS returned
  FROM season_rows WHERE season = 1996)
""" + FORMULA.format(null="returned IS NULL", zero="qty = 0 OR discounted = 0",
                     expr="-returned / qty + 2 * (returned / discounted)", id="entity", dir="ASC", n=20))
def rank_zero(spark, d):
    rows = season_rows(spark, d).filter("season = 1996")
    r = rk.rank_by_formula(rows, "-returned / qty + 2 * (returned / discounted)",
                           ["returned", "qty", "discounted"], "entity", direction="asc", limit=20)
    return formula_frame(r, "entity")


@query("W2_rank_zero_apart", """
WITH eligible AS (
  SELECT l_orderkey AS game, sum(l_tax::DECIMAL(4,2))::DOUBLE AS tax, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS qty,
         sum(CASE WHEN l_returnflag = 'R' THEN l_discount::DECIMAL(4,2) END)::DOUBLE AS disc
  FROM lineitem GROUP BY l_orderkey)
""" + FORMULA.format(null="disc IS NULL", zero="disc = 0", expr="qty / disc", id="game", dir="DESC", n=15))
def rank_zero_apart(spark, d):
    li = table(spark, d, "lineitem")
    rows = li.groupBy(F.col("l_orderkey").alias("game")).agg(
        F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("qty"),
        F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_discount").cast("decimal(4,2)"))).alias("disc"))
    return formula_frame(rk.rank_by_formula(rows, "qty / disc", ["qty", "disc"], "game", limit=15), "game")


@query("W2_rank_teams_by_formula", f"""
WITH {TEAM_SEASON}, eligible AS (SELECT * FROM team_season WHERE season = 1997 AND games >= 50)
""" + FORMULA.format(null="FALSE", zero="games = 0", expr="points_allowed / games", id="team", dir="ASC", n=10))
def rank_teams(spark, d):
    rows = team_season_frame(spark, d).filter("season = 1997")
    r = rk.rank_by_formula(rows, "points_allowed / games", ["points_allowed", "games"], "team", ("games", 50), "asc")
    return formula_frame(r, "team")


@query("W3_leaderboard", f"""
WITH {RANK_SNAPSHOT}, r AS (SELECT *, worst_rank - best_rank AS rank_range FROM ranked WHERE grp IN ('click', 'error', 'view'))
SELECT row_number() OVER (ORDER BY rank_range DESC NULLS LAST, player) AS place, player, grp, overall_rank, rank_range
FROM (SELECT * FROM r ORDER BY rank_range DESC NULLS LAST, player LIMIT 20)""")
def leaderboard(spark, d):
    rows = rank_snapshot(spark, d).withColumn("rank_range", F.col("worst_rank") - F.col("best_rank"))
    return rk.leaderboard(rows, "rank_range", "player", "desc", [F.col("grp").isin("click", "error", "view")], 20).select(
        "place", "player", "grp", "overall_rank", "rank_range")


# Ranked entities of a season: everyone ranked by the previous season, against that season's results.
EXPECTED = SEASON + """, prev AS (SELECT entity, c_mktsegment AS grp, points FROM season_rows JOIN customer ON c_custkey = entity WHERE season = 1996),
ranks AS (SELECT entity, grp, rank() OVER (ORDER BY points DESC) AS overall_rank,
                 rank() OVER (PARTITION BY grp ORDER BY points DESC) AS position_rank FROM prev),
results AS (SELECT entity, c_mktsegment AS grp, games, points FROM season_rows JOIN customer ON c_custkey = entity WHERE season = 1997),
pool AS (SELECT entity, grp, points FROM results
         UNION ALL SELECT entity, grp, 0 FROM ranks WHERE entity NOT IN (SELECT entity FROM results)),
fin AS (SELECT entity, rank() OVER (ORDER BY points DESC) AS fo, rank() OVER (PARTITION BY grp ORDER BY points DESC) AS fp FROM pool),
compared AS (
  SELECT k.entity, k.grp, overall_rank, position_rank, coalesce(games, 0) AS games, coalesce(points, 0)::DOUBLE AS points,
    CASE WHEN games <> 0 THEN round_even(points::DOUBLE / games, 6) END AS points_per_game,
    fo AS actual_overall_finish, fp AS actual_position_finish,
    overall_rank - fo AS overall_rank_difference, position_rank - fp AS position_rank_difference
  FROM ranks k JOIN fin USING (entity) LEFT JOIN results r ON r.entity = k.entity)"""


def compared(spark, d):
    grp = table(spark, d, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("grp"))
    rows = season_rows(spark, d).join(grp, "entity")
    prev = rows.filter("season = 1996").select("entity", "grp", "points")
    ranks = rk.competition_ranks(prev, "points", {"overall_rank": [], "position_rank": ["grp"]}, desc=True).drop("points")
    results = rows.filter("season = 1997").select("entity", "grp", "games", "points")
    return rk.expected_vs_actual(ranks, results, "entity", "grp", "overall_rank", "position_rank", "points", "games")


@query("J17_expected_vs_actual", f"WITH {EXPECTED} SELECT * FROM compared")
def expected(spark, d):
    return compared(spark, d)


@query("W4_outperformers", f"""
WITH {EXPECTED}, t AS (
  SELECT *, position_rank AS expected_rank FROM compared WHERE games >= 2 AND position_rank BETWEEN 5 AND 200
  ORDER BY position_rank_difference DESC NULLS LAST, entity LIMIT 20)
SELECT row_number() OVER (ORDER BY position_rank_difference DESC, entity) AS place, entity, grp,
  expected_rank::DOUBLE AS expected_rank, actual_position_finish AS actual_finish,
  position_rank_difference::DOUBLE AS rank_difference, points FROM t""")
def outperform(spark, d):
    return rk.outperformers(compared(spark, d), "entity", "position", "overall_rank", "position_rank", 2, (5, 200),
                            "rank_difference", "desc", 20).select(
        "place", "entity", "grp", "expected_rank", "actual_finish", "rank_difference", "points")


@query("W5_best_per_group_total", f"""
WITH {GROUPED}, t AS (SELECT entity, team, grp, sum(points)::DOUBLE AS total_points, count(DISTINCT game) AS games
  FROM grouped GROUP BY entity, team, grp)
SELECT team, grp, entity, total_points AS score, total_points, games FROM t
QUALIFY row_number() OVER (PARTITION BY team, grp ORDER BY total_points DESC, entity) = 1""")
def best_total(spark, d):
    f = with_group(facts(spark, d), spark, d)
    return rk.best_per_group(f, "entity", "team", "grp", "points", "game")


@query("W5_best_per_group_ppg", f"""
WITH {GROUPED}, t AS (SELECT entity, team, grp, sum(points)::DOUBLE AS total_points, count(DISTINCT game) AS games
  FROM grouped GROUP BY entity, team, grp)
SELECT team, grp, entity, total_points / games AS score, total_points, games FROM t
QUALIFY row_number() OVER (PARTITION BY team, grp ORDER BY total_points / games DESC, total_points DESC, entity) = 1""")
def best_ppg(spark, d):
    f = with_group(facts(spark, d), spark, d)
    return rk.best_per_group(f, "entity", "team", "grp", "points", "game", "ppg")


@query("W6_balanced_shortlist", f"""
WITH {RANK_SNAPSHOT}, o AS (SELECT player FROM ranked ORDER BY overall_rank, player LIMIT 16),
g AS (SELECT player FROM ranked WHERE grp IN ('click', 'view', 'error', 'purchase', 'login')
      QUALIFY row_number() OVER (PARTITION BY grp ORDER BY overall_rank, player) <= 3),
p AS (SELECT player, grp, overall_rank FROM ranked WHERE player IN (SELECT player FROM o UNION SELECT player FROM g)
      ORDER BY overall_rank, player LIMIT 24)
SELECT row_number() OVER (ORDER BY overall_rank, player) AS place, player, grp, overall_rank FROM p""")
def shortlist(spark, d):
    rows = rank_snapshot(spark, d).select("player", "grp", "overall_rank")
    return rk.balanced_shortlist(rows, "overall_rank", "player", "grp",
                                 ["click", "view", "error", "purchase", "login"], 24)


@query("W7_snake_pick", """
WITH t AS (SELECT o_orderkey AS pick, (SELECT count(*) FROM nation) AS teams FROM orders),
c AS (SELECT pick + 1 AS pick, teams, pick // teams + 1 AS round, pick % teams + 1 AS place FROM t),
s AS (SELECT *, CASE WHEN round % 2 = 1 THEN place ELSE teams - place + 1 END AS slot FROM c)
SELECT pick, round, slot, pick AS again FROM s""")
def snake(spark, d):
    teams = table(spark, d, "nation").agg(F.count(F.lit(1)).alias("n")).scalar()
    picks = table(spark, d, "orders").select((F.col("o_orderkey") + 1).alias("pick"), teams.alias("teams"))
    at = picks.withColumn("at", S.snake_coordinates(F.col("pick"), F.col("teams")))
    return at.select("pick", F.col("at.round").alias("round"), F.col("at.slot").alias("slot"),
                     S.snake_pick(F.col("at.round"), F.col("at.slot"), F.col("teams")).alias("again"))


@query("W7_next_slot_picks", """
WITH t AS (SELECT c_custkey, c_nationkey + 1 AS slot, 25 AS teams, c_custkey % 300 + 1 AS current FROM customer),
p AS (SELECT c_custkey, current, (r - 1) * teams + CASE WHEN r % 2 = 1 THEN slot ELSE teams - slot + 1 END AS pick
      FROM t, range(1, 13) AS g(r)),
q AS (SELECT c_custkey, list(pick ORDER BY pick) FILTER (WHERE pick >= current) AS ahead FROM p GROUP BY c_custkey)
SELECT c_custkey, ahead[1]::BIGINT AS next_pick, ahead[2]::BIGINT AS following_pick FROM q""")
def next_picks(spark, d):
    drafts = table(spark, d, "customer").select(
        "c_custkey", (F.col("c_nationkey") + 1).cast("bigint").alias("slot"),
        (F.col("c_custkey") % 300 + 1).alias("current"))
    return rk.slot_picks(drafts, F.lit(25), F.col("slot"), F.lit(12), F.col("current")).select(
        "c_custkey", "next_pick", "following_pick")


# Available players: customers without an order in 2000, with value, trend, rank and projection.
AVAILABLE = GROUPED + """, pool AS (
  SELECT c_custkey AS player_id, c_name AS display_name,
    sum(CASE WHEN season = 1999 THEN points END)::DOUBLE AS market_value,
    (sum(CASE WHEN season = 1999 THEN points END) - sum(CASE WHEN season = 1998 THEN points END))::DOUBLE AS trend,
    min(CASE WHEN season = 1997 THEN week END)::DOUBLE AS expert_rank,
    arg_max(points, (day, game))::DOUBLE AS projected_points, arg_max(week, (day, game)) AS projection_week
  FROM customer LEFT JOIN grouped ON entity = c_custkey GROUP BY ALL),
taken AS (SELECT DISTINCT entity AS player_id FROM facts WHERE season = 2000),
free AS (SELECT * FROM pool WHERE player_id NOT IN (SELECT player_id FROM taken))"""


def available_pool(spark, d):
    from ..operators.joins import available

    f = facts(spark, d)
    season = lambda y: F.sum(F.when(F.col("season") == y, F.col("points")))
    last = F.struct("day", "game")
    stats = f.groupBy(F.col("entity").alias("player_id")).agg(
        season(1999).cast("double").alias("market_value"),
        (season(1999) - season(1998)).cast("double").alias("trend"),
        F.min(F.when(F.col("season") == 1997, F.col("week"))).cast("double").alias("expert_rank"),
        F.max_by("points", last).cast("double").alias("projected_points"),
        F.max_by("week", last).alias("projection_week"))
    pool = table(spark, d, "customer").select(
        F.col("c_custkey").alias("player_id"), F.col("c_name").alias("display_name")).join(stats, "player_id", "left")
    return available(pool, f.filter("season = 2000").select(F.col("entity").alias("player_id")), "player_id")


@query("J10_available", f"WITH {AVAILABLE} SELECT player_id, display_name, market_value, trend FROM free")
def free_agents(spark, d):
    return available_pool(spark, d).select("player_id", "display_name", "market_value", "trend")


_CHAINS = {
    "market_value": "market_value DESC NULLS LAST, display_name, player_id",
    "trend": "trend DESC NULLS LAST, coalesce(market_value, 0) DESC, display_name, player_id",
    "expert_rank": "expert_rank ASC NULLS LAST, coalesce(market_value, 0) DESC, display_name, player_id",
    "projected_points": """(projection_week IS DISTINCT FROM 12), projected_points DESC NULLS LAST,
       coalesce(market_value, 0) DESC, display_name, player_id""",
}


def _rank_available(sort_by):
    def run(spark, d):
        return rk.rank_available(available_pool(spark, d), sort_by, F.lit(12), 20).select(
            "place", "player_id", "market_value", "trend", "expert_rank", "projected_points")
    return run


for _name, _order in _CHAINS.items():
    query(f"W8_rank_available_{_name}", f"""
WITH {AVAILABLE}, t AS (SELECT * FROM free ORDER BY {_order} LIMIT 20)
SELECT row_number() OVER (ORDER BY {_order}) AS place, player_id, market_value, trend, expert_rank, projected_points
FROM t""")(_rank_available(_name))


@query("W9_lookahead_rank", f"""
WITH {FACTS}, w AS (
  SELECT entity, sum(points) FILTER (WHERE week = 10)::DOUBLE AS w10, sum(points) FILTER (WHERE week = 11)::DOUBLE AS w11,
         sum(points) FILTER (WHERE week = 12)::DOUBLE AS w12
  FROM facts WHERE season = 1998 AND week IN (10, 11, 12) GROUP BY entity),
t AS (SELECT w.*, c_name AS name, (w10 IS NOT NULL)::INT + (w11 IS NOT NULL)::INT + (w12 IS NOT NULL)::INT AS covered,
        coalesce(w10, 0) + coalesce(w11, 0) + coalesce(w12, 0) AS s FROM w JOIN customer ON c_custkey = entity),
v AS (SELECT *, round_even(s, 2) AS total, round_even(s / covered, 2) AS average FROM t),
best AS (SELECT max(w10) AS m FROM v JOIN customer ON c_custkey = entity WHERE c_mktsegment = 'MACHINERY'),
o AS (SELECT v.* FROM v JOIN customer ON c_custkey = entity WHERE c_mktsegment NOT IN ('MACHINERY', 'BUILDING') AND w10 IS NOT NULL
      ORDER BY (covered < 3), average DESC, w10 DESC, name, entity LIMIT 10)
SELECT row_number() OVER (ORDER BY (covered < 3), average DESC, w10 DESC, name, entity) AS place, entity, name,
  w10 AS week_10, w11 AS week_11, w12 AS week_12, covered::BIGINT AS covered, total, average,
  round_even(w10 - m, 2) AS advantage FROM o, best""")
def lookahead(spark, d):
    f = with_group(facts(spark, d).filter("season = 1998"), spark, d)
    proj = f.groupBy("entity", "name", "week").agg(F.sum("points").alias("points"))
    grp = table(spark, d, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("grp"))
    held = grp.filter("grp = 'MACHINERY'")
    taken = grp.filter("grp IN ('MACHINERY', 'BUILDING')")
    return rk.lookahead_rank(proj, "entity", "name", "week", "points", [10, 11, 12], taken, held, 10)


@query("W10_top_n_per_group", f"""
WITH {GROUPED}, t AS (SELECT entity, grp, sum(CASE WHEN status = 'P' THEN points END)::DOUBLE AS points FROM grouped GROUP BY entity, grp),
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY points DESC, entity) AS rank FROM t WHERE points IS NOT NULL)
SELECT entity, grp, points, rank FROM r WHERE rank <= CASE grp WHEN 'BUILDING' THEN 2 WHEN 'MACHINERY' THEN 5 WHEN 'HOUSEHOLD' THEN 1 END""")
def top_n(spark, d):
    f = with_group(facts(spark, d), spark, d)
    t = f.groupBy("entity", "grp").agg(F.sum(F.when(F.col("status") == "P", F.col("points"))).alias("points"))
    return rk.top_n_per_group(t, "grp", "points", ["entity"], {"BUILDING": 2, "MACHINERY": 5, "HOUSEHOLD": 1})


@query("W12_priority_queue", f"""
WITH {GROUPED}, a AS (SELECT entity, 0 AS priority, rank() OVER (ORDER BY sum(points) DESC) AS source_rank FROM grouped WHERE season = 1999 GROUP BY entity),
b AS (SELECT entity, 1, rank() OVER (ORDER BY sum(points) DESC) FROM grouped WHERE season = 1998 GROUP BY entity),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b),
f AS (SELECT entity, priority, source_rank FROM u QUALIFY row_number() OVER (PARTITION BY entity ORDER BY priority, source_rank) = 1),
m AS (SELECT DISTINCT user_id AS entity FROM events),
t AS (SELECT f.* FROM f SEMI JOIN m USING (entity) ORDER BY priority, source_rank, entity LIMIT 100)
SELECT row_number() OVER (ORDER BY priority, source_rank, entity) AS place, entity, priority::BIGINT AS priority, source_rank FROM t""")
def queue(spark, d):
    totals = facts(spark, d).groupBy("entity", "season").agg(F.sum("points").alias("points"))
    ranked = [rk.competition_rank(totals.filter(F.col("season") == y), "points", desc=True) for y in (1999, 1998)]
    mapped = table(spark, d, "events").select(F.col("user_id").alias("entity"))
    return rk.priority_queue(ranked, "entity", "rank", mapped, 100)


@query("W15_stat_lookup", f"""
WITH {FACTS}, {LINES} SELECT entity, season, week, game, points::DOUBLE AS points, qty::DOUBLE AS qty
FROM facts JOIN lines USING (game) WHERE entity = 42""")
def lookup(spark, d):
    f = facts(spark, d).join(lines(spark, d), "game")
    return rk.stat_lookup(f, [F.col("entity") == 42], ["entity", "season", "week", "game", "points", "qty"],
                          [F.col("season"), F.col("week"), F.col("game")])


@query("W15_find_by_name", """
SELECT c_custkey AS player_id, c_name AS display_name FROM customer WHERE lower(c_name) LIKE '%r#00000012%'""")
def find_name(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("player_id"), F.col("c_name").alias("display_name"))
    return rk.find_by_name(rows, "display_name", "R#00000012 ")


@query("W15_default_view", """
SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'passing' WHEN 'MACHINERY' THEN 'rushing'
  WHEN 'HOUSEHOLD' THEN 'receiving' ELSE 'fantasy' END AS view FROM customer""")
def view_of(spark, d):
    code = S.literal_map({"BUILDING": "qb", "MACHINERY": "FB", "HOUSEHOLD": "WR", "FURNITURE": "K", "AUTOMOBILE": "K"})
    return table(spark, d, "customer").select(
        "c_custkey", rk.default_view(F.try_element_at(code, F.col("c_mktsegment"))).alias("view"))
