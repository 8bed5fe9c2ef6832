"""Queries of the join operators and set operations."""

from pyspark.sql import functions as F

from ..common import work_dir
from ..operators import joins as jn
from ..operators import sets
from ..operators.normalize import normalize_by_schema
from ..sources.tables import write_snapshot
from .inputs import FACTS, GROUPED, MATCHES, SNAPSHOTS, facts, matches, money, snapshots, table, with_group
from .registry import query


def crosswalk(spark, d):
    """Supplier names to ids, with the customer-style name of the same number as a second key."""
    return table(spark, d, "supplier").select(
        F.col("s_name").alias("name"), F.col("s_suppkey").alias("player_id"),
        F.concat(F.lit("Customer#"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("alt_name"))


@query("J1_attach_id", """
WITH ids AS (SELECT n_name AS key, min(n_nationkey) AS id FROM nation WHERE n_nationkey < 20 GROUP BY n_name),
r AS (SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN 'NATION_' || c_nationkey END AS key FROM customer),
j AS (SELECT r.*, id FROM r LEFT JOIN ids USING (key))
SELECT c_custkey, key, id::BIGINT AS player_id, (SELECT count(*) FROM j WHERE id IS NULL) AS n_unmatched
FROM j WHERE id IS NOT NULL""")
def attach(spark, d):
    ids = table(spark, d, "nation").filter("n_nationkey < 20").select(
        F.col("n_name").alias("key"), F.col("n_nationkey").alias("player_id"))
    rows = table(spark, d, "customer").select("c_custkey", F.when(
        F.col("c_acctbal") >= 0, F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string"))).alias("key"))
    m = jn.attach_id(rows, ids, "key", "player_id")
    n = m.unmatched.agg(F.count(F.lit(1)).alias("n")).scalar()
    return m.matched.select("c_custkey", "key", "player_id").withColumn("n_unmatched", n)


@query("J2_attach_id_fallback", """
WITH r AS (SELECT o_orderkey, 'Supplier#' || lpad((o_custkey)::VARCHAR, 9, '0') AS name,
             'Customer#' || lpad((o_orderkey)::VARCHAR, 9, '0') AS alt_name FROM orders),
s AS (SELECT s_name AS name, s_suppkey AS id, 'Customer#' || lpad(s_suppkey::VARCHAR, 9, '0') AS alt_name FROM supplier)
SELECT o_orderkey, coalesce(a.id, b.id) AS player_id FROM r LEFT JOIN s a USING (name)
LEFT JOIN s b ON b.alt_name = r.alt_name WHERE coalesce(a.id, b.id) IS NOT NULL""")
def attach_two(spark, d):
    pad = lambda c: F.lpad(F.col(c).cast("string"), 9, "0")
    rows = table(spark, d, "orders").select(
        "o_orderkey", F.concat(F.lit("Supplier#"), pad("o_custkey")).alias("name"),
        F.concat(F.lit("Customer#"), pad("o_orderkey")).alias("alt_name"))
    return jn.attach_id_fallback(rows, crosswalk(spark, d), "name", "alt_name", "player_id").matched.select(
        "o_orderkey", "player_id")


@query("J3_unpivot_ids", """
WITH w AS (SELECT p_partkey, p_name AS store_id, p_brand AS brand_id, CASE WHEN p_size > 40 THEN '  ' ELSE ' ' || p_type || ' ' END AS kind_id FROM part),
u AS (UNPIVOT w ON store_id, brand_id, kind_id INTO NAME provider VALUE external_id),
t AS (SELECT p_partkey, CASE regexp_replace(provider, '_id$', '') WHEN 'kind' THEN 'type' ELSE regexp_replace(provider, '_id$', '') END AS provider,
        trim(external_id) AS external_id FROM u)
SELECT provider, external_id, min(p_partkey) AS p_partkey FROM t WHERE external_id <> '' GROUP BY provider, external_id""")
def unpivot(spark, d):
    w = table(spark, d, "part").select(
        "p_partkey", F.col("p_name").alias("store_id"), F.col("p_brand").alias("brand_id"),
        F.when(F.col("p_size") > 40, "  ").otherwise(F.concat(F.lit(" "), "p_type", F.lit(" "))).alias("kind_id"))
    return jn.unpivot_ids(w, "p_partkey", ["store_id", "brand_id", "kind_id"], {"kind": "type"})


@query("J4_asof_forward", f"""
WITH {FACTS}, s AS (SELECT s_nationkey AS nation, l_shipdate::DATE AS ship, l_orderkey AS line_order, l_linenumber AS ln
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
ships AS (SELECT nation, ship, min(line_order) AS ship_order FROM s GROUP BY nation, ship),
l AS (SELECT game, day, c_nationkey AS nation FROM facts JOIN customer ON c_custkey = entity)
SELECT l.game, l.day, l.nation::BIGINT AS nation, ships.ship, ships.ship_order
FROM l ASOF JOIN ships ON l.nation = ships.nation AND ships.ship >= l.day""")
def asof(spark, d):
    left = with_group(facts(spark, d), spark, d).select("game", "day", "nation")
    li = table(spark, d, "lineitem").join(
        table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nation")),
        "l_suppkey")
    right = li.select("nation", F.to_date("l_shipdate").alias("ship"), F.col("l_orderkey").alias("ship_order"))
    return jn.asof_forward(left, right, ["nation"], "day", "ship", ["ship_order"])


@query("J5_pregame_snapshot", f"""
WITH {SNAPSHOTS}, {FACTS},
games AS (SELECT DISTINCT entity AS player, make_date(2024, 1, day(day)::INT) AS game_day, week FROM facts),
g AS (SELECT player, game_day, min(week) AS week FROM games GROUP BY player, game_day),
m AS (SELECT s.player, s.day, g.game_day, g.week FROM (SELECT DISTINCT player, day FROM snapshots WHERE player % 10 <> 0) s
      ASOF JOIN g ON s.player = g.player AND g.game_day >= s.day),
newest AS (SELECT player, week, game_day, max(day) AS day FROM m GROUP BY player, week, game_day)
SELECT player, day, week, game_day, total::DOUBLE AS total, grp FROM snapshots JOIN newest USING (player, day)
UNION ALL SELECT player, day, 1, day, total::DOUBLE, grp FROM snapshots WHERE player % 10 = 0""")
def pregame(spark, d):
    games = facts(spark, d).select(
        F.col("entity").alias("player"), F.make_date(F.lit(2024), F.lit(1), F.dayofmonth("day")).alias("game_day"), "week")
    games = games.groupBy("player", "game_day").agg(F.min("week").alias("week"))
    # The schema of normalised feeds: period columns are always there, filled for weekly feeds only.
    weekly = F.col("player") % 10 == 0
    fixed = lambda df: df.select(
        "player", "day", F.when(weekly, F.lit(1).cast("bigint")).alias("week"), F.when(weekly, F.col("day")).alias("game_day"), "total", "grp")
    snaps = normalize_by_schema(snapshots(spark, d), [("daily", {"player", "day", "total", "grp"}, fixed)])
    games = games.withColumn("game_key", F.col("game_day"))
    out = jn.pregame_snapshot(snaps, games.withColumnRenamed("game_key", "at"), "player", "day", "at", ["week", "game_day"])
    return out


@query("J6_latest_per_group", """
WITH t AS (SELECT o_custkey, o_orderdate::DATE AS o_orderdate, o_orderkey, max(o_orderdate) OVER (PARTITION BY o_custkey) AS newest FROM orders)
SELECT o_custkey, o_orderdate, o_orderkey FROM t WHERE o_orderdate = newest""")
def latest(spark, d):
    return jn.latest_per_group(table(spark, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("o_orderdate"), "o_orderkey"), ["o_custkey"], "o_orderdate")


@query("J7_asof_snapshot", f"""
WITH {SNAPSHOTS}, n AS (SELECT player, max(day) AS day FROM snapshots WHERE day <= DATE '2024-01-15' GROUP BY player)
SELECT player, day, total::DOUBLE AS total, grp FROM snapshots JOIN n USING (player, day)""")
def asof_snap(spark, d):
    return jn.asof_snapshot(snapshots(spark, d), ["player"], "day", F.lit("2024-01-15").cast("date")).select(
        "player", "day", "total", "grp")


@query("J7_before_cutoff", f"""
WITH {SNAPSHOTS}, cut AS (SELECT max(day) AS c FROM snapshots),
n AS (SELECT grp, max(day) AS day FROM snapshots, cut WHERE day < c AND year(day) = year(c) GROUP BY grp)
SELECT player, day, total::DOUBLE AS total, grp FROM snapshots JOIN n USING (grp, day)""")
def before_cutoff(spark, d):
    snaps = snapshots(spark, d)
    cutoff = snaps.agg(F.max("day").alias("c")).scalar()
    return jn.asof_snapshot(snaps, ["grp"], "day", cutoff, strict=True, same_year=True).select("player", "day", "total", "grp")


@query("J7_asof_snapshot_dated", f"""
WITH {SNAPSHOTS}, n AS (SELECT grp, max(day) AS day FROM snapshots WHERE day < DATE '2024-01-15' GROUP BY grp)
SELECT player, day, total::DOUBLE AS total, grp FROM snapshots JOIN n USING (grp, day)""")
def asof_dated(spark, d):
    """Over a stored table in folders of group and day: only the folders of the days found are read whole."""
    return jn.asof_snapshot(stored_snapshots(spark, d), ["grp"], "day", F.lit("2024-01-15").cast("date"), strict=True, dated=True).select(
        "player", "day", "total", "grp")


def stored_snapshots(spark, d):
    path = f"{work_dir(spark)}/ranks"
    write_snapshot(snapshots(spark, d).repartition("grp", "day"), path, "day", by=["grp"])
    return spark.read.parquet(path)


@query("J7_missing_pages", f"""
WITH {SNAPSHOTS} SELECT c_custkey AS player FROM customer WHERE c_custkey NOT IN (
  SELECT player FROM snapshots WHERE day <= DATE '2024-01-02')""")
def missing(spark, d):
    snaps = snapshots(spark, d).filter("day <= DATE '2024-01-02'")
    return jn.missing_pages(snaps, table(spark, d, "customer").select(F.col("c_custkey").alias("player")), ["player"])


@query("J11_merge_sources", f"""
WITH {GROUPED}, u AS (
  SELECT user_id AS id, 'event ' || user_id AS label, 0 AS priority FROM events
  UNION ALL SELECT c_custkey, c_name, 1 FROM customer UNION ALL SELECT s_suppkey, s_name, 2 FROM supplier),
f AS (SELECT DISTINCT id, label, priority FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY priority, label) = 1),
p AS (SELECT entity AS id, sum(points)::DOUBLE AS points FROM facts GROUP BY entity),
v AS (SELECT user_id AS id, sum(value::DECIMAL(18,2))::DOUBLE AS value FROM events GROUP BY user_id)
SELECT id, label, priority::BIGINT AS source_priority, points, value FROM f LEFT JOIN p USING (id) LEFT JOIN v USING (id)""")
def merge(spark, d):
    ev = table(spark, d, "events")
    sources = [
        ev.select(F.col("user_id").alias("id"), F.concat(F.lit("event "), F.col("user_id").cast("string")).alias("label")),
        table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("label")),
        table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("label")),
    ]
    points = facts(spark, d).groupBy(F.col("entity").alias("id")).agg(F.sum("points").alias("points"))
    value = ev.groupBy(F.col("user_id").alias("id")).agg(F.sum(money("value")).alias("value"))
    return jn.merge_sources(sources, "id", ["label"], [points, value])


@query("J12_opponent_of", """
WITH m AS (SELECT c_custkey // 20 AS league, c_custkey AS roster, CASE WHEN c_acctbal >= 0 THEN c_custkey % 20 // 2 END AS matchup FROM customer)
SELECT a.league, a.roster, a.matchup, b.roster AS opponent_id FROM m a
LEFT JOIN m b ON a.league = b.league AND a.matchup = b.matchup AND a.roster <> b.roster""")
def opponents(spark, d):
    key = F.col("c_custkey")
    m = table(spark, d, "customer").select(
        F.floor(key / 20).alias("league"), key.alias("roster"),
        F.when(F.col("c_acctbal") >= 0, F.floor(key % 20 / 2)).alias("matchup"))
    return jn.opponent_of(m, "matchup", "roster", ["league"])


@query("J13_select_entities", f"""
WITH {FACTS} SELECT c_custkey AS entity FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')
  AND c_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 1000)
  AND c_custkey IN (SELECT entity FROM facts WHERE season = 1997 AND points >= 100000 AND week <= 6)""")
def select(spark, d):
    tables = {
        "profile": table(spark, d, "customer").select(F.col("c_custkey").alias("entity"), "c_mktsegment", "c_acctbal"),
        "season": facts(spark, d)}
    base = tables["profile"].select("entity")
    allowed = {"profile": {"c_mktsegment", "c_acctbal"}, "season": {"points", "week"}}
    criteria = [
        jn.Criterion("profile", "c_mktsegment", "in", ["BUILDING", "MACHINERY"]),
        jn.Criterion("profile", "c_acctbal", "gte", 1000),
        jn.Criterion("season", "points", "gte", 100000), jn.Criterion("season", "week", "lte", 6)]
    return jn.select_entities(base, tables, criteria, "entity", allowed, {"season"}, 1997)[0]


TEAMS_OF = GROUPED + ", teams_of AS (SELECT entity, season, list(DISTINCT team) AS teams FROM grouped GROUP BY entity, season)"


@query("J14_membership", f"""
WITH {TEAMS_OF} SELECT entity, season FROM teams_of
WHERE list_has_any(teams, ['1-URGENT', '2-HIGH'])""")
def member(spark, d):
    t = facts(spark, d).groupBy("entity", "season").agg(F.collect_set("team").alias("teams"))
    return jn.membership(t, "teams", ["1-URGENT", "2-HIGH"]).select("entity", "season")


@query("J14_latest_roster_week", f"""
WITH {FACTS} SELECT entity, season, week, team FROM facts
QUALIFY row_number() OVER (PARTITION BY entity, season ORDER BY week DESC, team DESC) = 1""")
def member_latest(spark, d):
    return jn.latest_membership(facts(spark, d), "entity", "season", "week", ["team"])


@query("J15_hydrate", """
WITH ids AS (SELECT DISTINCT CASE WHEN o_orderstatus = 'F' THEN chr((65 + o_custkey % 26)::INT) || chr((65 + o_custkey // 26 % 26)::INT)
    WHEN o_orderstatus = 'O' THEN o_custkey::VARCHAR ELSE 'x' || o_custkey END AS player_id FROM orders),
p AS (SELECT c_custkey::VARCHAR AS player_id, c_name AS display_name, c_mktsegment AS position FROM customer),
s AS (SELECT DISTINCT user_id::VARCHAR AS player_id, 'ACT' AS status FROM events),
t AS (SELECT chr((65 + n_nationkey)::INT) || chr((65 + n_regionkey)::INT) AS code, n_name AS team_name FROM nation)
SELECT player_id, CASE WHEN display_name IS NOT NULL THEN 'player' WHEN team_name IS NOT NULL THEN 'team' ELSE 'placeholder' END AS kind,
  coalesce(display_name, team_name, player_id) AS display_name,
  coalesce(position, CASE WHEN team_name IS NOT NULL THEN 'DEF' END) AS position, status
FROM ids LEFT JOIN p USING (player_id) LEFT JOIN s USING (player_id)
LEFT JOIN t ON code = player_id AND display_name IS NULL""")
def hydrate(spark, d):
    c = F.col("o_custkey")
    letters = F.concat(F.char((65 + c % 26).cast("int")), F.char((65 + F.floor(c / 26) % 26).cast("int")))
    ids = table(spark, d, "orders").select(
        F.when(F.col("o_orderstatus") == "F", letters).when(F.col("o_orderstatus") == "O", c.cast("string"))
        .otherwise(F.concat(F.lit("x"), c.cast("string"))).alias("player_id")).distinct()
    profiles = table(spark, d, "customer").select(
        F.col("c_custkey").cast("string").alias("player_id"), F.col("c_name").alias("display_name"),
        F.col("c_mktsegment").alias("position"))
    status = table(spark, d, "events").select(F.col("user_id").cast("string").alias("player_id")).distinct().withColumn(
        "status", F.lit("ACT"))
    teams = table(spark, d, "nation").select(
        F.concat(F.char(65 + F.col("n_nationkey")), F.char(65 + F.col("n_regionkey"))).alias("code"),
        F.col("n_name").alias("team_name"))
    return jn.hydrate(ids, profiles, status, teams)


@query("J16_with_fallback", f"""
WITH {GROUPED}, p AS (SELECT season, nation, entity FROM grouped WHERE status = 'P'),
s AS (SELECT season, nation, entity FROM grouped WHERE status = 'F'),
m AS (SELECT max(season) AS c FROM facts)
SELECT season, nation::BIGINT AS nation, entity, 'weekly' AS source_snapshot FROM p
UNION ALL SELECT season, nation::BIGINT, entity, 'status' FROM s, m WHERE season = c
  AND NOT EXISTS (SELECT 1 FROM p WHERE p.season = s.season AND p.entity = s.entity)""")
def fallback(spark, d):
    f = with_group(facts(spark, d), spark, d)
    pick = lambda s: f.filter(F.col("status") == s).select("season", "nation", "entity")
    current = facts(spark, d).agg(F.max("season").alias("s")).scalar()
    return jn.with_fallback(pick("P"), pick("F"), ["season", "entity"], "season", current, ("weekly", "status"))


@query("J18_link_names", f"""
WITH {GROUPED}, docs AS (SELECT DISTINCT game, unnest([upper(name), 'supplier#' || lpad(nation::VARCHAR, 9, '0')]) AS n FROM grouped),
e AS (SELECT c_custkey AS id, lower(c_name) AS n FROM customer UNION ALL SELECT s_suppkey + 1000000, lower(s_name) FROM supplier)
SELECT game, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids FROM docs JOIN e ON lower(docs.n) = e.n GROUP BY game""")
def link(spark, d):
    docs = with_group(facts(spark, d), spark, d).select("game", F.array(
        F.upper("name"), F.concat(F.lit("supplier#"), F.lpad(F.col("nation").cast("string"), 9, "0"))).alias("names"))
    entities = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("n")).unionByName(
        table(spark, d, "supplier").select((F.col("s_suppkey") + 1000000).alias("id"), F.col("s_name").alias("n")))
    out = jn.link_names(docs, "game", "names", entities, "id", "n")
    return out.select("game", F.array_join("entity_ids", ",").alias("ids"))


@query("J19_new_by_url", """
WITH n AS (SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1)) ||
    CASE WHEN regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') = '' THEN '/'
         ELSE regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') END ||
    regexp_extract(regexp_replace(url, '#.*$', ''), '(\\?.+)$', 1) AS u, length(html) > 2000 AS stored FROM pages)
SELECT page_id, u AS normalized_url FROM n WHERE u NOT IN (SELECT u FROM n WHERE stored)""")
def new_urls(spark, d):
    pages = table(spark, d, "pages")
    stored = pages.filter(F.length("html") > 2000).select("url")
    return jn.new_by_url(pages.select("page_id", "url"), stored).select("page_id", "normalized_url")


@query("U1_union_relaxed", """
SELECT o_orderkey AS k, o_totalprice AS v, o_orderstatus AS s, NULL::VARCHAR AS t FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT l_orderkey, l_linenumber::DOUBLE, NULL, l_returnflag FROM lineitem
UNION ALL SELECT p_partkey, p_size::DOUBLE, NULL, NULL FROM part""")
def union(spark, d):
    a = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(
        F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"), F.col("o_orderstatus").alias("s"))
    b = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("v"), F.col("l_returnflag").alias("t"))
    c = table(spark, d, "part").select(F.col("p_partkey").cast("int").alias("k"), F.col("p_size").cast("smallint").alias("v"))
    return sets.union_relaxed([a, b, c])


@query("U2_distinct_rows", "SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem")
def distinct(spark, d):
    return sets.distinct_rows(table(spark, d, "lineitem").select("l_orderkey", "l_suppkey"))


@query("U2_unique_on", """
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, l_quantity FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_quantity DESC, l_partkey) = 1""")
def unique(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return sets.unique_on(li, ["l_orderkey", "l_linenumber"], [-money("l_quantity"), F.col("l_partkey")])


@query("U3_intersect_ids", """
SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'
INTERSECT SELECT user_id FROM events""")
def intersect(spark, d):
    o = table(spark, d, "orders")
    pick = lambda s: o.filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("id"))
    return sets.intersect_ids([pick("F"), pick("O"), table(spark, d, "events").select(F.col("user_id").alias("id"))], "id")


@query("U4_difference", """
SELECT c_custkey AS id, c_name FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)
  AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def difference(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_name")
    o = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id"))
    return sets.difference(c, [table(spark, d, "events").select(F.col("user_id").alias("id")), o], "id")
