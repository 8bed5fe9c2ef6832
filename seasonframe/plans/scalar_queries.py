"""Queries of the column expressions and table normalisation."""

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import normalize as nz
from .inputs import FACTS, SNAPSHOTS, facts, snapshots, table
from .registry import query


@query("P1_canonical_codes", """
WITH o AS (SELECT o_orderkey, year(o_orderdate) AS season, CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN '3-MEDIUM' ELSE o_orderpriority END AS team,
  CASE o_orderstatus WHEN 'P' THEN 'O' ELSE o_orderstatus END AS last_team FROM orders)
SELECT o_orderkey, CASE WHEN team = '5-LOW' AND season >= 1998 THEN '6-MOVED' ELSE team END AS team,
  CASE WHEN last_team = '5-LOW' AND season >= 1998 THEN '6-MOVED' ELSE last_team END AS last_team FROM o""")
def codes(spark, d):
    o = table(spark, d, "orders").select(
        "o_orderkey", F.year("o_orderdate").alias("season"), F.col("o_orderpriority").alias("team"),
        F.col("o_orderstatus").alias("last_team"))
    return nz.canonical_codes(o, ["team", "last_team", "home_team"], {"4-NOT SPECIFIED": "3-MEDIUM", "P": "O"},
                              {"5-LOW": ("6-MOVED", 1998)}, "season").drop("season")


@query("P2_normalize_by_schema", """
SELECT event_id::VARCHAR AS id, NULL::BIGINT AS week, ts::DATE AS day,
  CASE WHEN event_type = 'view' THEN 'Special Teams' WHEN event_type LIKE '%d' THEN 'Defense' ELSE 'Offense' END AS grp FROM events
UNION ALL SELECT o_orderkey::VARCHAR, month(o_orderdate), NULL, o_orderpriority FROM orders""")
def by_schema(spark, d):
    adapters = [
        ("weekly", {"o_orderkey", "o_orderpriority"}, lambda x: x.select(
            F.col("o_orderkey").cast("string").alias("id"), F.month("o_orderdate").alias("week"),
            F.lit(None).cast("date").alias("day"), F.col("o_orderpriority").alias("grp"))),
        ("timed", {"event_id", "ts"}, lambda x: x.select(
            F.col("event_id").cast("string").alias("id"), F.lit(None).cast("int").alias("week"),
            F.to_date("ts").alias("day"), nz.position_group(F.when(F.col("event_type") == "view", "Special Teams")
            .when(F.col("event_type").endswith("d"), "x D").otherwise(F.col("event_type"))).alias("grp"))),
    ]
    return nz.normalize_by_schema(table(spark, d, "events"), adapters).unionByName(
        nz.normalize_by_schema(table(spark, d, "orders"), adapters))


@query("P3_lenient_cast", """
SELECT o_orderkey, try_cast(o_orderpriority[1:1] || CASE WHEN o_orderstatus = 'F' THEN '?' ELSE '' END AS BIGINT) AS priority,
  try_cast(CASE WHEN o_orderstatus = 'P' THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS DATE) AS day,
  try_cast(CASE WHEN o_orderstatus = 'O' THEN '' ELSE o_custkey::VARCHAR || '.5' END AS DOUBLE) AS amount FROM orders""")
def lenient(spark, d):
    s = F.col("o_orderstatus")
    raw = table(spark, d, "orders").select(
        "o_orderkey", F.concat(F.substring("o_orderpriority", 1, 1), F.when(s == "F", "?").otherwise("")).alias("priority"),
        F.when(s == "P", "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"),
        F.when(s == "O", "").otherwise(F.concat(F.col("o_custkey").cast("string"), F.lit(".5"))).alias("amount"))
    return nz.lenient_cast(raw, {"priority": "bigint", "day": "date", "amount": "double"})


# Fixed value: namespace of the stable ids.
NAMESPACE = "f0cf9ef7-d56d-4a6f-a8e1-197be003c7a8"


@query("P4_stable_id", f"""
WITH h AS (SELECT c_custkey, sha1(unhex('{NAMESPACE.replace("-", "")}') || encode('gsis:' || c_name)) AS x FROM customer)
SELECT c_custkey, x[1:8] || '-' || x[9:12] || '-5' || x[14:16] || '-' ||
  CASE WHEN x[17:17] IN ('0', '4', '8', 'c') THEN '8' WHEN x[17:17] IN ('1', '5', '9', 'd') THEN '9'
       WHEN x[17:17] IN ('2', '6', 'a', 'e') THEN 'a' ELSE 'b' END || x[18:20] || '-' || x[21:32] AS player_id FROM h""")
def ids(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.stable_id(F.col("c_name"), NAMESPACE, "gsis").alias("player_id"))


@query("P5_clean_html_text")
def html_text(spark, d):
    return table(spark, d, "pages").select("page_id", S.clean_html_text(F.col("html")).alias("text"))


_KEY = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
_FOLD = ("regexp_replace(translate({}, 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ', "
         "'aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY'), '[^\\x00-\\x7f]', '', 'g')")


@query("P6_name_keys", f"""
WITH n AS (SELECT conv_id, turn, text, {_FOLD.format("text")} AS f FROM conversations),
k AS (SELECT conv_id, turn, {_KEY.format("f")} AS spaced, {_KEY.format("translate(f, '.''', '')")} AS ascii,
  regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS compact FROM n),
x AS (SELECT *, regexp_replace(ascii, '(^| )(jr|sr|ii|iii|iv|v)$', '') AS no_suffix FROM k)
SELECT *, CASE WHEN no_suffix LIKE '% %' THEN regexp_extract(no_suffix, '[^ ]+$') END AS surname FROM x""")
def keys(spark, d):
    c = table(spark, d, "conversations")
    modes = ["spaced", "ascii", "compact", "no_suffix", "surname"]
    return c.select("conv_id", "turn", *[S.name_key(F.col("text"), m).alias(m) for m in modes])


@query("P7_season_of", """
SELECT o_orderkey, (year(o_orderdate) - CASE WHEN month(o_orderdate) < 3 THEN 1 ELSE 0 END)::BIGINT AS season FROM orders""")
def season(spark, d):
    return nz.with_season(table(spark, d, "orders"), "o_orderdate").select("o_orderkey", "season")


@query("P8_kickoff_utc", """
WITH t AS (SELECT event_id, ts::DATE AS day, hour(ts) AS h, minute(ts) AS m, event_type FROM events)
SELECT event_id, CASE WHEN event_type <> 'error' THEN
  day::TIMESTAMP + to_hours(h::INT) + to_minutes(m::INT) + to_hours(5) END AS kickoff FROM t""")
def kickoff(spark, d):
    ts, kind = F.col("ts"), F.col("event_type")
    clock = (
        F.when(kind == "error", "later").when(kind == "click", F.date_format(ts, "HH:mm"))
        .when(kind == "view", F.concat(F.date_format(ts, "HH:mm"), F.lit(":00"))).otherwise(F.date_format(ts, "h:mm a")))
    return table(spark, d, "events").select("event_id", S.kickoff_utc(F.to_date(ts), clock).alias("kickoff"))


@query("P9_weighted_points", """
WITH s AS (SELECT l_orderkey, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS rec,
  sum(CASE WHEN l_returnflag = 'R' THEN l_quantity::DECIMAL(18,2) END)::DOUBLE AS yards, count(*)::DOUBLE AS pts_ppr,
  (count(*) * 2)::DOUBLE AS pts_std FROM lineitem GROUP BY l_orderkey),
o AS (SELECT o_orderkey, o_orderstatus AS st FROM orders)
SELECT l_orderkey, round_even(CASE st WHEN 'F' THEN rec * 0.5 + coalesce(yards * 0.125, 0) WHEN 'O' THEN coalesce(yards * 0.25, pts_std) ELSE pts_std END, 2) AS points
FROM s JOIN o ON o_orderkey = l_orderkey""")
def points(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("rec"),
        F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity").cast("decimal(18,2)"))).cast("double").alias("yards"),
        F.count(F.lit(1)).cast("double").alias("n"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("st"))
    stats = F.create_map(F.lit("rec"), "rec", F.lit("yards"), "yards", F.lit("pts_ppr"), "n", F.lit("pts_std"), F.col("n") * 2)
    w = (F.when(F.col("st") == "F", S.literal_map({"rec": 0.5, "yards": 0.125}))
         .when(F.col("st") == "O", S.literal_map({"yards": 0.25})).otherwise(S.literal_map({"sacks": 1.0})))
    return li.join(o, "l_orderkey").select("l_orderkey", S.weighted_points(stats, w).alias("points"))


@query("P10_format_from_settings", f"""
WITH {FACTS}, t AS (SELECT entity, list(team) AS slots, avg(CASE WHEN status = 'P' THEN 1 ELSE 0 END) AS rec FROM facts GROUP BY entity)
SELECT entity, CASE WHEN rec >= 0.75 THEN 'ppr' WHEN rec >= 0.25 THEN 'half_ppr' ELSE 'standard' END AS scoring,
  list_contains(slots, '1-URGENT') OR len(list_filter(slots, lambda x: x = '2-HIGH')) > 1 AS two_qb FROM t""")
def settings(spark, d):
    slot = F.when(F.col("team") == "1-URGENT", "SUPER_FLEX").when(F.col("team") == "2-HIGH", "QB").otherwise("RB")
    t = facts(spark, d).groupBy("entity").agg(
        F.max(F.when(slot == "SUPER_FLEX", 1).otherwise(0)).alias("sf"), F.count_if(slot == "QB").alias("qb"),
        F.avg(F.when(F.col("status") == "P", 1).otherwise(0)).alias("rec"))
    slots = F.concat(F.array_repeat(F.lit("QB"), F.col("qb").cast("int")), F.array_repeat(F.lit("SUPER_FLEX"), F.col("sf")))
    return t.select("entity", S.scoring_class(F.col("rec")).alias("scoring"), S.two_quarterback(slots).alias("two_qb"))


@query("P11_snippet", """
SELECT doc_id, array_to_string(list_transform(list_filter(regexp_split_to_array(text, '\\r\\n|\\n|\\r'),
  lambda x: trim(x) <> '' AND NOT starts_with(ltrim(x), '#')), lambda x: trim(regexp_replace(x, '^- ', ''))), ' ') AS snippet FROM documents""")
def snippets(spark, d):
    return table(spark, d, "documents").select("doc_id", S.snippet(F.col("text")).alias("snippet"))


@query("P11_bounded", """
WITH t AS (SELECT doc_id, trim(regexp_replace(text, '[\\s\\x{a0}]+', ' ', 'g')) AS x FROM documents)
SELECT doc_id, CASE WHEN length(x) <= 700 THEN x ELSE rtrim(x[1:697]) || '...' END AS body FROM t""")
def bounded(spark, d):
    return table(spark, d, "documents").select("doc_id", S.bounded(F.col("text"), 700).alias("body"))


@query("P12_normalize_url", """
SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1)) ||
    CASE WHEN regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') = '' THEN '/'
         ELSE regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') END ||
    regexp_extract(regexp_replace(url, '#.*$', ''), '(\\?.+)$', 1) AS url FROM pages""")
def urls(spark, d):
    return table(spark, d, "pages").select("page_id", S.normalize_url(F.col("url")).alias("url"))


@query("P13_status_code", """
WITH t AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN ' Out ' WHEN o_orderstatus = 'P' AND o_orderpriority < '3' THEN '  '
  WHEN o_orderstatus = 'P' THEN 'Injured Reserve' ELSE lower(o_orderpriority) END AS raw FROM orders)
SELECT o_orderkey, CASE trim(raw) WHEN 'Out' THEN 'O' WHEN '' THEN NULL WHEN 'Injured Reserve' THEN 'IR' ELSE upper(trim(raw)) END AS code,
  trim(raw) IN ('Out', 'Injured Reserve') AS unavailable FROM t""")
def status(spark, d):
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    raw = (F.when(s == "F", " Out ").when((s == "P") & (p < "3"), "  ").when(s == "P", "Injured Reserve").otherwise(F.lower(p)))
    code = S.status_code(raw)
    return table(spark, d, "orders").select("o_orderkey", code.alias("code"), S.is_unavailable(code).alias("unavailable"))


@query("P14_embedding_text", """
SELECT doc_id, sha256('Title: doc ' || doc_id || chr(10) || 'Source: ' || source || chr(10) || 'Published: ' || n_chars || chr(10) ||
  'Players: ' || lang || ', ' || source || chr(10) || 'Teams: ' || chr(10) || 'Document type: news' || chr(10) ||
  'Storyline: role of ' || lang || chr(10) || chr(10) || text) AS hash FROM documents""")
def embed_text(spark, d):
    text = S.embedding_text(
        F.concat(F.lit("doc "), F.col("doc_id").cast("string")), F.col("source"), F.col("n_chars").cast("string"),
        F.array("lang", "source"), F.array().cast("array<string>"), F.lit("news"),
        F.concat(F.lit("role_of_"), "lang"), F.col("text"))
    return table(spark, d, "documents").select("doc_id", S.text_hash(text).alias("hash"))


@query("P15_content_hash", """
SELECT event_id, sha256('{"a":{"k":' || (json_extract(props, '$.k')) || ',"z":1},"v":' || floor(value)::BIGINT || '}') AS hash, TRUE AS agrees FROM events""")
def json_hash(spark, d):
    """Hash of each event's payload, spelled in two key orders that must agree."""
    e = table(spark, d, "events")
    value = F.floor("value").cast("string")
    one = F.concat(F.lit('{"v": '), value, F.lit(', "a": {"z": 1, "k": '), F.get_json_object("props", "$.k"), F.lit("}}"))
    two = F.concat(F.lit('{"a":{"k":'), F.get_json_object("props", "$.k"), F.lit(',"z":1},  "v":'), value, F.lit("}"))
    a, b = S.content_hash(one), S.content_hash(two)
    return e.select("event_id", a.alias("hash"), (a == b).alias("agrees"))


@query("P16_normalize_report", """
WITH f AS (SELECT e.event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created, event_type AS title,
  CASE WHEN value < 50 THEN ' ' ELSE 'worth ' || props END AS descr, CASE WHEN value > 100 THEN '' ELSE 'low' END AS impact,
  CASE event_type WHEN 'view' THEN 'fa' WHEN 'click' THEN ' ' ELSE event_type END AS team_id FROM events e),
g AS (SELECT event_id, concat_ws(chr(10) || chr(10), CASE WHEN trim(descr) <> '' THEN '# News' || chr(10) || chr(10) || trim(descr) END,
    CASE WHEN trim(impact) <> '' THEN '# Fantasy impact' || chr(10) || chr(10) || trim(impact) END) AS body,
  CASE WHEN upper(trim(team_id)) IN ('', 'FA') THEN '' ELSE upper(trim(team_id)) END AS teams, created, title FROM f)
SELECT 'feed:' || event_id AS report_id, title, body, teams, created::TIMESTAMP AS published_at,
  (year(created::TIMESTAMP) - CASE WHEN month(created::TIMESTAMP) < 3 THEN 1 ELSE 0 END)::BIGINT AS season,
  CASE WHEN u.n > 10 THEN 'busy' END AS document_type
FROM g LEFT JOIN (SELECT event_id, count(*) OVER (PARTITION BY user_id, ts::DATE) AS n FROM events) u USING (event_id)""")
def report(spark, d):
    e = table(spark, d, "events")
    kind = F.col("event_type")
    feed = e.select(
        F.col("event_id").alias("external_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created"),
        kind.alias("title"), F.when(F.col("value") < 50, " ").otherwise(F.concat(F.lit("worth "), "props")).alias("desc"),
        F.when(F.col("value") > 100, "").otherwise("low").alias("impact"),
        F.when(kind == "view", "fa").when(kind == "click", " ").otherwise(kind).alias("team_id"))
    counts = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n")).filter("n > 10")
    extraction = e.withColumn("day", F.to_date("ts")).join(counts, ["user_id", "day"]).select(
        F.col("event_id").alias("external_id"), F.lit("busy").alias("document_type"))
    out = nz.normalize_report(feed, extraction, "feed")
    return out.select("report_id", "title", "body", F.array_join("teams", ",").alias("teams"), "published_at", "season", "document_type")


@query("P17_enum_and_range_filter", """
SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_totalprice BETWEEN 100000 AND 200000""")
def filters(spark, d):
    return table(spark, d, "orders").filter(
        S.one_of(F.col("o_orderstatus"), ["F", "P"]) & S.in_range(F.col("o_totalprice"), 100000, 200000)).select(
        "o_orderkey", "o_totalprice")


BOUNDS = """lim AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
e AS (SELECT floor((lo + (hi - lo) * 0.10) / 25 + 0.5) * 25 AS a, floor((lo + (hi - lo) * 0.85) / 25 + 0.5) * 25 AS b FROM lim),
bounds AS (SELECT list(floor((a + i * (b - a) / 16) / 25 + 0.5) * 25 ORDER BY i) AS bs FROM e, range(0, 17) AS g(i))"""


def boundaries(spark, d):
    o = table(spark, d, "orders")
    return o.agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi")).select(
        S.linear_boundaries(F.col("lo"), F.col("hi")).alias("bs"))


@query("P18_band_by_boundaries", f"""
WITH {BOUNDS} SELECT o_orderkey, len(list_filter(bs, lambda x: x <= o_totalprice))::BIGINT AS band FROM orders, bounds""")
def bands(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice").withColumn("bs", boundaries(spark, d).scalar())
    return o.select("o_orderkey", S.band_by_boundaries(F.col("o_totalprice"), F.col("bs")).alias("band"))


@query("P19_linear_boundaries", f"""
WITH {BOUNDS} SELECT unnest(range(1, 18)) AS i, unnest(bs)::BIGINT AS boundary FROM bounds""")
def bound_rows(spark, d):
    return boundaries(spark, d).select(F.posexplode("bs").alias("p", "boundary")).select(
        (F.col("p") + 1).alias("i"), "boundary")


@query("P20_lock_state", """
WITH t AS (SELECT event_id, ts <= TIMESTAMP '2024-01-15 12:00:00' OR event_type IN ('error') AS locked, event_type,
  value > 100 AS bench, value > 400 AS out FROM events)
SELECT event_id, locked, event_type IN ('view', 'click', 'error') AND CASE WHEN locked THEN NOT bench ELSE NOT out END AS can_play FROM t""")
def locks(spark, d):
    kind, value = F.col("event_type"), F.col("value")
    state = F.when(kind == "error", " Final ").otherwise("scheduled")
    locked = S.is_locked(F.col("ts"), state, F.lit("2024-01-15 12:00:00").cast("timestamp_ntz"))
    eligible = F.when(kind.isin("view", "click", "error"), F.array(F.lit("FLEX"))).otherwise(F.array(F.lit("QB")))
    group = F.when(value > 100, "bench").otherwise("starter")
    play = S.can_fill(F.lit("FLEX"), F.lit("FLEX1"), eligible, group, F.when(value <= 100, "FLEX1"), locked, value > 400)
    return table(spark, d, "events").select("event_id", locked.alias("locked"), play.alias("can_play"))


@query("P21_normalize_rankings", f"""
WITH {SNAPSHOTS}, ids AS (SELECT c_custkey, c_name AS id FROM customer WHERE c_acctbal > 0),
cfg(page, scoring_format, league_format) AS (VALUES ('click', 'ppr', 'one'), ('view', 'ppr', 'two'), ('error', 'source', 'one'))
SELECT id AS player_id, grp AS page, scoring_format, league_format, day AS scrape_date, total::DOUBLE AS overall_rank,
  try_cast(low AS INTEGER)::BIGINT AS best_rank, NULL::BIGINT AS worst_rank, coalesce(CASE WHEN n > 2 THEN 'T' || n END, grp) AS team
FROM snapshots JOIN cfg ON page = grp JOIN ids ON c_custkey = player""")
def rankings(spark, d):
    pages = snapshots(spark, d).select(
        F.col("grp").alias("page"), F.col("day").alias("scrape_date"), F.col("player").alias("external_id"),
        F.col("total").alias("ecr"), F.round("low").cast("int").cast("string").alias("best"), F.lit("n/a").alias("worst"),
        F.lit("P").alias("position"), F.when(F.col("n") > 2, F.concat(F.lit("T"), F.col("n").cast("string"))).alias("team"),
        F.col("grp").alias("tm"))
    config = spark.createDataFrame(
        [("click", "ppr", "one", "s"), ("view", "ppr", "two", "s"), ("error", "source", "one", "s")],
        "page string, scoring_format string, league_format string, snapshot_type string")
    ids = table(spark, d, "customer").filter("c_acctbal > 0").select(
        F.col("c_custkey").alias("external_id"), F.col("c_name").alias("player_id"))
    rows, _ = nz.normalize_rankings(pages, config, ids)
    return rows.drop("snapshot_type", "position")


@query("P21_unmatched_per_page", f"""
WITH {SNAPSHOTS} SELECT grp AS page, count(*) AS n_unmatched FROM snapshots
WHERE grp IN ('click', 'view', 'error') AND player NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY grp""")
def unmatched(spark, d):
    pages = snapshots(spark, d).select(
        F.col("grp").alias("page"), F.col("day").alias("scrape_date"), F.col("player").alias("external_id"),
        F.col("total").alias("ecr"), F.lit("1").alias("best"), F.lit("n/a").alias("worst"),
        F.lit("P").alias("position"), F.lit("T").alias("team"), F.col("grp").alias("tm"))
    config = spark.createDataFrame(
        [("click", "ppr", "one", "s"), ("view", "ppr", "two", "s"), ("error", "source", "one", "s")],
        "page string, scoring_format string, league_format string, snapshot_type string")
    ids = table(spark, d, "customer").filter("c_acctbal > 0").select(
        F.col("c_custkey").alias("external_id"), F.col("c_name").alias("player_id"))
    return nz.normalize_rankings(pages, config, ids)[1]
