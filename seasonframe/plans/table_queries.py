"""Queries of the sources and sinks: what is written to the work folder is read back and compared."""

from pyspark.sql import functions as F

from ..common import work_dir
from ..sources import documents as sd
from ..sources import provider_json as pj
from ..sources import tables as st
from ..sources.bucket_store import BucketStore
from .inputs import FACTS, FEED, SNAPSHOTS, STORED, facts, feed_docs, snapshots, stored_docs, table
from .join_queries import stored_snapshots
from .registry import query


@query("S1_read_table_csv", """
SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders""")
def read_csv(spark, d):
    path = f"{work_dir(spark)}/orders.csv"
    table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus").write.csv(path, header=True)
    return st.read_table(spark, path)


@query("S1_read_table_jsonl", "SELECT event_id, user_id, value, props FROM events")
def read_jsonl(spark, d):
    path = f"{work_dir(spark)}/events.jsonl"
    table(spark, d, "events").select("event_id", "user_id", "value", "props").write.json(path)
    return st.read_table(spark, path)


@query("S1_read_table_parquet", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def read_parquet(spark, d):
    return st.read_table(spark, f"{d}/nation.parquet").select("n_nationkey", "n_name")


@query("S2_latest_snapshot", f"""
WITH {SNAPSHOTS} SELECT player, day, total::DOUBLE AS total FROM snapshots WHERE day = (SELECT max(day) FROM snapshots)""")
def latest(spark, d):
    return st.latest_snapshot(snapshots(spark, d), "day").select("player", "day", "total")


@query("S2_latest_snapshot_per_group", f"""
WITH {SNAPSHOTS} SELECT player, day, total::DOUBLE AS total FROM snapshots s
WHERE day = (SELECT max(day) FROM snapshots t WHERE t.player = s.player)""")
def latest_by(spark, d):
    return st.latest_snapshot(snapshots(spark, d), "day", ["player"]).select("player", "day", "total")


@query("S2_latest_snapshot_dated", f"""
WITH {SNAPSHOTS} SELECT player, day, total::DOUBLE AS total, grp FROM snapshots s
WHERE day = (SELECT max(day) FROM snapshots t WHERE t.grp = s.grp)""")
def latest_dated(spark, d):
    return st.latest_snapshot(stored_snapshots(spark, d), "day", ["grp"], dated=True).select("player", "day", "total", "grp")


@query("S2_pinned_or_latest", f"""
WITH {SNAPSHOTS} SELECT player, day, total::DOUBLE AS total FROM snapshots WHERE day = DATE '2024-01-10'""")
def pinned(spark, d):
    return st.pinned_or_latest(snapshots(spark, d), "day", "2024-01-10").select("player", "day", "total")


@query("S3_write_snapshot", f"""
WITH {SNAPSHOTS} SELECT player, day, CASE WHEN day = DATE '2024-01-10' THEN 2 ELSE 1 END * total::DOUBLE AS total FROM snapshots""")
def write(spark, d):
    """A rerun of one day replaces that day only."""
    path = f"{work_dir(spark)}/snapshots"
    snaps = snapshots(spark, d).select("player", "day", F.col("total").cast("double").alias("total"))
    st.write_snapshot(snaps, path, "day")
    st.write_snapshot(snaps.filter("day = DATE '2024-01-10'").withColumn("total", F.col("total") * 2), path, "day")
    return spark.read.parquet(path)


@query("S4_upsert", """
SELECT o_orderkey AS k, CASE WHEN n IS NULL THEN o_orderstatus ELSE 'L' END AS s, coalesce(n, 0) AS n
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_quantity > 45 GROUP BY l_orderkey) ON l_orderkey = o_orderkey""")
def upsert(spark, d):
    old = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.lit(0).cast("bigint").alias("n"))
    new = table(spark, d, "lineitem").filter("l_quantity > 45").groupBy(F.col("l_orderkey").alias("k")).agg(
        F.lit("L").alias("s"), F.count(F.lit(1)).alias("n"))
    return st.upsert(old, new.select("k", "s", "n"), ["k"])


@query("S4_upsert_buckets", """
SELECT o_orderkey AS k, CASE WHEN n IS NULL THEN o_orderstatus ELSE 'L' END AS s, coalesce(n, 0) AS n
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_quantity > 49 GROUP BY l_orderkey) ON l_orderkey = o_orderkey""")
def upsert_buckets(spark, d):
    """Orders as a stored table in buckets; lines arrive in two batches, the second one with late rows."""
    old = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.lit(0).cast("bigint").alias("n"))
    new = table(spark, d, "lineitem").filter("l_quantity > 49").groupBy(F.col("l_orderkey").alias("k")).agg(
        F.lit("L").alias("s"), F.count(F.lit(1)).alias("n"))
    store = BucketStore(spark, f"{work_dir(spark)}/orders", {"orders": old.schema}, ["k"], 8)
    store.upsert("orders", 0, old)
    store.upsert("orders", 1, new.select("k", "s", "n"), [F.col("n")])
    store.upsert("orders", 2, old.where("k % 7 = 0"), [F.col("n")])
    return store.read("orders")


@query("S5_replace_partition", f"""
WITH {FACTS} SELECT entity, game, season FROM facts WHERE season <> 1998 OR status = 'F'""")
def replace(spark, d):
    path = f"{work_dir(spark)}/seasons"
    f = facts(spark, d).select("entity", "game", "status", "season")
    f.write.partitionBy("season").parquet(path)
    st.replace_partition(f.filter("season = 1998 AND status = 'F'"), path, "season")
    return spark.read.parquet(path).select("entity", "game", "season")


@query("S6_profile", """
SELECT 'nation' AS "table", (SELECT count(*) FROM nation) AS n_rows, 3::BIGINT AS n_columns, 'n_nationkey,n_name,n_regionkey' AS columns, 0::BIGINT AS n_dropped, TIMESTAMP '2024-01-31 06:00:00' AS processed_at
UNION ALL SELECT 'orders', (SELECT count(*) FROM orders), 6, 'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority',
  (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)), TIMESTAMP '2024-01-31 06:00:00'""")
def profile(spark, d):
    o = table(spark, d, "orders")
    gone = o.join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")
    return st.profile({"nation": table(spark, d, "nation"), "orders": o}, {"orders": gone}, F.lit("2024-01-31 06:00:00").cast("timestamp"))


@query("S7_append_versions", f"""
WITH {FEED}, {STORED} SELECT doc_id, hash FROM feed WHERE (doc_id, hash) NOT IN (SELECT doc_id, hash FROM stored)""")
def append(spark, d):
    return st.append_versions(stored_docs(spark, d).select("doc_id", "hash"), feed_docs(spark, d).select("doc_id", "hash", "lang"), "doc_id", "hash").select("doc_id", "hash")


@query("S7_current_versions", """
SELECT source, doc_id, sha256(text) AS hash FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) = 1""")
def current(spark, d):
    return st.current_versions(feed_docs(spark, d).select("source", "doc_id", "hash"), "source", [F.col("doc_id")])


@query("S8_sink_safe", """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts, strftime(ts::DATE, '%Y-%m-%d') AS day,
  CASE WHEN value >= 10 THEN value END AS value FROM events""")
def safe(spark, d):
    e = table(spark, d, "events")
    return st.sink_safe(e.select("event_id", "ts", F.to_date("ts").alias("day"), F.when(
        F.col("value") < 10, F.lit(float("nan"))).otherwise(F.col("value")).alias("value")))


def with_header(spark, d):
    """Every document as a text file with a header; toxic ones lack a key."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    quoted = lambda c: F.to_json(F.array(c))
    lines = [
        F.concat(F.lit('id: "doc-'), F.col("doc_id").cast("string"), F.lit('"')), F.concat(F.lit("title: About: "), "lang"),
        F.concat(F.lit("source: "), "source"), F.lit("url: https://example.com/x"), F.lit("published_at: 2024-01-01"),
        F.lit("fetched_at: 2024-01-02"), F.concat(F.lit("players: "), quoted(F.col("lang"))), F.lit("teams: []"),
        F.when(F.coalesce("toxic", F.lit(0)) == 0, "season: 2024"), F.lit("document_type: news"), F.lit("storyline: role"),
        F.lit("content_mode: full"), F.lit("author: null")]
    text = F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n\n"), "text", F.lit("\n\n# Source note\n\nfrom a feed\n"))
    return docs.select("doc_id", text.alias("value"))


@query("S9_frontmatter_accepted", r"""
SELECT 'doc-' || doc_id AS id, 'About: ' || lang AS title, source, 2024::BIGINT AS season, lang AS players, 0::BIGINT AS n_teams, NULL::VARCHAR AS author,
  sha256(regexp_replace(text, '^[\s\x0B]+|[\s\x0B]+$', '', 'g')) AS body FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(toxic, 0) = 0""")
def accepted(spark, d):
    a = sd.parse_frontmatter(with_header(spark, d), "value").accepted
    return a.select("id", "title", "source", "season", F.array_join("players", ",").alias("players"),
                    F.size("teams").alias("n_teams"), "author", F.sha2("body", 256).alias("body"))


@query("S9_frontmatter_rejected", "SELECT doc_id, 'missing season' AS reason FROM labels WHERE toxic = 1")
def rejected(spark, d):
    return sd.parse_frontmatter(with_header(spark, d), "value").rejected


@query("S10_snapshot_chain", "SELECT doc_id, lang FROM documents")
def chain(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    base = docs.join(labels, "doc_id", "left_semi").select("doc_id", "lang")
    child = docs.join(labels, "doc_id", "left_anti").select("doc_id", "lang")
    n = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    return st.snapshot_chain([(base, None), (child, n)], "doc_id")


@query("S11_projections", """
SELECT event_id::VARCHAR AS player_id, CASE WHEN event_type = 'click' THEN trim('U' || user_id || ' ' || event_type) || ' D/ST'
    WHEN event_type = 'error' THEN event_id::VARCHAR ELSE trim('U' || user_id || ' ' || event_type) END AS display_name,
  CASE event_type WHEN 'click' THEN 'DEF' WHEN 'view' THEN 'QB' ELSE 'WR' END AS position, 2024::BIGINT AS season, value AS yards, 1::BIGINT AS n_stats
FROM events WHERE event_type IN ('click', 'view', 'error')""")
def projections(spark, d):
    kind = F.col("event_type")
    player = F.struct(
        F.when(kind != "error", F.concat(F.lit("U"), F.col("user_id").cast("string"))).alias("first_name"),
        F.when(kind == "error", " ").otherwise(kind).alias("last_name"),
        F.when(kind == "click", "def").when(kind != "view", "wr").alias("position"), F.array(F.lit("qb")).alias("fantasy_positions"))
    item = F.to_json(F.struct(
        F.when(kind.isin("click", "view", "error"), F.col("event_id")).alias("player_id"), F.lit(2024).alias("season"),
        player.alias("player"), F.create_map(F.lit("yards"), F.col("value").cast("string"), F.lit("note"), F.lit("n/a")).alias("stats")))
    rows = table(spark, d, "events").select(item.alias("j"))
    return pj.flatten_provider_json(rows, "j", "projections").select(
        "player_id", "display_name", "position", "season", F.element_at("stats", "yards").alias("yards"), F.size("stats").alias("n_stats"))


@query("S11_market_values", """
SELECT p_partkey::VARCHAR AS market_id, p_name AS display_name, upper(p_type) AS position, CASE WHEN p_size < 25 THEN upper(p_brand) END AS team,
  p_size::BIGINT AS value, p_partkey AS overall_rank, 0::BIGINT AS trend_30_day FROM part WHERE p_size <> 10""")
def market(spark, d):
    p = table(spark, d, "part")
    player = F.struct(
        F.col("p_partkey").alias("id"), F.when(F.col("p_size") == 10, " ").otherwise(F.concat(F.lit(" "), "p_name")).alias("name"),
        F.lower("p_type").alias("position"), F.when(F.col("p_size") < 25, F.lower("p_brand")).otherwise(" ").alias("maybeTeam"))
    item = F.to_json(F.struct(player.alias("player"), F.col("p_size").alias("value"), F.col("p_partkey").alias("overallRank"),
                              F.col("p_partkey").alias("positionRank")))
    return pj.flatten_provider_json(p.select(item.alias("j")), "j", "market_values").select(
        "market_id", "display_name", "position", "team", "value", "overall_rank", "trend_30_day")


@query("S11_draft_picks", """
SELECT o_orderkey AS pick_no, year(o_orderdate) AS round, month(o_orderdate) AS draft_slot,
  CASE WHEN o_orderstatus = 'F' THEN o_custkey ELSE month(o_orderdate) END AS roster_id, o_custkey::VARCHAR AS external_id, o_orderpriority AS display_name FROM orders""")
def picks(spark, d):
    o = table(spark, d, "orders")
    item = F.to_json(F.struct(
        F.col("o_orderkey").alias("pick_no"), F.year("o_orderdate").alias("round"), F.month("o_orderdate").alias("draft_slot"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_custkey")).alias("roster_id"), F.col("o_custkey").alias("player_id"),
        F.struct(F.concat(F.lit(" "), "o_orderpriority").alias("first_name"), F.lit("").alias("last_name")).alias("metadata")))
    return pj.flatten_provider_json(o.select(item.alias("j")), "j", "draft_picks").select(
        "pick_no", "round", "draft_slot", "roster_id", "external_id", "display_name")
