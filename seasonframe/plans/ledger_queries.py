"""Queries of telemetry, cost, quota and ledger operators, with events as the ledger."""

from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import incremental as inc
from .inputs import money, table
from .registry import query



def k():
    return F.get_json_object("props", "$.k").cast("bigint")


K_SQL = "json_extract(props, '$.k')::BIGINT"


def telemetry(spark, d):
    e = table(spark, d, "events").withColumn("k", k()).withColumn("value", money("value"))
    # Labels arrive as a JSON array text.
    text = F.concat(F.lit('["'), "event_type", F.lit('","'), F.when(F.col("k") > 50, "high").otherwise("low"), F.lit('"]'))
    e = e.withColumn("labels", F.from_json(text, "array<string>"))
    return agg.telemetry_rollup(e, ["k", "value"], {"failed": F.col("event_type") == "error", "high": F.col("k") > 50},
                                ["k"], "event_type", "labels")


@query("A7_telemetry_totals", f"""
SELECT count(*) AS executions, sum({K_SQL})::BIGINT AS k, sum(value::DECIMAL(18,2))::DOUBLE AS value,
  count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) FILTER (WHERE {K_SQL} > 50) AS high,
  round_even(avg({K_SQL}), 2) AS average_k FROM events""")
def totals(spark, d):
    return telemetry(spark, d).totals


@query("A7_telemetry_by_label", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def by_label(spark, d):
    return telemetry(spark, d).by_label


@query("A7_telemetry_label_array", f"""
SELECT unnest([event_type, CASE WHEN {K_SQL} > 50 THEN 'high' ELSE 'low' END]) AS event_type, count(*) AS n FROM events GROUP BY 1""")
def labels(spark, d):
    return telemetry(spark, d).labels


@query("A8_token_cost", """
WITH c AS (SELECT conv_id, CASE WHEN turn > 6 THEN 'other' WHEN role = 'system' THEN 'gpt-5.6' WHEN role = 'user' THEN 'GPT-5.6-luna-2026' ELSE 'gpt-5.6-terra' END AS model,
  length(text) AS i, length(text) + 5 - turn * 10 AS ca, turn * 10 AS o FROM conversations),
p AS (SELECT *, greatest(0, least(i, ca)) AS cached FROM c WHERE i <> 0 OR o <> 0)
SELECT conv_id, CASE WHEN NOT bool_or(model = 'other') THEN round(sum(CASE model
   WHEN 'gpt-5.6' THEN (i - cached) * 4.0::DOUBLE + cached * 0.4::DOUBLE + o * 20.0::DOUBLE
   WHEN 'gpt-5.6-terra' THEN (i - cached) * 2.0::DOUBLE + cached * 0.2::DOUBLE + o * 12.0::DOUBLE
   ELSE (i - cached) * 0.2::DOUBLE + cached * 0.02::DOUBLE + o * 1.2::DOUBLE END / 1000000), 9) END AS cost_usd,
  count(*) AS n_calls, count(*) FILTER (WHERE model = 'other') AS n_unknown FROM p GROUP BY conv_id""")
def cost(spark, d):
    c = table(spark, d, "conversations")
    model = (F.when(F.col("turn") > 6, "other").when(F.col("role") == "system", "gpt-5.6")
             .when(F.col("role") == "user", "GPT-5.6-luna-2026").otherwise("gpt-5.6-terra"))
    calls = c.select("conv_id", model.alias("model"), F.length("text").alias("input_tokens"),
                     (F.length("text") + 5 - F.col("turn") * 10).alias("cached_input_tokens"),
                     (F.col("turn") * 10).alias("output_tokens"))
    return agg.token_cost(calls, ["conv_id"]).withColumn("cost_usd", F.round("cost_usd", 9))


@query("A9_rolling_quota", f"""
WITH r AS (SELECT event_id, event_type AS provider, epoch_us(ts) AS us, {K_SQL} AS k FROM events),
w AS (SELECT *, coalesce(sum(k) OVER (PARTITION BY provider ORDER BY us RANGE BETWEEN 86399999999 PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used_24h FROM r)
SELECT event_id, provider, k, used_24h, used_24h >= 3300 AS exhausted FROM w""")
def quota(spark, d):
    runs = table(spark, d, "events").select("event_id", F.col("event_type").alias("provider"), F.col("ts").cast("timestamp").alias("ts"), k().alias("k"))
    return agg.rolling_quota(runs, "provider", "ts", "k", 3300).drop("ts")


@query("A10_store_status", """
WITH a AS (SELECT doc_id FROM labels WHERE quality = 1), c AS (SELECT d.* FROM documents d SEMI JOIN a USING (doc_id))
SELECT count(*) AS n_chunks, count(*) FILTER (WHERE n_chars > 200) AS n_embedded,
  (SELECT string_agg(lang, ',' ORDER BY lang) FROM (SELECT DISTINCT lang FROM c WHERE n_chars > 200)) AS models,
  (SELECT count(*) FROM a) AS n_active FROM c""")
def store(spark, d):
    reports = table(spark, d, "labels").select(F.col("doc_id").alias("report_id"), (F.col("quality") == 1).alias("active"))
    chunks = table(spark, d, "documents").select(
        F.col("doc_id").alias("report_id"), F.when(F.col("n_chars") > 200, F.col("lang")).alias("embedding_model"))
    return agg.store_status(reports, chunks).withColumn("models", F.array_join("models", ","))


RUN_STATUS = "CASE event_type WHEN 'click' THEN 'succeeded' WHEN 'view' THEN 'partial' ELSE 'failed' END"


@query("A11_backfill_progress", f"""
WITH r AS (SELECT user_id AS backfill, {RUN_STATUS} AS status, {K_SQL} AS run_key, floor(value)::BIGINT AS n_new, event_id % 7 AS n_changed,
  date_trunc('month', ts)::DATE AS pinned_date FROM events)
SELECT backfill, sum(n_new)::BIGINT AS n_new, sum(n_changed)::BIGINT AS n_changed,
  count(DISTINCT CASE WHEN status = 'succeeded' THEN run_key END) AS n_completed, min(pinned_date) AS pinned_date
FROM r WHERE status <> 'failed' GROUP BY backfill""")
def backfill(spark, d):
    return agg.backfill_progress(backfill_runs(spark, d), "backfill")


@query("A11_completed_keys", f"""
SELECT DISTINCT user_id AS backfill, {K_SQL} AS run_key FROM events WHERE {RUN_STATUS} = 'succeeded'""")
def completed(spark, d):
    return agg.completed_keys(backfill_runs(spark, d), "backfill")


def backfill_runs(spark, d):
    return table(spark, d, "events").select(
        F.col("user_id").alias("backfill"), F.expr(RUN_STATUS).alias("status"), k().alias("run_key"),
        F.floor("value").alias("n_new"), (F.col("event_id") % 7).alias("n_changed"),
        F.to_date(F.date_trunc("month", "ts")).alias("pinned_date"))


@query("A18_report_contract", f"""
WITH e AS (SELECT event_id, user_id, event_type, value, {K_SQL} AS k FROM events),
d AS (SELECT CASE WHEN k = 50 THEN 'x:' ELSE 'ev:' END || event_id AS report_id, value < 450 AS raw, CASE WHEN k = 7 THEN ' ' ELSE event_type END AS title,
   k <> 8 AS parses, value / 400 <= 1 AS conf, event_type <> 'error' AS basis, event_type <> 'view' AS role, k <= 90 AS once, value > 5 AS agree FROM e)
SELECT report_id, 'id is provider:external_id' AS rule FROM d WHERE report_id LIKE 'x:%'
UNION ALL SELECT report_id, 'raw row exists' FROM d WHERE NOT raw
UNION ALL SELECT report_id, 'title is not blank' FROM d WHERE trim(title) = ''
UNION ALL SELECT report_id, 'publish time parses' FROM d WHERE NOT parses
UNION ALL SELECT report_id, 'confidence in range' FROM d WHERE NOT conf
UNION ALL SELECT report_id, 'basis allowed' FROM d WHERE NOT basis
UNION ALL SELECT report_id, 'role allowed' FROM d WHERE NOT role
UNION ALL SELECT report_id, 'no entity twice' FROM d WHERE NOT once
UNION ALL SELECT report_id, 'id list agrees' FROM d WHERE NOT agree""")
def contract(spark, d):
    e = table(spark, d, "events").withColumn("k", k())
    user = F.col("user_id").cast("string")
    entity = lambda p: F.struct(p.alias("player_id"), (F.col("value") / 400).alias("confidence"),
                                F.col("event_type").alias("basis"), F.col("event_type").alias("role"))
    twice = F.col("k") > 90
    ids = F.when(twice, F.array(user, user)).otherwise(F.array(user))
    docs = e.select(
        F.concat(F.when(F.col("k") == 50, "x:").otherwise("ev:"), F.col("event_id").cast("string")).alias("report_id"),
        F.lit("ev").alias("provider"), F.col("event_id").alias("external_id"), F.sha2("props", 256).alias("source_hash"),
        F.when(F.col("k") == 7, " ").otherwise(F.col("event_type")).alias("title"),
        F.when(F.col("k") == 8, "yesterday").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("published_at"),
        F.when(F.col("value") > 5, ids).otherwise(F.array(F.lit("nobody"))).alias("player_ids"),
        F.when(twice, F.array(entity(user), entity(user))).otherwise(F.array(entity(user))).alias("entities"))
    raw = e.filter("value < 450").select(
        F.lit("ev").alias("provider"), F.col("event_id").alias("external_id"), F.sha2("props", 256).alias("source_hash"))
    kinds = ["view", "click", "purchase", "login", "signup", "logout"]
    return agg.report_contract(docs, raw, kinds, [k for k in kinds if k != "view"] + ["error"])


@query("T8_claim_once", """
SELECT DISTINCT user_id, event_type, ts::DATE AS day FROM events
EXCEPT SELECT user_id, event_type, ts::DATE FROM events WHERE value < 100""")
def claims(spark, d):
    keys = table(spark, d, "events").select("user_id", "event_type", F.to_date("ts").alias("day"), "value")
    cols = ["user_id", "event_type", "day"]
    return inc.claim_once(keys.filter("value < 100"), keys.select(*cols), cols)


@query("T9_pending", f"""
SELECT event_id, user_id FROM events WHERE event_type IN ('error', 'view') AND value > 300 ORDER BY ts, event_id LIMIT 50""")
def pending(spark, d):
    ledger = table(spark, d, "events").select(
        "event_id", "user_id", "ts", F.expr("CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'pending' ELSE 'sent' END").alias("status"),
        F.when(F.col("value") > 300, F.col("props")).alias("message"))
    return inc.pending(ledger, "status", "message", "ts", "event_id", 50).select("event_id", "user_id")


CHANGE = "CASE event_type WHEN 'click' THEN 'new' WHEN 'view' THEN 'changed' WHEN 'error' THEN 'invalid' ELSE 'unchanged' END"


@query("T10_run_metrics", f"""
WITH c AS (SELECT ts::DATE AS run, {CHANGE} AS change, value FROM events)
SELECT run, count(*) AS n_received, count(*) FILTER (WHERE change = 'new') AS n_new, count(*) FILTER (WHERE change = 'changed') AS n_changed,
  count(*) FILTER (WHERE change = 'unchanged') AS n_unchanged, count(*) FILTER (WHERE change = 'invalid') AS n_invalid,
  count(*) FILTER (WHERE change IN ('new', 'changed') AND value <= 480) AS n_loaded, count(*) FILTER (WHERE change IN ('new', 'changed') AND value > 480) AS n_failed,
  CASE WHEN count(*) FILTER (WHERE change IN ('new', 'changed') AND value > 480) > 0 THEN 'partial' ELSE 'succeeded' END AS status
FROM c GROUP BY run""")
def run_metrics(spark, d):
    c = table(spark, d, "events").select(F.to_date("ts").alias("run"), F.expr(CHANGE).alias("change"), "value")
    done = c.filter("change IN ('new', 'changed')").select("run", F.when(F.col("value") > 480, "failed").otherwise("loaded").alias("outcome"))
    return inc.run_metrics(c, done, ["run"])
