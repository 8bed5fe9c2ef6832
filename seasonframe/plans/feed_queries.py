"""Queries of change detection and the document store: documents as feed, labelled ones as stored."""

from pyspark.sql import functions as F

from ..common import work_dir
from ..operators import incremental as inc
from ..streaming import feeds
from ..streaming.stateful import claims, keyed_state, state_changes_stream
from .inputs import FEED, STORED, feed_docs, stored_docs, table
from .registry import query

# A feed id is language and length, so it repeats inside a page; short items have none. A page is a source.
CLASSIFIED = FEED + ", " + STORED + """,
f AS (SELECT source AS page, doc_id AS arrival, CASE WHEN n_chars >= 60 THEN lang || '-' || n_chars END AS id, hash, n_chars FROM feed),
s AS (SELECT lang || '-' || length(text) AS id, min(hash) AS hash FROM stored GROUP BY 1),
c AS (SELECT f.*, CASE WHEN f.id IS NULL OR arrival <> min(arrival) OVER (PARTITION BY page, f.id) THEN 'invalid'
   WHEN s.hash IS NULL THEN 'new' WHEN s.hash <> f.hash THEN 'changed' ELSE 'unchanged' END AS change FROM f LEFT JOIN s ON s.id = f.id)"""


def classified(spark, d):
    fid = lambda n: F.concat_ws("-", F.col("lang"), n.cast("string"))
    feed = feed_docs(spark, d).select(
        F.col("source").alias("page"), F.col("doc_id").alias("arrival"),
        F.when(F.col("n_chars") >= 60, fid(F.col("n_chars"))).alias("id"), "hash", "n_chars")
    stored = stored_docs(spark, d).groupBy(fid(F.length("text")).alias("id")).agg(F.min("hash").alias("hash"))
    return inc.classify_feed(feed, stored, "id", "arrival", "hash", ["page"])


@query("T1_classify_feed", f"WITH {CLASSIFIED} SELECT page, arrival, id, change FROM c")
def classify(spark, d):
    return classified(spark, d).select("page", "arrival", "id", "change")


@query("T2_date_bounds", """
WITH f AS (SELECT event_id, ts::DATE AS day, event_type = 'error' OR NOT ts::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-12' AS out FROM events)
SELECT event_id, (SELECT count(*) FROM f) AS n_received, (SELECT count(*) FROM f WHERE out) AS n_excluded FROM f WHERE NOT out""")
def bounds(spark, d):
    feed = table(spark, d, "events").select("event_id", F.when(
        F.col("event_type") == "error", "soon").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("created"))
    b = inc.date_bounds(feed, "created", "2024-01-05", "2024-01-12")
    return b.eligible.select("event_id").withColumns({c: b.counts.select(c).scalar() for c in ("n_received", "n_excluded")})


@query("T3_coverage_gap", f"""
WITH {CLASSIFIED} SELECT page, count(*) AS n_received, count(*) FILTER (WHERE change = 'new') AS n_new, count(*) FILTER (WHERE change = 'changed') AS n_changed,
  count(*) FILTER (WHERE change = 'unchanged') AS n_unchanged, count(*) FILTER (WHERE change = 'invalid') AS n_invalid,
  min(n_chars) FILTER (WHERE change <> 'invalid') AS oldest, max(n_chars) FILTER (WHERE change <> 'invalid') AS newest,
  bool_or(change <> 'invalid') AND NOT bool_or(change IN ('changed', 'unchanged')) AS possible_gap,
  count(*) >= 55 OR (bool_or(change <> 'invalid') AND NOT bool_or(change IN ('changed', 'unchanged'))) AS saturated FROM c GROUP BY page""")
def gap(spark, d):
    return inc.coverage_gap(classified(spark, d), "n_chars", 55, ["page"])


@query("T4_seen_bounds", """
WITH u AS (SELECT user_id, ts FROM events) SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen FROM u GROUP BY user_id""")
def seen(spark, d):
    e = table(spark, d, "events")
    ts = F.col("ts").cast("timestamp")
    part = lambda ok: e.filter(ok).groupBy("user_id").agg(F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"))
    old = F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")
    return inc.seen_bounds(part(old), part(~old), "user_id")


def applied(spark, d):
    """The store of labelled documents after a batch of every document that is not toxic."""
    stored = stored_docs(spark, d)
    day = lambda s: F.lit(s).cast("date")
    toxic = table(spark, d, "labels").filter("toxic = 1").select("doc_id")
    batch = feed_docs(spark, d).join(toxic, "doc_id", "left_anti")

    def store(df, first, last, vector):
        return inc.ReportStore(
            df.select(F.col("doc_id").alias("report_id"), F.col("hash").alias("content_hash"), first.alias("first_seen"), last.alias("last_seen")),
            df.select(F.col("doc_id").alias("report_id"), F.col("hash").alias("source_hash"), F.col("hash").alias("content_hash")),
            df.select(F.col("doc_id").alias("report_id"), F.col("lang").alias("player_id"), first.alias("linked")),
            df.select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chunk_id"), F.col("doc_id").alias("report_id"),
                      F.col("hash").alias("content_hash"), vector.alias("embedding"), F.when(vector.isNotNull(), "m1").alias("embedding_model")))

    old = store(stored, day("2024-01-10"), day("2024-01-11"), F.length("text").cast("double"))
    new = store(batch, day("2024-01-05"), day("2024-01-20"), F.lit(None).cast("double"))
    return inc.apply_documents(old, new)


APPLIED = FEED + ", " + STORED + ", batch AS (SELECT * FROM feed WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))"


@query("T5_apply_documents_reports", f"""
WITH {APPLIED} SELECT coalesce(b.doc_id, s.doc_id) AS report_id, coalesce(b.hash, s.hash) AS content_hash,
  CASE WHEN b.doc_id IS NULL THEN DATE '2024-01-10' ELSE DATE '2024-01-05' END AS first_seen,
  CASE WHEN b.doc_id IS NULL THEN DATE '2024-01-11' ELSE DATE '2024-01-20' END AS last_seen FROM batch b FULL JOIN stored s ON b.doc_id = s.doc_id""")
def apply_reports(spark, d):
    return applied(spark, d).reports


@query("T5_apply_documents_versions", f"""
WITH {APPLIED} SELECT doc_id AS report_id, hash AS source_hash, hash AS content_hash FROM stored UNION SELECT doc_id, hash, hash FROM batch""")
def apply_versions(spark, d):
    return applied(spark, d).versions


@query("T5_apply_documents_links", f"""
WITH {APPLIED} SELECT doc_id AS report_id, lang AS player_id, DATE '2024-01-05' AS linked FROM batch
UNION ALL SELECT doc_id, lang, DATE '2024-01-10' FROM stored WHERE doc_id NOT IN (SELECT doc_id FROM batch)""")
def apply_links(spark, d):
    return applied(spark, d).links


@query("T5_apply_documents_chunks", f"""
WITH {APPLIED} SELECT 'c' || b.doc_id AS chunk_id, b.doc_id AS report_id, b.hash AS content_hash,
  length(s.text)::DOUBLE AS embedding, CASE WHEN s.doc_id IS NOT NULL THEN 'm1' END AS embedding_model
FROM batch b LEFT JOIN stored s ON s.doc_id = b.doc_id AND s.hash = b.hash
UNION ALL SELECT 'c' || doc_id, doc_id, hash, length(text)::DOUBLE, 'm1' FROM stored WHERE doc_id NOT IN (SELECT doc_id FROM batch)""")
def apply_chunks(spark, d):
    return applied(spark, d).chunks


@query("T6_dedup_within_ttl", "SELECT event_id, user_id FROM events")
def dedup_stream(spark, d):
    """Events delivered twice; each id is claimed once."""
    path = work_dir(spark)
    events = table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    events.write.parquet(f"{path}/in")
    events.write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{path}/in")
    claimed = feeds.dedup_within_ttl(stream, "event_id", "ts")
    run = (claimed.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint")
           .trigger(availableNow=True).start(f"{path}/out"))
    run.awaitTermination()
    return spark.read.parquet(f"{path}/out").select("event_id", "user_id")


def streamed(spark, path, parts, make, out):
    """Feed frames as files, one run of the stream after each: every run goes on from the checkpoint of the one before."""
    for part in parts:
        part.write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(part.schema).parquet(f"{path}/in")
        with keyed_state(spark):
            run = (make(stream).writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint")
                   .trigger(availableNow=True).start(f"{path}/{out}"))
        run.awaitTermination()
    return spark.read.parquet(f"{path}/{out}")


@query("T6_claims_with_ttl", """
WITH RECURSIVE e AS (SELECT user_id, ts, min(event_id) AS event_id FROM events GROUP BY user_id, ts),
c AS (
  SELECT user_id, min(ts) AS ts FROM e GROUP BY user_id
  UNION ALL SELECT c.user_id, (SELECT min(e.ts) FROM e WHERE e.user_id = c.user_id AND e.ts >= c.ts + INTERVAL 36 HOUR) AS ts FROM c WHERE c.ts IS NOT NULL)
SELECT e.user_id, e.event_id FROM c JOIN e ON c.user_id = e.user_id AND c.ts = e.ts""")
def claims_with_ttl(spark, d):
    """Users claimed by their events for 36 hours each; the claims of the first run hold in the second."""
    events = table(spark, d, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    late = F.col("ts") >= F.lit("2024-01-15").cast("timestamp")
    found = streamed(spark, work_dir(spark), [events.where(~late), events.where(late)],
                     lambda s: claims(s, ["user_id"], "ts", "36 hours", "40 days", ["event_id"]), "claims")
    return found.select("user_id", "event_id")


@query("T7_state_changes_stream", """
WITH p AS (SELECT user_id, ts, event_type, value > 100 AS high, lag(event_type) OVER w AS pe, lag(value > 100) OVER w AS ph
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_type, value > 100))
SELECT user_id, ts, event_type, high, pe AS previous_event_type, ph AS previous_high FROM p WHERE pe IS NOT NULL AND (pe <> event_type OR ph <> high)""")
def changes_stream(spark, d):
    """The same changes from a stream that gets even events first, odd ones late, and a last time that settles all."""
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", (F.col("value") > 100).alias("high"), "event_id")
    last = spark.range(1).select(F.lit(-1).cast(e.schema["user_id"].dataType).alias("user_id"), F.lit("2100-01-01").cast("timestamp").alias("ts"),
                                 F.lit("end").alias("event_type"), F.lit(False).alias("high"))
    parts = [*[e.where(F.col("event_id") % 2 == odd).drop("event_id") for odd in (0, 1)], last]
    return streamed(spark, work_dir(spark), parts,
                    lambda s: state_changes_stream(s, ["user_id"], "ts", ["event_type", "high"], "60 days"), "changes").withColumn(
        "ts", F.col("ts").cast("timestamp_ntz"))


@query("T7_state_changes", """
WITH p AS (SELECT user_id, ts, event_id, event_type, value > 100 AS high, lag(event_type) OVER w AS pe, lag(value > 100) OVER w AS ph
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))
SELECT user_id, event_id, event_type, high, pe AS previous_event_type, ph AS previous_high FROM p WHERE pe IS NOT NULL AND (pe <> event_type OR ph <> high)""")
def changes(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", (F.col("value") > 100).alias("high"))
    return inc.state_changes(e, ["user_id"], "ts", ["event_type", "high"]).drop("ts")


@query("T11_needs_processing", f"""
WITH {FEED}, {STORED} SELECT f.doc_id, CASE WHEN s.doc_id IS NULL THEN 'insert' WHEN f.hash = s.hash AND s.toxic = 0 AND f.lang <> 'de' THEN 'unchanged' ELSE 'update' END AS action
FROM feed f LEFT JOIN stored s USING (doc_id)""")
def processing(spark, d):
    raw = feed_docs(spark, d).select("doc_id", "hash", "lang", F.lit("m1").alias("model"), F.lit("p2").alias("prompt"), F.lit("n3").alias("normalizer"))
    done = stored_docs(spark, d).select("doc_id", "hash", F.when(F.col("toxic") == 0, "m1").otherwise("m0").alias("model"),
                                        F.lit("p2").alias("prompt"), F.lit("n3").alias("normalizer"))
    return inc.needs_processing(raw, done, "doc_id", ["hash", "model", "prompt", "normalizer"], force=F.col("lang") == "de").select("doc_id", "action")
