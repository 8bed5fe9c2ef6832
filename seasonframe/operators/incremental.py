"""Change detection, version and ledger operators; each is also usable inside `foreachBatch`."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import any_of
from ..sources.tables import append_versions, upsert


def classify_feed(feed: DataFrame, stored: DataFrame, id_col: str, arrival: str, hash_col: str,
                  page: list[str] | None = None) -> DataFrame:
    """Feed rows with a class: invalid (no id or repeat id in its page), new, changed, unchanged.

    stored: id, hash. The first arrival of an id is found by a map-side aggregate, not by sorting a
    hot id.
    """
    keys = [*(page or []), id_col]
    first = feed.filter(F.col(id_col).isNotNull()).groupBy(*keys).agg(F.min(arrival).alias("_first"))
    known = stored.select(id_col, F.col(hash_col).alias("_stored"))
    joined = feed.join(first, keys, "left").join(known, id_col, "left")
    kind = (
        F.when(F.col(id_col).isNull() | (F.col(arrival) != F.col("_first")), "invalid")
        .when(F.col("_stored").isNull(), "new")
        .when(F.col("_stored") != F.col(hash_col), "changed")
        .otherwise("unchanged")
    )
    return joined.withColumn("change", kind).select(*feed.columns, "change")


class Bounded(NamedTuple):
    eligible: DataFrame
    counts: DataFrame


def date_bounds(feed: DataFrame, created: str, start=None, end=None) -> Bounded:
    """Rows whose publish date is in the closed range; a date that does not parse is out then."""
    published = F.to_date(F.try_to_timestamp(F.col(created), F.lit("yyyy-MM-dd HH:mm:ss")))
    inside = F.lit(True)
    if start is not None:
        inside = inside & (published >= F.lit(start))
    if end is not None:
        inside = inside & (published <= F.lit(end))
    inside = F.coalesce(inside, F.lit(False))
    counts = feed.agg(F.count(F.lit(1)).alias("n_received"), F.count_if(~inside).alias("n_excluded"))
    return Bounded(feed.filter(inside), counts)


def coverage_gap(classified: DataFrame, published: str, requested: int, by: list[str] | None = None) -> DataFrame:
    """Counts per class, publish range, whether a gap is possible and whether the window is full."""
    valid = F.col("change") != "invalid"
    stored = F.col("change").isin("changed", "unchanged")
    out = classified.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n_received"),
        *[F.count_if(F.col("change") == c).alias(f"n_{c}") for c in ("new", "changed", "unchanged", "invalid")],
        F.min(F.when(valid, F.col(published))).alias("oldest"),
        F.max(F.when(valid, F.col(published))).alias("newest"),
        (F.coalesce(F.bool_or(valid), F.lit(False)) & ~F.coalesce(F.bool_or(stored), F.lit(False))).alias("possible_gap"))
    return out.withColumn("saturated", (F.col("n_received") >= requested) | F.col("possible_gap"))


def seen_bounds(current: DataFrame, incoming: DataFrame, id_col: str) -> DataFrame:
    """First and last time each id was seen."""
    return current.select(id_col, "first_seen", "last_seen").unionByName(
        incoming.select(id_col, "first_seen", "last_seen")).groupBy(id_col).agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


class ReportStore(NamedTuple):
    reports: DataFrame
    versions: DataFrame
    links: DataFrame
    chunks: DataFrame


def apply_documents(store: ReportStore, batch: ReportStore) -> ReportStore:
    """The store after a batch of documents.

    A report is upserted with its seen bounds widened; an unseen (id, source hash, content hash) is
    appended; links of the batch's reports are replaced as a set; chunks of the batch's reports are
    replaced, keeping a stored vector when the text did not change and the batch brings none.

    reports: report_id, content_hash, first_seen, last_seen, ... versions: report_id, source_hash,
    content_hash, ... links: report_id, player_id, ... chunks: chunk_id, report_id, content_hash,
    embedding, embedding_model.
    """
    touched = batch.reports.select("report_id")
    bounds = seen_bounds(store.reports.join(touched, "report_id", "left_semi"), batch.reports, "report_id")
    incoming = batch.reports.drop("first_seen", "last_seen").join(bounds, "report_id")
    reports = upsert(store.reports, incoming.select(store.reports.columns), ["report_id"])
    versioned = batch.versions.withColumn("_key", F.concat_ws(":", "source_hash", "content_hash"))
    stored_versions = store.versions.withColumn("_key", F.concat_ws(":", "source_hash", "content_hash"))
    new_versions = append_versions(stored_versions, versioned, "report_id", "_key").drop("_key")
    versions = store.versions.unionByName(new_versions)
    links = store.links.join(touched, "report_id", "left_anti").unionByName(batch.links)
    # A changed report drops its old chunks, so only same-content reports can lend a vector.
    unchanged = store.reports.select("report_id", "content_hash").join(
        batch.reports.select("report_id", "content_hash"), ["report_id", "content_hash"], "left_semi")
    lenders = store.chunks.join(unchanged.select("report_id"), "report_id", "left_semi").select(
        "chunk_id", F.col("embedding").alias("_e"), F.col("embedding_model").alias("_m"))
    fresh = batch.chunks.join(lenders, "chunk_id", "left")
    keep_old = F.col("embedding").isNull() & F.col("_e").isNotNull()
    fresh = fresh.withColumn("embedding_model", F.when(keep_old, F.col("_m")).otherwise(F.col("embedding_model")))
    fresh = fresh.withColumn("embedding", F.coalesce("embedding", "_e")).drop("_e", "_m")
    chunks = store.chunks.join(touched, "report_id", "left_anti").unionByName(fresh)
    return ReportStore(reports, versions, links, chunks)


def state_changes(snapshots: DataFrame, entity: list[str], at: str, fields: list[str],
                  bucket: str = "day", tie: list[str] | None = None) -> DataFrame:
    """Rows whose fields differ from the entity's previous snapshot.

    Snapshots of one time are ordered by the `tie` columns and then by the fields themselves, so
    the result does not depend on how rows arrive.

    The look-back is split by time bucket: inside a bucket by `lag`, and for the first row of a
    bucket from the last row of the entity's previous bucket. A hot entity spreads over buckets.
    """
    state = F.struct(*fields)
    rows = snapshots.withColumn("_b", F.date_trunc(bucket, F.col(at).cast("timestamp"))).withColumn("_s", state)
    order = [F.col(c) for c in (at, *(tie or []), "_s")]
    inside = Window.partitionBy(*entity, "_b").orderBy(*order)
    rows = rows.withColumn("_prev", F.lag("_s").over(inside)).withColumn("_first", F.row_number().over(inside) == 1)
    last = rows.groupBy(*entity, "_b").agg(F.max_by("_s", F.struct(*order)).alias("_last"))
    across = Window.partitionBy(*entity).orderBy("_b")
    before = last.select(*entity, "_b", F.lag("_last").over(across).alias("_before"))
    joined = rows.join(before, [*entity, "_b"])
    previous = F.when(F.col("_first"), F.col("_before")).otherwise(F.col("_prev"))
    joined = joined.withColumn("_p", previous).filter(F.col("_p").isNotNull())
    changed = any_of([~F.col(f"_p.{f}").eqNullSafe(F.col(f)) for f in fields])
    return joined.filter(changed).select(
        *snapshots.columns, *[F.col(f"_p.{f}").alias(f"previous_{f}") for f in fields])


def claim_once(ledger: DataFrame, keys: DataFrame, key_cols: list[str]) -> DataFrame:
    """Keys to append to the ledger: each absent key once; a retry yields nothing."""
    return keys.dropDuplicates(key_cols).join(ledger.select(*key_cols), key_cols, "left_anti")


def pending(ledger: DataFrame, status: str, message: str, created: str, id_col: str, limit: int) -> DataFrame:
    """Oldest pending or failed entries that have a message to send."""
    waiting = F.col(status).isin("pending", "failed") & F.col(message).isNotNull()
    return ledger.filter(waiting).orderBy(F.col(created).asc(), F.col(id_col).asc()).limit(limit)


def run_metrics(classified: DataFrame, processed: DataFrame, by: list[str]) -> DataFrame:
    """One ledger row per run: feed counts, processing outcome, status partial when something failed.

    processed: by, outcome (loaded or failed).
    """
    feed = classified.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_received"),
        *[F.count_if(F.col("change") == c).alias(f"n_{c}") for c in ("new", "changed", "unchanged", "invalid")])
    load = processed.groupBy(*by).agg(
        F.count_if(F.col("outcome") == "loaded").alias("n_loaded"),
        F.count_if(F.col("outcome") == "failed").alias("n_failed"))
    joined = feed.join(load, by, "left").fillna(0, ["n_loaded", "n_failed"])
    return joined.withColumn("status", F.when(F.col("n_failed") > 0, "partial").otherwise("succeeded"))


def needs_processing(raw: DataFrame, done: DataFrame, id_col: str, match: list[str],
                     force: Column | None = None) -> DataFrame:
    """Raw rows with an action: insert, update, or unchanged when every match column agrees.

    match: source hash, model, prompt version, normaliser version. `force` overrides unchanged.
    """
    old = done.select(id_col, *[F.col(c).alias(f"_{c}") for c in match], F.lit(True).alias("_done"))
    joined = raw.join(old, id_col, "left")
    same = F.lit(True)
    for c in match:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    skip = same & ~(force if force is not None else F.lit(False))
    action = F.when(F.col("_done").isNull(), "insert").when(skip, "unchanged").otherwise("update")
    return joined.withColumn("action", action).select(*raw.columns, "action")
