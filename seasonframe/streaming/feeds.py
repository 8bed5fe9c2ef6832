"""Structured Streaming forms: feed classification, document store updates, id claims, state changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import incremental as inc
from ..sources.bucket_store import BUCKETS, KEEP, BucketStore


def dedup_within_ttl(stream: DataFrame, id_col: str, ts: str, ttl: str = "15 minutes") -> DataFrame:
    """First claim of an id wins; the id is free again once the watermark passes its time to live.

    State holds one row per id and is dropped with the watermark.
    """
    return stream.withWatermark(ts, ttl).dropDuplicatesWithinWatermark([id_col])


def _table(path: str, batch_id: int) -> str:
    return f"{path}/v={batch_id:012d}"


def _versions(spark: SparkSession, path: str) -> dict[int, object]:
    """The finished versions of a table, from its folder names; no data is read."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return {}
    found = [s.getPath() for s in files.listStatus(folder) if s.getPath().getName().startswith("v=")]
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return {int(p.getName()[2:]): p for p in found if files.exists(done(p, "_SUCCESS"))}


def _read_before(spark: SparkSession, path: str, batch_id: int | None = None) -> DataFrame | None:
    """Newest table version below the batch, so a retried batch finds its own input again.

    While batch n runs, batch n - 1 is done for good and only n can be retried; versions below n - 1 are
    dropped, so storage holds two versions however many batches come.
    """
    versions = _versions(spark, path)
    usable = [v for v in versions if batch_id is None or v < batch_id]
    if not usable:
        return None
    newest = max(usable)
    if batch_id is not None:
        for v in usable:
            if v < newest:
                versions[v].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(versions[v], True)
    return spark.read.parquet(_table(path, newest))


def classify_stream(stream: DataFrame, state_path: str, out_path: str, checkpoint: str, id_col: str,
                    arrival: str, hash_col: str) -> StreamingQuery:
    """Classify each micro-batch against the hashes seen so far.

    Every batch writes a new version of the hash table and its own output folder, so a retried
    batch overwrites exactly what it wrote before.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stored = _read_before(spark, state_path, batch_id)
        stored = batch.select(id_col, hash_col).limit(0) if stored is None else stored
        classified = inc.classify_feed(batch, stored, id_col, arrival, hash_col)
        classified.write.mode("overwrite").parquet(_table(out_path, batch_id))
        written = spark.read.parquet(_table(out_path, batch_id)).filter(F.col("change").isin("new", "changed"))
        after = inc.upsert(stored, written.select(id_col, hash_col), [id_col])
        after.write.mode("overwrite").parquet(_table(state_path, batch_id))

    return (stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def document_store(spark: SparkSession, path: str, empty: inc.ReportStore, buckets: int = BUCKETS) -> BucketStore:
    """The store's tables in buckets of the report, so that a report's rows of all tables lie in one bucket number."""
    return BucketStore(spark, path, {n: getattr(empty, n).schema for n in inc.ReportStore._fields}, ["report_id"], buckets)


def apply_stream(stream: DataFrame, store_path: str, checkpoint: str, to_batch, empty: inc.ReportStore,
                 buckets: int = BUCKETS, keep: int = KEEP) -> StreamingQuery:
    """Apply document batches to a store. `to_batch` turns a micro-batch into a ReportStore.

    A batch reads and rewrites the buckets of its reports in all four tables and commits them with one manifest;
    the last `keep` states of the store stay readable. Links and chunks of a batch belong to its reports."""
    def run(batch: DataFrame, batch_id: int) -> None:
        store = document_store(batch.sparkSession, store_path, empty, buckets)
        incoming = to_batch(batch)
        store.commit(batch_id, incoming.reports, lambda old: inc.apply_documents(inc.ReportStore(**old), incoming)._asdict())
        store.vacuum(keep)

    return (stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def latest_store(spark: SparkSession, store_path: str, empty: inc.ReportStore, buckets: int = BUCKETS) -> inc.ReportStore:
    """Every table of the store as its newest manifest has it."""
    store = document_store(spark, store_path, empty, buckets)
    entries = store.newest()
    return inc.ReportStore(**{name: store.read(name, entries) for name in inc.ReportStore._fields})


def state_change_stream(stream: DataFrame, state_path: str, out_path: str, checkpoint: str,
                        entity: list[str], at: str, fields: list[str], bucket: str = "day") -> StreamingQuery:
    """Emit state changes per micro-batch, comparing with the last state of earlier batches."""
    columns = [*entity, at, *fields]

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        previous = _read_before(spark, state_path, batch_id)
        history = batch.select(*columns, F.lit(False).alias("_stored"))
        if previous is not None:
            history = history.unionByName(previous.withColumn("_stored", F.lit(True)))
        # A stored row was reported when it came; a late older row before it does not make it news again.
        changes = inc.state_changes(history, entity, at, fields, bucket).filter("not _stored").drop("_stored")
        changes.write.mode("overwrite").parquet(_table(out_path, batch_id))
        state = F.struct(at, *fields)
        last = history.groupBy(*entity).agg(F.max(state).alias("_r")).select(*entity, "_r.*")
        last.write.mode("overwrite").parquet(_table(state_path, batch_id))

    return (stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


