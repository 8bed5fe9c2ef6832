"""Tables in buckets: only touched buckets are written, manifests commit, retries and late rows, old readers."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from seasonframe.sources.bucket_store import BucketStore

SCHEMA = "k long, v string, at long"


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def store(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    return BucketStore(spark, str(tmp_path / "store"), {"t": schema}, ["k"], 16)


def files(store):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{store.path}/data/**/*.parquet", recursive=True)}


def frame(store, data):
    return store.spark.createDataFrame(data, SCHEMA)


def test_untouched_buckets_keep_their_files(store):
    assert store.read("t").count() == 0
    store.upsert("t", 0, frame(store, [(k, "a", 0) for k in range(200)]))
    before = files(store)
    touched = store.upsert("t", 1, frame(store, [(3, "b", 1), (1000, "new", 1)]))
    assert 1 <= len(touched) <= 2
    assert {f: t for f, t in files(store).items() if f in before} == before
    written = [f for f in files(store) if f not in before]
    assert {int(f.split("_bucket=")[1].split("/")[0]) for f in written} == touched
    assert rows(store.read("t")) == sorted([(k, "b" if k == 3 else "a", int(k == 3)) for k in range(200)] + [(1000, "new", 1)])
    # A reader opens one file for every bucket, and a lookup only those of its keys.
    assert all(v == (1 if b in touched else 0) for (_, b), v in store.newest().items())
    found = store.lookup("t", frame(store, [(3, None, None)]))
    assert rows(found) == [(3, "b", 1)]
    assert len({f.split("_bucket=")[1].split("/")[0] for f in found.inputFiles()}) == 1


def test_retries_and_late_rows(store):
    store.upsert("t", 0, frame(store, [(1, "a", 10), (2, "a", 10)]), [F.col("at")])
    store.upsert("t", 1, frame(store, [(1, "late", 5), (2, "b", 20), (2, "c", 30)]), [F.col("at")])
    want = [(1, "a", 10), (2, "c", 30)]
    assert rows(store.read("t")) == want
    # The same batch again, and with other rows, as a retry after a change of the source would bring them.
    store.upsert("t", 1, frame(store, [(1, "late", 5), (2, "b", 20), (2, "c", 30)]), [F.col("at")])
    assert rows(store.read("t")) == want
    store.upsert("t", 1, frame(store, [(1, "d", 40)]), [F.col("at")])
    assert rows(store.read("t")) == [(1, "d", 40), (2, "a", 10)]
    with pytest.raises(Exception, match="repeated key"):
        store.upsert("t", 2, frame(store, [(1, "x", 1), (1, "y", 1)]))
    # A batch that failed is not committed.
    assert store.batches() == [0, 1] and rows(store.read("t")) == [(1, "d", 40), (2, "a", 10)]


def test_deleted_rows_and_foreign_rows(store):
    store.upsert("t", 0, frame(store, [(k, "a", 0) for k in range(20)]))
    keys = frame(store, [(5, None, None)])
    number = keys.select(store.bucket()).first()[0]
    store.commit(1, keys, lambda old: {"t": old["t"].limit(0)})
    assert ("t", number) not in store.newest() and store.read("t").where("k = 5").count() == 0
    with pytest.raises(Exception, match="does not touch"):
        store.commit(2, keys, lambda old: {"t": frame(store, [(k, "z", 0) for k in range(20)])})


def test_vacuum_keeps_what_recent_manifests_name(store):
    for batch in range(5):
        store.upsert("t", batch, frame(store, [(k, f"b{batch}", batch) for k in range(0, 40, batch + 1)]), [F.col("at")])
    reader, want = store.read("t", store.manifest(3)), None
    want = rows(store.read("t"))
    assert store.vacuum(keep=2) > 0 and store.batches() == [3, 4]
    assert rows(store.read("t")) == want and reader.count() == 40
    assert store.vacuum(keep=2) == 0
