"""Keyed streaming state: claims around their time to live, late rows, restarts, and the batch form's result."""

import random
from datetime import datetime, timedelta

from seasonframe.operators.incremental import state_changes
from seasonframe.streaming.stateful import PROVIDER, claims, keyed_state, state_changes_stream

START = datetime(2024, 1, 1)


def minute(m):
    return START + timedelta(minutes=m)


def run(spark, tmp_path, schema, batches, make, restart):
    """Feed batches as files; with `restart` the stream stops after each and goes on from its checkpoint."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i, data in enumerate(batches):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(source)
        if not restart and i < len(batches) - 1:
            continue
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        with keyed_state(spark):
            (make(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
             .trigger(availableNow=True).start(out).awaitTermination())
    return spark.read.parquet(out)


def test_claims_on_both_sides_of_their_time_to_live(spark, tmp_path):
    before = spark.conf.get(PROVIDER, None)
    batches = [
        [("a", minute(0), 1), ("a", minute(5), 2), ("b", minute(1), 3), ("a", minute(14), 4), ("c", None, 5)],
        # a: 14:59 after its claim is a repeat although the last mention was later; 15:00 is free. b comes late.
        [("a", minute(15) - timedelta(seconds=1), 6), ("a", minute(15), 7), ("b", minute(3), 8), ("b", minute(16), 9)],
        [("a", minute(29), 10), ("a", minute(30), 11), ("d", minute(100), 12)],
        [("a", minute(101), 13), ("e", minute(2), 14)]]
    got = run(spark, tmp_path, "id string, ts timestamp, n int", batches, lambda s: claims(s, ["id"], "ts"), restart=True)
    # e is more than 15 minutes late when it comes.
    assert sorted(r.n for r in got.collect()) == [1, 3, 7, 9, 11, 12, 13]
    assert spark.conf.get(PROVIDER, None) == before


def test_state_changes_equal_the_batch_form(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice("abcd"), minute(rng.randrange(600)), rng.choice(["Q", "O", None]), rng.random() < 0.5) for _ in range(150)]
    # Up to an hour out of order, over three batches and two restarts; the last batch settles everything.
    rows.sort(key=lambda r: r[1] + timedelta(minutes=rng.randrange(50)))
    rows += [(None, minute(3), "Q", True), ("a", None, "Q", True)]
    batches = [rows[:50], rows[50:100], rows[100:], [("end", minute(5000), "Q", True)]]
    schema = "e string, t timestamp, s string, out boolean"
    got = run(spark, tmp_path, schema, batches, lambda s: state_changes_stream(s, ["e"], "t", ["s", "out"]), restart=True)
    usable = spark.createDataFrame(rows, schema).where("e is not null and t is not null")
    want = state_changes(usable, ["e"], "t", ["s", "out"]).select(got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 50
