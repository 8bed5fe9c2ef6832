"""Left joins with many null and heavy keys: the same rows, no task with a large share."""

import pytest
from pyspark.sql import functions as F

from seasonframe.common import left_join_spread
from seasonframe.operators import joins as jn


@pytest.fixture
def plain(spark):
    """No broadcast and no adaptive splitting, so that every row goes where the join's keys send it."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def largest(df):
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(sizes) / sum(sizes)


@pytest.mark.parametrize("heavy", [False, True])
def test_null_keys_spread(plain, heavy):
    left = plain.range(8000).select("id", F.when(F.col("id") % 10 == 0, F.concat(F.lit("k"), (F.col("id") % 70).cast("string"))).alias("k"))
    right = plain.createDataFrame([(f"k{i}", i) for i in range(0, 70, 20)] + [(None, -1)], "k string, v int")
    got = left_join_spread(left, right, "k", heavy)
    want = left.join(right.where("k is not null"), "k", "left").select(got.columns)
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    assert largest(got) < 0.3 and largest(want) >= 0.9


def test_heavy_keys_spread(plain):
    left = plain.range(8000).select("id", F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"))
    right = plain.createDataFrame([("hot", 1), ("3", 2), ("none", 3)], "k string, v int")
    got = left_join_spread(left, right, "k", heavy=True)
    want = left.join(right, "k", "left").select(got.columns)
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    assert largest(got) < 0.3 and largest(want) > 0.6


def test_attach_id_splits_alike(plain):
    df = plain.createDataFrame([(i, "a" if i % 3 == 0 else None, "x" if i % 2 else None) for i in range(60)], "n int, a string, b string")
    ids = plain.createDataFrame([("a", "x", "p2"), ("a", None, "p1"), (None, "x", "p3")], "a string, b string, player_id string")
    for heavy in (False, True):
        m = jn.attach_id(df, ids, "a", "player_id", heavy)
        assert (m.matched.count(), m.unmatched.count()) == (20, 40) and {r.player_id for r in m.matched.collect()} == {"p1"}
        f = jn.attach_id_fallback(df, ids, "a", "b", "player_id", heavy)
        assert {r.n: r.player_id for r in f.matched.collect()} == {
            i: "p1" if i % 3 == 0 else "p2" for i in range(60) if i % 3 == 0 or i % 2}
