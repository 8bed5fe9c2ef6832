"""Source targets, copies and positions."""

import pytest
from pyspark.sql import functions as F

from seasonframe.llm.mixing import SCHEDULES, curriculum, mix, position_of

SCHEMA = "doc_id long, source string, text string"


def level(sizes, weights=(5, 2, 1), most=3):
    """Targets by resharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, full = sum(sizes.values()), dict.fromkeys(names, 0.0), set()
    while True:
        free = [s for s in names if s not in full]
        rest = total - sum(most * sizes[s] for s in full)
        target = {s: most * sizes[s] if s in full else rest * weight[s] / sum(weight[x] for x in free) for s in names}
        over = {s for s in free if target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("shape", [{"a": 900, "b": 30, "c": 5, None: 40}, {"x": 10}, {"p": 3, "q": 500, "r": 500, "s": 1, "t": 80}])
def test_targets_and_words(spark, shape):
    rows, n = [], 0
    for source, size in shape.items():
        for k in range(size // 5 or 1):
            rows.append((n, source, "w " * (1 + (k * 7) % 13)))
            n += 1
    rows += [(None, "b", None), (n, "b", ""), (n, "b", "twin words"), (n, "b", "twin words")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("size", F.lit(-1)).repartition(5)
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    out = mix(df).collect()
    assert len(out) == len(rows)
    want = level(sizes)
    for s in sizes:
        mine = [r for r in out if r.source == s]
        assert {r.source_size for r in mine} == {sizes[s]}
        assert all(r.target == pytest.approx(want[s]) for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) <= max(r.size for r in mine) / 2 + 1e-6
    for r in out:
        assert r.taken == r.copies * r.size <= 3 * r.size and len(r.positions) == (r.copies if r.size else 0)
        assert all(0 <= p <= 1 for p in r.positions) and r.positions == sorted(r.positions)


def test_positions_invert_the_schedules(spark):
    shares = [i / 200 for i in range(201)]
    df = spark.createDataFrame([(s, k) for s in shares for k in range(len(SCHEDULES))], "s double, k int")
    for r in df.select("s", "k", position_of(F.col("s"), F.col("k")).alias("t")).collect():
        knots = SCHEDULES[r.k]
        area = whole = 0.0
        for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
            whole += (t1 - t0) * (w0 + w1) / 2
            x = min(max(r.t - t0, 0), t1 - t0)
            area += x * w0 + (w1 - w0) / (t1 - t0) * x * x / 2
        assert area / whole == pytest.approx(r.s, abs=1e-9)


def test_curriculum_is_sorted_and_empty_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = curriculum(mix(df)).collect()
    assert [r.position for r in rows] == sorted(r.position for r in rows)
    early = [r for r in rows if r.source == "src0"]
    assert sum(r.size for r in early if r.position < 0.5) > sum(r.size for r in early if r.position >= 0.5)
    assert mix(df.limit(0)).count() == 0


def test_reruns_agree(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert sorted(map(tuple, mix(df).drop("positions").collect()), key=str) == sorted(map(tuple, mix(df.repartition(7)).drop("positions").collect()), key=str)
