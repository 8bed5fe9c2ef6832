"""Order columns packed into one number, and the aggregates that use it."""

import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from seasonframe.common import first_by, last_by, packed_order
from seasonframe.operators import aggregates as agg
from seasonframe.operators import sets
from seasonframe.plans import load_all
from seasonframe.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_packed_order_sorts_as_the_struct(spark):
    rng = random.Random(5)
    edge = [None, 0, -1, 1, 2**63 - 1, -(2**63)]
    days = [None, dt.date(1969, 12, 31), dt.date(1970, 1, 1), dt.date(9999, 12, 31), dt.date(1, 1, 1)]
    rows = [(i, rng.choice(days), rng.choice(edge), rng.choice([None, True, False])) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, d date, n long, b boolean")
    order = [F.col("d"), F.col("n"), F.col("b")]
    at = packed_order(df, order)
    both = df.withColumns({"_s": F.struct(*order), "_p": at})
    ranks = both.select(*[F.dense_rank().over(Window.orderBy(c)).alias(n) for n, c in (("a", "_s"), ("b", "_p"))]).collect()
    assert all(r["a"] == r["b"] for r in ranks) and len({r["a"] for r in ranks}) > 40


def test_decimals_and_what_cannot_be_packed(spark):
    df = spark.sql("SELECT * FROM VALUES (CAST(-1.25 AS DECIMAL(18,2)), 5L), (CAST(NULL AS DECIMAL(18,2)), 9L), "
                   "(CAST(9999999999999999.99 AS DECIMAL(18,2)), -9223372036854775808L), (CAST(-9999999999999999.99 AS DECIMAL(18,2)), 3L), "
                   "(CAST(-1.25 AS DECIMAL(18,2)), 4L) AS t(m, n)")
    at = packed_order(df, [F.col("m"), F.col("n")])
    assert [r["n"] for r in df.orderBy(at).collect()] == [9, 3, 4, 5, -9223372036854775808]
    assert packed_order(df, [F.col("n"), F.col("n")]) is None
    assert packed_order(df, [F.col("n").cast("string")]) is None and packed_order(df, [F.col("m").cast("double")]) is None


def test_first_and_last_rows_keep_one_row_whole(spark):
    rows = [(k, a, b, None if (k + a) % 3 == 0 else k * a) for k in range(5) for a in (2, 1, 3) for b in (7, None)]
    rows.append((9, None, None, 1))
    df = spark.createDataFrame(rows, "k int, a int, b int, v int").repartition(4)
    for pick, best in ((first_by, min), (last_by, max)):
        got = {r["k"]: tuple(r) for r in pick(df, ["k"], [F.col("a"), F.col("b")]).collect()}
        for key in {r[0] for r in rows}:
            order = lambda r: tuple((x is not None, x or 0) for x in (r[1], r[2]))
            assert got[key] == best([r for r in rows if r[0] == key], key=order)
    assert first_by(df.limit(0), ["k"], [F.col("a")]).count() == 0
    texts = df.select("k", F.col("a").cast("string").alias("a"))
    assert {(r["k"], r["a"]) for r in last_by(texts.dropna(), ["k"], [F.col("a")]).collect()} == {(k, "3") for k in range(5)}


def test_season_totals_match_a_loop(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice([1, 2, None]), rng.randrange(6), rng.choice(["x", "y", None]), rng.choice(["s", "t"]),
             rng.choice([None, 1, 2, 5])) for _ in range(80)]
    rows = [(k, w, g, t, s, p, i) for i, (k, w, g, t, s, p) in enumerate(rows)]
    df = spark.createDataFrame(rows, "k string, week int, game int, team string, st string, p int, seq int").repartition(5)
    out = agg.season_totals(df, ["k"], ["week", "seq"], "game", ["p"], ["team", "st"], "team", weighted={"m": ("p", "seq")})
    got = {r["k"]: r for r in out.collect()}
    for key in "ab":
        mine = sorted([r for r in rows if r[0] == key], key=lambda r: (r[1] is not None, r[1] or 0, r[6]))
        r = got[key]
        assert r["games"] == len({x[2] for x in mine}) and r["p"] == sum(x[5] or 0 for x in mine)
        assert (r["last_team"], r["last_st"]) == (mine[-1][3], mine[-1][4])
        assert r["teams"] == list(dict.fromkeys(x[3] for x in mine))
        assert abs(r["m"] - sum((x[5] or 0) * x[6] for x in mine) / sum(x[6] for x in mine)) < 1e-12
    assert agg.season_totals(df.limit(0), ["k"], ["week", "seq"], "game", ["p"], ["team"], "team").count() == 0


def test_plans_hash_and_read_once(spark):
    load_all()
    totals = plan_of(QUERIES["A1_season_totals"](spark, SF)).split("Initial Plan")[0]
    assert "SortAggregate" not in totals
    scans = [line for line in totals.splitlines() if "FileScan" in line and "o_orderpriority" in line]
    assert len(scans) == 1
    assert "SortAggregate" not in plan_of(QUERIES["U2_unique_on"](spark, SF))


def test_unique_on_with_ties_takes_one_whole_row(spark):
    df = spark.createDataFrame([(1, 5, 10, 11), (1, 5, 20, 21), (2, 1, None, 3)], "k int, o int, a int, b int").repartition(3)
    got = sorted(tuple(r) for r in sets.unique_on(df, ["k"], [F.col("o")]).select("k", "a", "b").collect())
    assert got in ([(1, 10, 11), (2, None, 3)], [(1, 20, 21), (2, None, 3)])
