"""Snapshots in dated folders: only the folders an as-of question needs are read whole."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from seasonframe.common import work_dir
from seasonframe.operators import joins as jn
from seasonframe.sources import tables as st


def day(n):
    return dt.date(2024, 3, n)


@pytest.fixture(scope="module")
def stored(spark):
    rows = [(page, day(d), i, f"{page}{d}{i}") for page, days in (("a", range(1, 11)), ("b", range(1, 6)), (None, [2]))
            for d in days for i in range(3)]
    path = f"{work_dir(spark)}/ranks"
    df = spark.createDataFrame(rows, "page string, day date, rank int, who string")
    st.write_snapshot(df.repartition(1), path, "day", by=["page"])
    return spark.read.parquet(path), rows, path


def scans(df):
    """(columns read, rows read, text) of every file scan that ran; a scan leaves out rows by folder only."""
    df.collect()
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif kind == "FileSourceScanExec":
            found.append((list(node.requiredSchema().fieldNames()), node.metrics().get("numOutputRows").get().value(), node.toString()))
        else:
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]
    return found


def test_only_the_days_found_are_read(stored):
    df, rows, _ = stored
    got = jn.asof_snapshot(df, ["page"], "day", F.lit(day(8)), dated=True)
    plain = jn.asof_snapshot(df, ["page"], "day", F.lit(day(8)))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
    want = {(r[3]) for r in rows if (r[0], r[1]) in (("a", day(8)), ("b", day(5)))}
    assert {r["who"] for r in got.collect()} == want
    whole = [s for s in scans(got) if "who" in s[0]]
    # Pages a and b of the days 5 and 8: three folders of sixteen, of three rows each, hold them (b has no day 8).
    assert [s[1] for s in whole] == [9] and "ubquery" in whole[0][2].split("PartitionFilters")[1]
    assert all(s[0] == [] for s in scans(got) if "who" not in s[0])


def test_latest_by_group_and_limits_of_the_calendar(stored):
    df, _, _ = stored
    got = st.latest_snapshot(df, "day", ["page"], dated=True)
    assert {(r["page"], r["day"]) for r in got.collect()} == {("a", day(10)), ("b", day(5))}
    assert [s[1] for s in scans(got) if "who" in s[0]] == [9]
    none = jn.asof_snapshot(df, ["page"], "day", F.lit(day(1)), strict=True, dated=True)
    assert none.count() == 0
    year = jn.asof_snapshot(df, ["page"], "day", F.lit(dt.date(2025, 1, 1)), same_year=True, dated=True)
    assert year.count() == 0


def test_a_rerun_replaces_the_days_of_its_groups(stored, spark):
    _, rows, _ = stored
    path = f"{work_dir(spark)}/again"
    df = spark.createDataFrame(rows, "page string, day date, rank int, who string").where("page IS NOT NULL")
    st.write_snapshot(df, path, "day", by=["page"])
    st.write_snapshot(df.where("page = 'a' AND day = DATE '2024-03-02'").withColumn("who", F.lit("new")), path, "day", by=["page"])
    now = spark.read.parquet(path)
    assert now.count() == df.count() and now.where("who = 'new'").count() == 3
    with pytest.raises(FileExistsError):
        st.write_snapshot(df.where("day = DATE '2024-03-02'"), path, "day", historical=True, by=["page"])
    st.write_snapshot(df.where("page = 'b' AND day = DATE '2024-03-02'").withColumn("page", F.lit("c")), path, "day", historical=True, by=["page"])
    assert spark.read.parquet(path).where("page = 'c'").count() == 3
