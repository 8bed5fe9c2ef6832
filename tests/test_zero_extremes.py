"""Snapshots whose smallest or largest value is zero have no worst or best rank, and stop no query."""

from pyspark.sql import functions as F

import __spark_entry__ as entry


def folder(spark, tmp_path):
    rows = [(1, 10, "2024-01-01 08:00:00", "click", 0.0), (2, 10, "2024-01-01 09:00:00", "view", 4.0),
            (3, 11, "2024-01-02 08:00:00", "view", 0.0), (4, 11, "2024-01-02 09:00:00", "view", 0.0),
            (5, 12, "2024-01-02 08:00:00", "click", 5.0), (6, 12, "2024-01-03 08:00:00", "error", 2.0),
            (7, 12, "2024-01-03 09:00:00", "error", 50.0)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts string, event_type string, value double").withColumn(
        "ts", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_ranks_of_snapshots_with_zero_extremes(spark, tmp_path):
    got = {r["player"]: (r["overall_rank"], r["worst_rank"], r["best_rank"], r["rank_range"])
           for r in entry.queries()["W1_snapshot_ranks"](spark, folder(spark, tmp_path)).collect()}
    assert got == {10: (2, None, 25, None), 11: (3, None, None, None), 12: (1, 50, 2, 48)}


def test_leaderboard_puts_snapshots_without_a_range_last(spark, tmp_path):
    got = [(r["place"], r["player"], r["rank_range"])
           for r in entry.queries()["W3_leaderboard"](spark, folder(spark, tmp_path)).orderBy("place").collect()]
    assert got == [(1, 12, 48), (2, 10, None), (3, 11, None)]
